"""JSON held in text, read through Spark's VARIANT."""

from pyspark.sql import Column, functions as F

# Where a reply may hold its JSON.
FENCED = r"(?s)```json\s*(.*?)\s*```"
BRACED = r"(?s)(\{.*\})"
# Failed parses are slow, so prose is turned away by its first and last character.
LOOKS_LIKE_JSON = (
    r"(?s)^[ \t\r\n]*(?:\{.*\}|\[.*\]|\".*\"|-?[0-9].*|true|false|null)[ \t\r\n]*$"
)


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is one whole JSON value, else NULL.

    try_parse_json alone ignores what follows the value. So the text is parsed as the
    first element of an array that ends in a mark the text cannot contain, its own md5:
    the text is one value exactly when the mark comes second and last.
    """

    def alone(pair: Column) -> Column:
        marked = F.try_variant_get(pair, "$[1]", "string") == F.md5(text)
        ended = F.try_variant_get(pair, "$[2]", "variant").isNull()
        return F.when(marked & ended, F.try_variant_get(pair, "$[0]", "variant"))

    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit('\n,"'), F.md5(text), F.lit('"]')))
    return F.when(text.rlike(LOOKS_LIKE_JSON), F.get(F.transform(F.array(pair), alone), F.lit(0)))


def find_json(text: Column) -> Column:
    """The whole text, else the first ```json fence, else first { to last }."""
    return F.coalesce(
        strict_json(text),
        strict_json(F.regexp_extract(text, FENCED, 1)),
        strict_json(F.regexp_extract(text, BRACED, 1)),
    )


def json_or_raw(text: Column) -> Column:
    """A tool result as VARIANT; text that is no JSON becomes {"raw": text}."""
    raw = F.to_variant_object(F.struct(text.alias("raw")))
    return F.coalesce(strict_json(text), raw)


def json_string(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def is_filled_list(value: Column) -> Column:
    """True for a JSON array with at least one element."""
    return F.coalesce(
        F.schema_of_variant(value).startswith("ARRAY<")
        & F.try_variant_get(value, "$[0]", "variant").isNotNull(),
        F.lit(False),
    )


def reply_status(reply: Column) -> Column:
    """passed or failed from a model's verdict reply; a reply that is no JSON failed."""
    overall = json_string(strict_json(reply), "$.overall_status")
    return F.when(overall == "ALL_PASSED", F.lit("passed")).otherwise(F.lit("failed"))


def reply_failed_tests(reply: Column) -> Column:
    listed = F.try_variant_get(strict_json(reply), "$.failed_tests", "array<string>")
    return F.when(F.size(listed) > 0, listed)
