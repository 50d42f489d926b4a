"""Log templates: masking, deduplication, wildcard merging, occurrences."""

from pyspark.sql import Column, DataFrame, functions as F

from logloom import schemas
from logloom.functions import text as tx
from logloom.operators.ordered import neighbours
from logloom.operators.skew import salted_lookup
from logloom.session import cut_lineage

# Applied in this order; a later mask sees the placeholders of the earlier ones.
MASKS = [
    ("TS", r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?Z?\b"),
    ("UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("IP", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b"),
    ("HEX", r"\b0[xX][0-9a-fA-F]+\b"),
    ("PATH", r"(?:/[A-Za-z0-9_.-]+){2,}"),
    ("STR", r"\"[^\"<>]*\""),
    ("NUM", r"\b\d+(?:\.\d+)?(?:ns|us|ms|s|m|h|B|KB|MB|GB)?\b"),
]
Masks = list[tuple[str, str]]
CONTEXT_TYPE = schemas.CONTEXT


#: every match of MASKS holds one of these
MASKABLE = '[0-9/"-]'


def mask(line: Column, masks: Masks = MASKS) -> Column:
    own = masks[: -len(MASKS)] if list(masks[-len(MASKS) :]) == MASKS else masks
    for kind, pattern in own:
        line = F.regexp_replace(line, pattern, f"<{kind}>")
    if len(own) == len(masks):
        return line
    masked = line
    for kind, pattern in MASKS:
        masked = F.regexp_replace(masked, pattern, f"<{kind}>")
    # one look at the line spares most lines all patterns
    return F.when(line.rlike(MASKABLE), masked).otherwise(line)


def with_variables(
    df: DataFrame, line: str = "line", masks: Masks = MASKS, template: str = "template", variables: str = "variables"
) -> DataFrame:
    """Add the template and an array of (variable, value) the masks took out of the line.

    Variables are <KIND>_<n>, counted per kind in reading order. Each mask works on the text the
    masks before it have left, one column per mask, so no text is masked twice.
    """
    columns = df.columns
    df = df.withColumn("_text0", F.col(line))
    taken = []
    for i, (kind, pattern) in enumerate(masks):
        text = F.col(f"_text{i}")
        df = df.withColumn(f"_taken{i}", F.regexp_extract_all(text, F.lit(pattern), 0)).withColumn(
            f"_text{i + 1}", F.regexp_replace(text, pattern, f"<{kind}>")
        )
        taken.append(_named(F.col(f"_taken{i}"), kind))
    return df.select(
        *[c for c in columns if c not in (template, variables)],
        F.col(f"_text{len(masks)}").alias(template),
        F.concat(*taken).alias(variables),
    )


def _named(taken: Column, kind: str) -> Column:
    return F.transform(
        taken,
        lambda value, i: F.struct(
            F.concat(F.lit(kind + "_"), (i + 1).cast("string")).alias("variable"), value.alias("value")
        ),
    )


def template_key(template: Column) -> Column:
    """Key for matching: case, spacing and placeholder names do not count."""
    unified = F.regexp_replace(template, r"<[A-Za-z0-9_*]+>", "<*>")
    return F.btrim(F.regexp_replace(F.lower(unified), r"\s+", " "))


def template_id(template: Column) -> Column:
    return F.md5(template)


def extract_templates(lines: DataFrame, masks: Masks = MASKS, guidance: Masks = ()) -> DataFrame:
    """One row per template: counts and its first occurrence (first_run, first_line).

    ``guidance`` holds the caller's own masks and runs first. Counting per (template, run)
    comes first: it combines before the shuffle and splits a template that fills most lines.
    """
    rules = [*guidance, *masks]
    per_run = (
        lines.where(~tx.is_blank(F.col("line")))
        .groupBy(mask(F.col("line"), rules).alias("template"), "run_id")
        .agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    )
    return (
        per_run.groupBy("template")
        .agg(
            F.sum("n").alias("n_lines"),
            F.count("*").alias("n_runs"),
            F.min(F.struct("run_id", "line_no")).alias("first"),
        )
        .select(
            template_id(F.col("template")).alias("template_id"),
            "template", "n_lines", "n_runs",
            F.col("first.run_id").alias("first_run"), F.col("first.line_no").alias("first_line"),
        )
    )


def template_values(lines: DataFrame, masks: Masks = MASKS, guidance: Masks = ()) -> DataFrame:
    """Every distinct value of every template variable with its count, as rows."""
    masked = with_variables(
        lines.where(~tx.is_blank(F.col("line"))).select("line"), masks=[*guidance, *masks]
    )
    return (
        masked.select("template", F.inline("variables"))
        .groupBy("template", "variable", "value")
        .agg(F.count("*").alias("n"))
    )


DISTINCT_BITS = 12  # of the distinct sketch: its relative standard error is about 1.04 / 2 ** (bits / 2)
DISTINCT_BOUND = 0.07  # more than four standard errors
TRACKED = 512  # items a heavy-hitter sketch tracks
HITTERS = 10


def value_sketches(lines: DataFrame, masks: Masks = MASKS, guidance: Masks = ()) -> DataFrame:
    """(template, variable, n, distinct_sketch, top_sketch): what ``template_values`` counts, in sketches of fixed size.

    Sketches combine before the shuffle and may be merged, also with those of other days' lines.
    """
    masked = with_variables(lines.where(~tx.is_blank(F.col("line"))).select("line"), masks=[*guidance, *masks])
    return masked.select("template", F.inline("variables")).groupBy("template", "variable").agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg("value", DISTINCT_BITS).alias("distinct_sketch"),
        F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("top_sketch"),
    )


def merge_sketches(sketches: DataFrame, members: DataFrame) -> DataFrame:
    """Sketches of the wider templates: ``members`` is (template, merged)."""
    return (
        sketches.join(members.select("template", "merged"), "template")
        .groupBy(F.col("merged").alias("template"), "variable")
        .agg(
            F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
            F.expr(f"approx_top_k_combine(top_sketch, {TRACKED})").alias("top_sketch"),
        )
    )


def value_sets(sketches: DataFrame, hitters: int = HITTERS) -> DataFrame:
    """(template, variable, n, n_distinct, top): estimates from sketches.

    ``n_distinct`` is within DISTINCT_BOUND of the truth, exact for a few values; ``top`` has the most frequent values with counts that are off by at most
    3.5 * n / TRACKED.
    """
    return sketches.select(
        "template", "variable", "n", F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"),
        F.expr(f"transform(approx_top_k_estimate(top_sketch, {hitters}), x -> struct(x.item AS value, x.count AS n))").alias("top"),
    )


def merge_values(values: DataFrame, members: DataFrame) -> DataFrame:
    """Exact value rows (template, variable, value, n) of the wider templates."""
    joined = values.join(members.select("template", "merged"), "template")
    return joined.groupBy(F.col("merged").alias("template"), "variable", "value").agg(F.sum("n").alias("n"))


def merge_wildcards(templates: DataFrame, max_distinct: int = 3) -> DataFrame:
    """Merge templates that share token count and first token, position by position.

    A position with more than ``max_distinct`` different tokens in its group becomes
    ``<*>``. Grouping by sets makes the result independent of arrival order.
    """
    tokens = templates.select(
        "template",
        F.split(F.btrim("template"), r"\s+").alias("tokens"),
    ).select(
        "template",
        F.size("tokens").alias("n_tokens"),
        F.get("tokens", F.lit(0)).alias("head"),
        F.posexplode("tokens").alias("pos", "token"),
    )
    group = ["n_tokens", "head", "pos"]
    wide = (
        tokens.groupBy(*group, "token").agg(F.count("*").alias("_n"))
        .groupBy(*group).agg((F.count("*") > max_distinct).alias("wild"))
    )
    merged = (
        salted_lookup(tokens, wide, group, F.col("template"))
        .withColumn("token", F.when(F.col("wild"), "<*>").otherwise(F.col("token")))
        .groupBy("template")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("parts"))
        .select(
            "template",
            F.array_join(F.transform("parts", lambda p: p["token"]), " ").alias("merged"),
        )
    )
    return (
        templates.join(merged, "template")
        .groupBy("merged")
        .agg(
            F.sum("n_lines").alias("n_lines"),
            F.count("*").alias("n_templates"),
            F.min(F.struct("first_run", "first_line")).alias("first"),
        )
        .select(
            F.col("merged").alias("template"), "n_lines", "n_templates", "first.first_run", "first.first_line"
        )
    )


SIMILARITY = 0.6  # share of positions with one token from which lines are one template
SUPPORT = 5  # lines that must share a token for a group of their own
FREE_TEXT = 50  # unlike lines of one shape that are taken for free text
ROUNDS = 4


SPLITS = 100_000  # rows of decisions that are broadcast; with more, the state of a round is stored


def _tokens() -> Column:
    return F.split(F.btrim("template"), r"\s+")


def _by_position(members: DataFrame) -> DataFrame:
    """(part, pos, token) of each member of a part; tokens by their hash."""
    return members.select("part", F.posexplode(F.transform(_tokens(), lambda x: F.xxhash64(x))).alias("pos", "token"))


def _uniform(members: DataFrame) -> DataFrame:
    """(part, pos, same, members): whether all members of a part have one token at a position; combines to one row per part and position before the shuffle."""
    return _by_position(members).groupBy("part", "pos").agg((F.min("token") == F.max("token")).alias("same"), F.count("*").alias("members"))


def _split(state: DataFrame, chosen: DataFrame, frequent: DataFrame) -> DataFrame:
    """State after a round: parts in ``chosen`` are split at their position, all others are closed."""
    placed = state.join(chosen, "part", "left").withColumn("token", F.when(F.col("pos").isNotNull(), F.xxhash64(F.get(_tokens(), F.col("pos")))))
    branch = F.xxhash64("part", "pos", F.coalesce(F.col("branch").cast("string"), F.lit("rest")))
    return placed.join(frequent, ["part", "token"], "left").select(
        "template", F.when(F.col("pos").isNotNull(), branch).otherwise(F.col("part")).alias("part"), F.col("pos").isNotNull().alias("open")
    )


def partition_members(
    templates: DataFrame, similarity: float = SIMILARITY, support: int = SUPPORT, rounds: int = ROUNDS
) -> DataFrame:
    """(template, part): templates dealt to parts of like structure by iterative position partitioning.

    Parts start as templates with equally many tokens. A part in which fewer than ``similarity`` of the positions have only
    one token is split at the position with the fewest different tokens, among those where some token stands in ``support``
    members; members with rarer tokens there stay together. All steps are counts per part, so order does not matter, and a part may be of any size.

    Templates are stored once, those with equally many tokens side by side, so that counts combine before the shuffle. What a round decides is small;
    the state is worked out from the stored templates and the decisions, not stored again, as long as these are few.
    """
    dealt = templates.select("template", F.xxhash64(F.size(_tokens())).alias("part"), F.lit(True).alias("open"))
    state = cut_lineage(dealt.repartitionByRange("part", F.xxhash64("template")))
    for _ in range(rounds):
        uniform = cut_lineage(_uniform(state.where("open")))
        unlike = uniform.groupBy("part").agg(F.avg(F.col("same").cast("int")).alias("alike"), F.max("members").alias("members"))
        unlike = unlike.where((F.col("alike") < similarity) & (F.col("members") >= support)).select("part")
        counted = _by_position(state.where("open").join(unlike, "part", "left_semi")).groupBy("part", "pos", "token").agg(F.count("*").alias("n"))
        usable = counted.groupBy("part", "pos").agg(F.count("*").alias("different"), F.max("n").alias("top")).where((F.col("different") > 1) & (F.col("top") >= support))
        best = usable.groupBy("part").agg(F.min(F.struct("different", "pos")).alias("at"))
        chosen = cut_lineage(best.select("part", F.col("at.pos").alias("pos")))
        n_chosen = chosen.count()
        if n_chosen == 0:
            break
        few = F.broadcast if n_chosen <= SPLITS else lambda x: x
        here = state.where("open").join(few(chosen), "part").select("part", F.xxhash64(F.get(_tokens(), F.col("pos"))).alias("token"))
        frequent = here.groupBy("part", "token").agg(F.count("*").alias("n")).where(F.col("n") >= support)
        frequent = cut_lineage(frequent.select("part", "token", F.col("token").alias("branch")))
        if n_chosen <= SPLITS and frequent.count() <= SPLITS:
            state = _split(state, F.broadcast(chosen), F.broadcast(frequent))
        else:
            state = cut_lineage(_split(state, chosen, frequent))
    return state.select("template", "part")


def similar_templates(
    templates: DataFrame, similarity: float = SIMILARITY, support: int = SUPPORT, free_text: int = FREE_TEXT, rounds: int = ROUNDS
) -> DataFrame:
    """(template, merged, kind) for each distinct template: the wider template it belongs to.

    ``similar``: its part is alike in at least ``similarity`` of the positions, the others become ``<*>``; neighbouring ``<*>`` are one.
    ``free text``: its part is not alike but has at least ``free_text`` members, which are taken together likewise.
    ``single``: neither, and the template stays as it is.
    """
    members = partition_members(templates.select("template"), similarity, support, rounds)
    parts = _uniform(members).groupBy("part").agg(
        F.max("members").alias("members"), F.avg(F.col("same").cast("int")).alias("alike"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "same"))), lambda x: x["same"]).alias("same"),  # one entry per token of a line
    )
    kind = (
        F.when(F.col("members") == 1, "single").when(F.col("alike") >= similarity, "similar")
        .when(F.col("members") >= free_text, "free text").otherwise("single")
    )
    wide = F.zip_with(_tokens(), "same", lambda token, same: F.when(same, token).otherwise(F.lit("<*>")))
    joined = members.join(parts, "part").select("template", wide.alias("wide"), kind.alias("kind"))
    first = F.filter("wide", lambda x, i: (x != "<*>") | (i == 0) | (F.get("wide", i - 1) != "<*>"))
    merged = F.when(F.col("kind") == "single", F.col("template")).otherwise(F.array_join(first, " "))
    return joined.select("template", merged.alias("merged"), "kind")


def merge_similar(templates: DataFrame, members: DataFrame) -> DataFrame:
    """Templates merged by (template, merged, kind): counts add up, the first occurrence of all members stays."""
    return (
        templates.join(members, "template")
        .groupBy("merged")
        .agg(
            F.min("kind").alias("kind"), F.sum("n_lines").alias("n_lines"), F.count("*").alias("n_templates"),
            F.min(F.struct("first_run", "first_line")).alias("first"),
        )
        .select(
            template_id(F.col("merged")).alias("template_id"), F.col("merged").alias("template"), "kind", "n_lines", "n_templates",
            F.col("first.first_run").alias("first_run"), F.col("first.first_line").alias("first_line"),
        )
    )


def with_context(
    templates: DataFrame, lines: DataFrame, before: int = 2, after: int = 2, masks: Masks = MASKS
) -> DataFrame:
    """Add ``values`` and ``context`` of the first occurrence.

    At most before+after+1 lines are looked up per template, by equality on run and line.
    """
    spots = templates.select(
        "template", F.col("first_run").alias("run_id"), F.col("first_line").alias("line_no")
    )
    around = neighbours(spots, lines, before, after)

    def side(condition: Column) -> Column:
        taken = F.collect_list(F.when(condition, F.struct("offset", "line")))
        return F.transform(F.sort_array(taken), lambda x: x["line"])

    found = around.groupBy("template").agg(
        side(F.col("offset") < 0).alias("before"),
        F.max(F.when(F.col("offset") == 0, F.col("line"))).alias("match"),
        side(F.col("offset") > 0).alias("after"),
    )
    found = with_variables(found, "match", masks, template="_masked")
    return templates.join(found, "template").select(
        *[F.col(c) for c in templates.columns],
        F.array(F.map_from_entries("variables")).alias("values"),
        F.struct("before", "match", "after").alias("context"),
    )
