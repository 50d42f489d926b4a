"""Severity, causality and summary of templates, from experts first and rules second."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logloom.operators.templates import template_key

# The label vocabularies.
SEVERITIES = ["INFO", "WARN", "ERROR", "CRITICAL"]
CAUSALITIES = ["Network", "Auth", "Database", "Application", "System"]

# (pattern, label); the first that matches decides, else the default.
SEVERITY_RULES = [
    (r"(?i)\b(critical|fatal|panic|out of memory)\b", "CRITICAL"),
    (r"(?i)\b(error|failed|failure|exception|timeout)\b", "ERROR"),
    (r"(?i)\b(warn|warning|retry|skipped|deprecated)\b", "WARN"),
]
CAUSALITY_RULES = [
    (r"(?i)\b(timeout|connection|network|socket|dns|unreachable|http|https)\b", "Network"),
    (r"(?i)\b(login|auth|token|permission|denied|unauthorized|forbidden)\b", "Auth"),
    (r"(?i)\b(database|sql|query|deadlock|transaction)\b", "Database"),
    (r"(?i)\b(memory|disk|cpu|kernel|heartbeat)\b", "System"),
]


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    return reduce(
        lambda other, rule: F.when(text.rlike(rule[0]), F.lit(rule[1])).otherwise(other),
        reversed(rules),
        F.lit(default),
    )


def labels(template: Column) -> tuple[Column, Column, Column]:
    severity = first_match(template, SEVERITY_RULES, "INFO")
    causality = first_match(template, CAUSALITY_RULES, "Application")
    summary = F.concat(causality, F.lit(" "), F.lower(severity), F.lit(" message: "), template)
    return severity, causality, summary


def enrich(templates: DataFrame, sme: DataFrame) -> DataFrame:
    """Templates with labels, and every expert row that no template matched.

    ``templates`` has template, values and context, one row per key. Each distinct expert row stays: a template
    that several expert rows match appears once with each of them.
    """
    experts = (
        sme.select("template", "severity", "causality", "summary", "resolution").distinct()
        .select(template_key(F.col("template")).alias("key"), F.struct("*").alias("s"))
    )
    keyed = templates.withColumn("key", template_key(F.col("template")))
    severity, causality, summary = labels(F.col("template"))
    joined = keyed.join(experts, "key", "full_outer")
    known, expert = F.col("template").isNotNull(), F.col("s").isNotNull()
    return joined.select(
        F.coalesce("template", "s.template").alias("template"),
        F.when(known, F.col("values"))
        .otherwise(F.array().cast("array<map<string,string>>")).alias("values"),
        F.when(known, F.col("context")).alias("context"),
        F.coalesce("s.severity", severity).alias("severity"),
        F.coalesce("s.causality", causality).alias("causality"),
        F.coalesce("s.summary", summary).alias("summary"),
        F.when(expert, "SME").otherwise("AI Suggested").alias("source"),
        F.col("s.resolution").alias("resolution"),
    )


def valid_templates(reply_rows: DataFrame, reply: str) -> DataFrame:
    """Rows whose model reply holds a non-empty JSON list, with the parsed list."""
    from logloom.functions.json_text import find_json, is_filled_list

    return reply_rows.withColumn("parsed", find_json(F.col(reply))).where(
        is_filled_list(F.col("parsed"))
    )
