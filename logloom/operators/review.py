"""Applying review decisions to templates."""

from pyspark.sql import DataFrame, functions as F

EDITABLE = ["severity", "causality", "summary"]

# The messages after review.
APPROVED = "Human review approved. Proceeding to next steps."
NOT_APPROVED = "Human review rejected or pending. Workflow paused/stopped."


def split_decisions(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable decisions, rejected ones). "category" is another name for causality."""
    field = F.lower("field")
    named = decisions.withColumn("field", F.when(field == "category", "causality").otherwise(field))
    action = F.col("action")
    usable = F.coalesce(
        action.isin("approve", "reject") | ((action == "edit") & F.col("field").isin(EDITABLE)),
        F.lit(False),
    )
    return named.where(usable), named.where(~usable)


def apply_review(templates: DataFrame, decisions: DataFrame, on_reject: str = "drop") -> DataFrame:
    """Templates after review, with ``review_action``.

    ``decisions`` has template_id, action, field, value and decided_at; per template the latest
    approve/reject and the latest edit of each field count, reduced before the join. An edit does not undo a rejection. Of
    decisions made at the same time a rejection, and the larger value, counts.
    """
    usable, _ = split_decisions(decisions)
    when = F.col("decided_at")

    def latest_edit(name: str):
        here = (F.col("action") == "edit") & (F.col("field") == name)
        return F.max_by(F.when(here, F.col("value")), F.when(here, F.struct(when, F.col("value")))).alias("new_" + name)

    decided = F.col("action").isin("approve", "reject")

    per_template = usable.groupBy("template_id").agg(
        F.coalesce(
            F.max_by(F.when(decided, F.col("action")), F.when(decided, F.struct(when, F.col("action")))), F.lit("edit")
        ).alias("last_action"),
        *[latest_edit(f) for f in EDITABLE]
    )
    edited = templates.join(per_template, "template_id", "left").select(
        *[
            F.coalesce("new_" + c, c).alias(c) if c in EDITABLE else F.col(c)
            for c in templates.columns
        ],
        F.coalesce("last_action", F.lit("pending")).alias("review_action"),
    )
    return edited if on_reject == "keep" else edited.where("review_action <> 'reject'")


def review_message(approved) -> F.Column:
    return F.when(approved, F.lit(APPROVED)).otherwise(F.lit(NOT_APPROVED))


def traffic_light(source, review_action) -> F.Column:
    """green: from an expert; amber: suggested and approved or edited; red: not looked at yet."""
    return (
        F.when(source == "SME", "green")
        .when(review_action.isin("approve", "edit"), "amber")
        .otherwise("red")
    )


def promotable(reviewed: DataFrame, sme: DataFrame) -> DataFrame:
    """Reviewed templates to append to the expert table: approved or edited, and not in it yet."""
    from logloom.operators.templates import template_key

    known = sme.select(template_key(F.col("template")).alias("key"))
    return (
        reviewed.where(F.col("review_action").isin("approve", "edit") & (F.col("source") != "SME"))
        .withColumn("key", template_key(F.col("template")))
        .join(known, "key", "left_anti")
        .dropDuplicates(["key"])
        .select("template", "severity", "causality", "summary", F.lit(None).cast("string").alias("resolution"))
    )
