"""Knowledge building in two jobs with a review table between them."""

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from logloom.operators import augment as ag, enrich as en, infer as inf, review as rv, stage_log as sl, templates as tp
from logloom.operators.embed import EmbedderFactory, template_records
from logloom.operators.ordered import number_lines
from logloom.session import cut_lineage


@dataclass(frozen=True)
class Extracted:
    """What Job A gives: the templates to review, every value of their variables as rows, and value sets of bounded size."""

    pending: DataFrame
    values: DataFrame  # (template, variable, value, n)
    value_sets: DataFrame  # (template, variable, n, n_distinct, top)
    members: DataFrame  # (template, merged, kind): the masked lines behind each template


def extract(
    lines: DataFrame, sme: DataFrame, guidance: tp.Masks = (), before: int = 2, after: int = 2, free_text: int = tp.FREE_TEXT
) -> Extracted:
    """Job A: extract templates from lines, merge those of like structure, add values and context, enrich."""
    masks = [*guidance, *tp.MASKS]
    extracted = cut_lineage(tp.extract_templates(lines, tp.MASKS, guidance))
    members = cut_lineage(tp.similar_templates(extracted, free_text=free_text))
    merged = cut_lineage(tp.merge_similar(extracted, members))
    found = tp.with_context(merged, lines, before, after, masks)
    enriched = en.enrich(found.select("template", "values", "context"), sme)
    return Extracted(
        pending=enriched.withColumn("template_id", tp.template_id(F.col("template"))),
        values=tp.merge_values(tp.template_values(lines, tp.MASKS, guidance), members),
        value_sets=tp.value_sets(tp.merge_sketches(tp.value_sketches(lines, tp.MASKS, guidance), members)),
        members=members,
    )


def pending_templates(
    lines: DataFrame, sme: DataFrame, guidance: tp.Masks = (), before: int = 2, after: int = 2, free_text: int = tp.FREE_TEXT
) -> DataFrame:
    """The templates of Job A alone."""
    return extract(lines, sme, guidance, before, after, free_text).pending


REPLY = "array<struct<template:string,severity:string,causality:string,summary:string>>"


def is_list(reply: str) -> bool:
    """Whether a model's reply holds a JSON list."""
    try:
        return isinstance(json.loads(reply[reply.index("[") : reply.rindex("]") + 1]), list)
    except ValueError:
        return False


def augment_by_model(
    templates: DataFrame,
    make_model: Callable[[], Callable[[list[str]], list[str]]],
    session: str,
    first_wait: float = inf.FIRST_WAIT,
) -> tuple[DataFrame, DataFrame]:
    """(variants, messages): new templates by the caller's model, and a message for each batch that it did not answer.

    ``templates`` has template_id, template, severity, causality and summary, one row per template. Three at a time go to the model in the order of their ids; it
    replies to each with a JSON list of objects. A reply without one is asked for again. Fields that an object leaves out are those of its template.
    """
    place = F.conv(F.substring("template_id", 1, 2), 16, 10).cast("int")  # ascends with the id, so no task numbers all rows
    numbered = number_lines(templates.withColumn("_all", F.lit(0)).withColumn("_place", place), "_all", "_place", ["template_id"], "_no")
    asked = numbered.select(
        F.floor(F.col("_no") / inf.BATCH_SIZE).alias("batch"), "template_id", "template", "severity", "causality", "summary",
        F.concat(F.lit("Write variants of this log template as a JSON list: "), "template").alias("prompt"),
    )
    replies = cut_lineage(inf.batch_infer(asked, "prompt", make_model, first_wait=first_wait, batch_key="batch", accept=is_list))
    answered, failed = inf.split_failed(replies)
    found = en.valid_templates(answered, "response").withColumn("made", F.expr(f"try_variant_get(parsed, '$', '{REPLY}')"))
    rows = found.select("batch", F.struct("template", "severity", "causality", "summary").alias("old"), F.posexplode("made").alias("pos", "new"))
    variants = rows.where("new.template IS NOT NULL").select(
        "batch", F.col("old.template").alias("template"), (F.col("pos") + 1).alias("variant_no"), F.col("new.template").alias("variant"),
        *[F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in ("severity", "causality", "summary")],
        F.lit("AI Augmented").alias("source"),
    )
    return variants, sl.failed_batches(failed, session, 2, F.col("batch"))


def index_reviewed(
    pending: DataFrame,
    decisions: DataFrame,
    make_embedder: EmbedderFactory,
    dim: int,
    collection: str = "log_templates",
    on_reject: str = "drop",
    codes: DataFrame | None = None,
) -> DataFrame:
    """Job B: apply the decisions, add variants, embed; the result is appended by the caller.

    ``codes`` is the caller's table of error codes (code, phrase), see ``augment``.
    """
    reviewed = rv.apply_review(pending, decisions, on_reject)
    return template_records(ag.augment(reviewed, codes), collection, make_embedder, dim)
