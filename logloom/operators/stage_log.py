"""One message per stage of a knowledge build, from counts of its tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def stage_row(df: DataFrame, session: str, seq: int, stage: str, some: str, none: str) -> DataFrame:
    """``some`` is a format with one %d for the row count; ``none`` is the text for no rows."""
    n = F.count("*")
    message = F.when(n > 0, F.format_string(some, n)).otherwise(F.lit(none))
    return df.agg(n.alias("n_rows"), message.alias("message")).select(
        F.lit(session).alias("session"), F.lit(seq).alias("seq"), F.lit(stage).alias("stage"), "n_rows", "message"
    )


def stage_log(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


# (stage, message with a count, message for no rows), worded here.
STAGES = [
    ("extract", "Extracted %d unique templates.", "No structured templates extracted."),
    ("enrich", "Enriched %d templates.", "Enrichment skipped: no extracted templates found."),
    ("augment", "Generated %d synthetic templates.", "No synthetic templates. Using original data."),
    ("index", "Indexed %d templates for retrieval.", "No templates available for vectorization."),
]


def knowledge_log(session: str, tables: list[DataFrame]) -> DataFrame:
    """Messages for the extract, enrich, augment and index tables, in that order."""
    return stage_log(
        [
            stage_row(df, session, seq, stage, some, none)
            for seq, (df, (stage, some, none)) in enumerate(zip(tables, STAGES))
        ]
    )


def failed_batches(errors: DataFrame, session: str, seq: int, batch: Column) -> DataFrame:
    """One message per batch that gave up; ``errors`` has error and attempts."""
    return (
        errors.groupBy(batch.alias("batch"))
        .agg(F.count("*").alias("n_rows"), F.max("attempts").alias("attempts"))
        .select(
            F.lit(session).alias("session"), F.lit(seq).alias("seq"), F.lit("augment").alias("stage"), "n_rows",
            F.format_string("Augmentation Batch %s failed after %d attempts.", F.col("batch").cast("string"), F.col("attempts")).alias("message"),
        )
    )
