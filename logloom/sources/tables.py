"""Parquet tables that grow: vectors, tips, run history, tickets."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logloom import schemas
from logloom.operators.latest import latest_per_key
from logloom.session import cut_lineage

DEFAULT_COLLECTION = "log_templates"
PREFIXES = 256
LISTED_IDS = 1000  # ids of a smaller batch are pushed to the scan
TIP_KEY, TIP_ORDER = ["namespace", "key"], ["updated_at", "run_id"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path``."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def open_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``, or an empty one if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def open_collection(spark: SparkSession, path: str, name: str = DEFAULT_COLLECTION) -> DataFrame:
    """Vectors of one collection; the filter prunes the other collections' folders."""
    return open_table(spark, path, schemas.VECTORS).where(F.col("collection") == name)


def prefix_of(key: str) -> Column:
    """One of PREFIXES folders, by the hash of a key."""
    # the letter in front keeps folder names from being read as numbers
    return F.concat(F.lit("h"), F.substring(F.coalesce(F.md5(key), F.lit("00")), 1, 2))


def _touched(batch: DataFrame, *columns: str) -> list[list[str]]:
    """Distinct values of partition columns in a batch: collections, kinds and at most PREFIXES prefixes."""
    sets = batch.agg(*[F.collect_set(c) for c in columns]).first()
    return [sorted(values) for values in sets]


def stored_ids(batch: DataFrame, path: str) -> DataFrame:
    """Ids of a stored batch (id, collection, prefix) that the table at ``path`` already holds.

    Only folders of the batch's own collections and prefixes are read, and of a small batch's ids only the row groups whose range
    and Bloom filter may hold one.
    """
    spark = batch.sparkSession
    try:
        stored = spark.read.schema(StructType([*schemas.VECTORS, StructField("prefix", StringType())])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return batch.select("id").limit(0)
        raise
    collections, prefixes = _touched(batch, "collection", "prefix")
    stored = stored.where(F.col("collection").isin(collections) & F.col("prefix").isin(prefixes)).select("id")
    few = batch.select("id").limit(LISTED_IDS + 1).collect()
    if len(few) <= LISTED_IDS:
        stored = stored.where(F.col("id").isin([row.id for row in few]))
    return stored.join(batch.select("id"), "id", "left_semi")


def _write_vectors(rows: DataFrame, path: str, mode: str) -> None:
    """Rows sorted by id, so that each file's row groups hold narrow ranges of ids."""
    folders = ["collection", "record_kind", "prefix"]
    (
        rows.repartition(*folders).sortWithinPartitions(*folders, "id").write.mode(mode)
        .option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#id", "true")
        .partitionBy(*folders).parquet(path)
    )


def append_vectors(records: DataFrame, path: str) -> None:
    """Append records whose id is not stored yet, so a repeated run adds nothing.

    The table lies in folders by collection, kind and hash prefix of the id; an append reads the ids of its own folders only.
    """
    names = [field.name for field in schemas.VECTORS]
    batch = cut_lineage(records.select(*names).dropDuplicates(["id"]).withColumn("prefix", prefix_of("id")))
    fresh = cut_lineage(batch.join(stored_ids(batch, path), "id", "left_anti"))
    _write_vectors(fresh.select(*names, "prefix"), path, "append")


def compact_vectors(spark: SparkSession, path: str, least_files: int = 4) -> int:
    """Rewrite every folder of ``least_files`` files or more as one sorted file; the number of folders rewritten.

    Rows stay as they are. Nothing else may write to the table meanwhile.
    """
    stored = spark.read.schema(StructType([*schemas.VECTORS, StructField("prefix", StringType())])).parquet(path)
    folders = ["collection", "record_kind", "prefix"]
    crowded = (
        stored.select(*folders, F.input_file_name().alias("file")).distinct()
        .groupBy(*folders).agg(F.count("*").alias("n")).where(F.col("n") >= least_files).drop("n")
    )
    crowded = cut_lineage(crowded)  # at most PREFIXES rows for each collection and kind
    n = crowded.count()
    if n:
        rows = cut_lineage(stored.join(F.broadcast(crowded), folders))
        _write_vectors(rows.select(*stored.columns), path, "overwrite")
    return n


def append_rows(rows: DataFrame, path: str, schema: StructType) -> None:
    """Append to a plain log-structured table; readers take the latest row per key."""
    rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").parquet(path)


def put_tips(tips: DataFrame, path: str) -> None:
    """Keep the latest tip of each namespace and key: one row per key stays stored.

    Tips lie in folders by hash prefix of the key; only the folders of the batch's keys are read and replaced.
    A batch that runs twice changes nothing. Nothing else may write to the table meanwhile.
    """
    names = [field.name for field in schemas.TIPS]
    rows = tips.select(*[F.col(f.name).cast(f.dataType) for f in schemas.TIPS]).withColumn("prefix", prefix_of("key"))
    batch = cut_lineage(latest_per_key(rows, TIP_KEY, TIP_ORDER))
    (prefixes,) = _touched(batch, "prefix")
    if not prefixes:
        return
    spark, schema = tips.sparkSession, StructType([*schemas.TIPS, StructField("prefix", StringType())])
    if exists(spark, path):
        stored = spark.read.schema(schema).parquet(path).where(F.col("prefix").isin(prefixes))
        batch = cut_lineage(latest_per_key(batch.unionByName(stored), TIP_KEY, TIP_ORDER))
    batch.select(*names, "prefix").repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "prefix"
    ).parquet(path)


def put_run_history(rows: DataFrame, path: str) -> None:
    append_rows(rows, path, schemas.RUN_HISTORY)


def put_tickets(tickets: DataFrame, path: str, file_format: str = "parquet") -> None:
    names = [field.name for field in schemas.TICKETS]
    tickets.select("run_id", *names).write.mode("append").format(file_format).save(path)
