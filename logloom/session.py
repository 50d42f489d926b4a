"""Session settings and lineage cuts."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the library's results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # json.loads accepts repeated keys, so strict parsing must too
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


_local_scratch: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only local sessions may do without and get their own."""
    global _local_scratch
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="logloom-")
    return _local_scratch


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and go on from that table.

    Later steps read only the columns they need, know the table's size, and survive the
    loss of executors. The shuffle files of the steps before go with the write.
    """
    folder = shared_folder(df.sparkSession)
    path = f"{folder.rstrip('/')}/logloom-{uuid.uuid4().hex}"
    with _shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables of ``cut_lineage``, each as it returned them, that no later step reads."""
    for df in tables:
        jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if not folder.rsplit("/", 1)[1].startswith("logloom-"):
                raise ValueError(f"{folder} is no table of cut_lineage")
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
