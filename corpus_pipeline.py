"""From raw documents to packed training sequences, as stages that each read what the one before has written."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm import decontaminate, language, ngram_join, packing, toxicity
from logloom.session import shared_folder

#: SQL cannot express these stages; tests/llm compares them with brute force
ORACLE_SQL = None
#: words that a worker keeps encoded; four stages have filled its executor's heap before
CACHED_WORDS = 150_000


def _prefix(docs: DataFrame) -> str:
    """A start of column names that no column of ``docs`` has."""
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    p = _prefix(docs)
    found = language.predict(docs, language.train(docs), p)
    return found.where(F.col(f"{p}lang_pred") != language.UNDETERMINED).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    p = _prefix(docs)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.predict(docs, model, prefix=p).where(F.col(f"{p}predicted") == 0).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles with a similarity of 0.8 connect."""
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its token ids and its place in a sequence."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.token_pieces(docs, path, end_id=2, cache_words=CACHED_WORDS, keep_cache=False)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")))


STAGES = [
    ("language_id", language_id),
    ("toxicity", not_toxic),
    ("ngram_jaccard_join", deduplicated),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
