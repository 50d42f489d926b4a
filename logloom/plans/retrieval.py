"""Similar past issues for a table of query texts."""

from pyspark.sql import DataFrame, functions as F

from logloom.operators.embed import EmbedderFactory, embed_texts
from logloom.operators.knn import knn_join, with_records

TOP_K = 5  # fixed value: default number of hits


def retrieve(
    queries: DataFrame, vectors: DataFrame, make_embedder: EmbedderFactory, dim: int, top_k: int = TOP_K
) -> DataFrame:
    """Hits of queries (query_id, query): rank, id, document, metadata, distance."""
    embedded = embed_texts(queries, "query", make_embedder, dim, spread_by="query_id")
    hits = knn_join(
        embedded.select("query_id", F.col("embedding").alias("query_vec")),
        vectors.select(F.col("id").alias("vec_id"), F.col("embedding").alias("vec")),
        top_k,
    )
    records = vectors.select(
        F.col("id").alias("vec_id"),
        "document",
        F.struct("template", "severity", "summary", "causality", "source").alias("metadata"),
    )
    return with_records(hits, records).select(
        "query_id", "rank", F.col("vec_id").alias("id"), "document", "metadata", "distance"
    )
