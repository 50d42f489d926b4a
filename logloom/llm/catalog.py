"""Registered queries of this subpackage. Those that SQL can express have their check in ``catalog_sql``."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm import collision_search, cover_tree, decontaminate, language, licenses, merkle, ngram_join, ngram_model, packing, site_tree, spelling, token_files, toxicity
from logloom.llm.samples import remainder
from logloom.llm.words import ascii_lower
from logloom.session import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place in a sequence of every piece of every document."""
    pieces = packing.token_pieces(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digest).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it covers by half or more."""
    return decontaminate.document_coverage(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the token files."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = token_files.write_tokens(
        _table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1
    )
    return token_files.read_tokens(manifest, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learnt from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = ngram_model.train(docs.where(remainder(7) != 2).select("text"), order=3)
    found = ngram_model.score(docs.select("doc_id", "text"), model).drop("text")
    return found.withColumn("held_out", remainder(7) == 2).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"
    )


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query_vec"))
    return collision_search.search(vectors, queries)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: four-word shingles, Jaccard 0.85 or more."""
    docs = _table(spark, sf_dir, "documents")
    return ngram_join.component_ids(ngram_join.near_duplicates(docs, k=4, similarity=(85, 100)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document with the nearest examples as evidence."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf_dir, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = site_tree.main_text(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op11_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all documents, some with a letter left out, with its form and root."""
    found = _table(spark, sf_dir, "documents").select("doc_id", F.explode(spelling.runs(F.col("text"))).alias("run"))
    found = found.withColumn("run", ascii_lower(F.col("run")))
    digest = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    cut = spelling.without_letter(F.col("run"), (F.col("digest") % F.char_length("run")).cast("int"))
    words = found.withColumn("digest", digest).select(F.when(F.col("digest") % 97 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.variants(spelling.vocabulary(words))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document's place in the manifest, and whether its text of today still has that proof."""
    docs = _table(spark, sf_dir, "documents")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = [ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in names]
    leaf = merkle.leaf_digest([F.col(c) for c in names])
    found = merkle.manifest(
        docs.select(
            "doc_id", F.col("source").alias("group"), F.col("doc_id").alias("key"), leaf.alias("leaf"),
            F.when(remainder(5) == 0, merkle.leaf_digest(tampered)).otherwise(leaf).alias("claimed"),
        )
    )
    root = F.lit(found.root)
    return merkle.proofs(found).select(
        "doc_id", "leaf", "subroot", root.alias("root"), merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        merkle.fold(F.col("claimed"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == root)


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector: cosine 0.95 or more."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    found = cover_tree.near_duplicates(vectors, 0.95)
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_token_files": op3_token_files,
    "op4_language_model": op4_language_model,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_html_extraction": op10_html_extraction,
    "op11_spelling_variant_grouping": op11_spelling_variant_grouping,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}
