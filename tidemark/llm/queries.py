"""The operators' queries over whole tables: thin wrappers that shape each operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, langid, lexical, license_scan, mixing, ngram_join, packing, quality, repeats, secret_scan, token_store, topk
from .oracles import ORACLE_SQL
from .workspace import scratch, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays."""
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license templates."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component it reaches by links of similarity 0.8."""
    return ngram_join.join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id")


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether it is accepted."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), [F.col("doc_id"), F.col("lang")])


@query
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for each vector whose id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Sizes are counted once, into a narrow table."""
    docs = table(spark, sf_dir, "documents")
    sized = stored(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size")), "mix-sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 100 bytes that occurred earlier."""
    return repeats.repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the corpus' token ids, reads them back, and says where each document's are."""
    path = scratch(spark, "token-store")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return token_store.token_index(spark, path)


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those outside the held-out third."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    found = langid.identify(table(spark, sf_dir, "documents"), fold != 1, keep=[F.col("doc_id"), F.coalesce(fold == 1, F.lit(False)).alias("held_out")])
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, in its sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10).withColumnRenamed("id", "doc_id")


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source is from every other one of its language, and by which terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets. A source is the owner, and each of its languages a repository of it."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), F.col("source"), F.struct("source", "lang"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_owned", "n_live", "n_copied")


__all__ = ["ORACLE_SQL", "QUERIES"]
