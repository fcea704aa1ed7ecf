"""A corpus pipeline of five stages over ``documents``: every stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, mixing, ngram_join, packing, quality
from tidemark.llm.queries import table, tokenizer_file
from tidemark.llm.workspace import file_numbers, numbered, placed, readable_rows, small, stored


def _rows(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows as doc, whatever their columns are called; the same with row_no, a number of their own; and the numbers of their files."""
    rows = readable_rows(docs, [F.struct("*").alias("doc")])
    files = file_numbers(placed(rows))
    return rows, numbered(placed(rows), files), files


def _part(keyed: DataFrame, *columns: str) -> DataFrame:
    """row_no and some columns of the rows."""
    return keyed.select("row_no", *[F.col(f"doc.`{c}`").alias(c) for c in columns])


def _only(keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose row_no is in kept."""
    return keyed.join(small(stored(kept, "pipeline-kept")), "row_no", "left_semi").select("doc.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    rows, keyed, files = _rows(docs)
    given = placed(rows).select("file", "row", *[F.col(f"doc.`{c}`").alias(c) for c in ("doc_id", "lang", "text")])
    judged = quality.classify(given, table(spark, sf_dir, "labels"), [F.col("file"), F.col("row")])
    return _only(keyed, numbered(judged.where("accepted").select("file", "row"), files).select("row_no"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of exact copies."""
    rows, keyed, files = _rows(docs)
    key = F.struct(F.col("doc.doc_id").isNull().alias("missing"), F.col("doc.doc_id").alias("doc_id")).alias("key")
    found = exact_dedup.exact_dedup(rows.select(key, F.col("doc.text").alias("text")), id_col="key")
    return _only(keyed, numbered(found.where("kept").select("file", "row"), files).select("row_no"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group that links of similarity 0.8 join."""
    _, keyed, _ = _rows(docs)
    found = ngram_join.join(_part(keyed, "text"), id_col="row_no").select(F.col("id").alias("row_no"), "component_id")
    key = F.struct(F.col("doc.doc_id").isNull().alias("missing"), F.col("doc.doc_id").alias("doc_id"), "row_no").alias("row_key")  # null ids last
    first = found.join(keyed.select("row_no", key), "row_no").groupBy("component_id").agg(F.min("row_key").alias("first"))
    return _only(keyed, first.select("first.row_no"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix draws: repeated epochs are rows again, a document at a cut keeps its first words."""
    _, keyed, _ = _rows(docs)
    sized = stored(_part(keyed, "doc_id", "source", "text").withColumn("size", mixing.words(F.col("text"))).drop("text"), "pipeline-sizes")
    taken = stored(mixing.mix(sized).where("taken > 0").select("row_no", "size", "taken"), "pipeline-taken")
    drawn = mixing.drawn(keyed.join(small(taken), "row_no").select("doc", F.col("doc.text").alias("text"), "size", "taken"))
    return drawn.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on the stored result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-stage")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the token ids and the packing have no SQL; tests hold stages against brute force.
ORACLE_SQL = None
