"""Quality classifier: perplexity under a language model of trusted text.

An interpolated modified Kneser-Ney model of character n-grams is trained on all trusted
documents (sharded partial counts, summed by n-gram). A document's perplexity is compared
with quantiles of the trusted documents of its own language and length class (powers of two),
at both ends: unlike text is above the upper, endless repetition below the lower. The fewer
trusted documents a language or class has, the nearer its figures are to those of all: one
formula at every size. There are two models, each of one half of the trusted documents by
their ids' checksums, and a document is judged by the model of the half that it isn't in, as its
own text would make it look too usual.

The distinct n-grams of each chunk of documents are joined with the count table, sharded by
n-gram (see charlm).

Defined cases: null or empty text has perplexity null and is kept; a null language
uses the thresholds of all languages; without trusted
documents everything is kept; a label for a missing document plays no part; several labels
of one document trust it if all do; repeated rows are scored each; an empty table gives an
empty result; no other column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import charlm
from .workspace import small, small_batches, stored

#: Code points in an n-gram.
ORDER = 4
#: Quantiles of trusted documents: one in 500 of them is rejected.
LOW, HIGH = 0.001, 0.999
#: Trusted documents of a group that weigh as much as the wider group does.
WEIGHT = 50


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids whose labels all say quality 1 and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.coalesce(good, F.lit(False))).alias("trusted")).where("trusted").select("id")


def classify(docs: DataFrame, labels: DataFrame, keep: list[Column], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """keep, perplexity, low, high, accepted for every row of docs."""
    small_batches(docs.sparkSession)
    trusted = stored(trusted_ids(labels), "quality-trusted")
    own = docs.select(F.struct(*keep).alias("kept"), F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    taught = own.join(small(trusted), "id", "left_semi")
    rows = own.select(F.struct("kept", "id", "lang").alias("row"), "text")
    half = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 2, F.lit(0))
    halves, scored = charlm.scored(taught.select(half.cast("string").alias("label"), "text"), rows, ORDER)
    under = lambda label: F.col("costs")[halves.index(label if label in halves else halves[0])]
    half = F.coalesce(F.crc32(F.col("row.id").cast("string").cast("binary")) % 2, F.lit(0))
    cost = F.when(half == 0, under("1")).otherwise(under("0")) if halves else F.lit(0.0)
    scored = scored.select("row.kept", "row.id", "row.lang", F.when(F.col("chars") > 0, cost).alias("cost"), "chars")
    good = small(trusted.withColumns({"trusted": F.lit(True), "salt": F.lit(0).cast("long")}))
    # Rows without an id match none, and would all meet in one task.
    salt = F.when(F.col("id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1024))).otherwise(0)
    scored = stored(scored.withColumn("salt", salt).join(good, ["id", "salt"], "left").drop("salt"), "quality-scores")
    return _judged(scored, scored.where("trusted AND cost IS NOT NULL"))


def _shrunk(own: Column, wider: Column, n: Column) -> Column:
    """A group's figure drawn towards the wider group's, the more the fewer trusted documents it has."""
    n = F.coalesce(n, F.lit(0))
    return F.when(n > 0, (n * own + WEIGHT * wider) / (n + WEIGHT)).otherwise(wider)


def _judged(scored: DataFrame, known: DataFrame) -> DataFrame:
    """scored against quantiles of known: of the distance from the language's mean cost, by language and length class."""
    size = F.floor(F.log2(F.greatest("chars", F.lit(1)))).alias("size")
    whole = F.broadcast(known.agg(F.avg("cost").alias("mean")))
    means = small(stored(known.where("lang IS NOT NULL").groupBy("lang").agg(F.avg("cost").alias("own"), F.count("*").alias("n")), "quality-means"))
    centre = _shrunk(F.col("own"), F.col("mean"), F.col("n")).alias("centre")
    placed = lambda df: df.join(means, "lang", "left").join(whole, how="left").select(*df.columns, size, centre)
    away = stored(placed(known).select("lang", "size", (F.col("cost") - F.col("centre")).alias("away")), "quality-distances")
    bounds = lambda df, name: df.agg(F.percentile_approx("away", F.array(F.lit(LOW), F.lit(HIGH)), 10_000).alias(f"q_{name}"), F.count("*").alias(f"n_{name}"))
    by_cell = small(stored(bounds(away.where("lang IS NOT NULL").groupBy("lang", "size"), "cell"), "quality-bounds"))
    by_size = F.broadcast(bounds(away.groupBy("size"), "size"))  # a row for each power of two
    rows = placed(scored).join(by_cell, ["lang", "size"], "left").join(by_size, "size", "left").join(F.broadcast(bounds(away, "all")), how="left")
    edge = lambda i: F.col("centre") + _shrunk(F.col("q_cell")[i], _shrunk(F.col("q_size")[i], F.col("q_all")[i], F.col("n_size")), F.col("n_cell"))
    judged = rows.withColumns({"low": edge(0), "high": edge(1)})
    fine = F.coalesce(F.col("cost").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select("kept.*", F.exp("cost").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"), fine.alias("accepted"))
