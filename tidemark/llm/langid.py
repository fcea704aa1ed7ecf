"""Language identification with one character model per language.

Each language's model of code points is trained on the labelled text that the caller gives, held
in sorted hash arrays (see charlm); a document gets the language with the lowest cross-entropy a
character. The score is the weight of that language among all, and a document is rejected
(``accepted`` false, prediction kept) when its margin over the runner-up is below what all but a
small share of the calibration documents reach: one labelled document in ``CALIBRATION``, by a
hash of its text, teaches no model and is only used for this (unless its language has no others).

Defined cases: null text or one without a letter is ``und`` with score 0; labels that are
null teach nothing; without any label everything is ``und``; languages that tie go by the
first label; repeated rows are predicted each; without calibration documents none is rejected for
its margin; an empty table gives an empty result; no other column is read, and ``keep`` may have
columns of any name but the four that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import charlm
from .workspace import small_batches, stored

UNKNOWN = "und"
#: Code points in an n-gram.
ORDER = 4
#: Share of calibration documents that the margin may reject, and one in how many documents is one.
REJECTED, CALIBRATION = 0.002, 10
#: Characters up to which evidence sharpens the score.
EVIDENCE = 200


def _decided(scored: DataFrame, labels: list[str]) -> DataFrame:
    """scored with lang_pred, score and margin; a tie goes to the first label."""
    if not labels:
        return scored.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "margin": F.lit(0.0)})
    best = F.array_min("costs")
    weight = F.aggregate("costs", F.lit(0.0), lambda acc, c: acc + F.exp((best - c) * F.least("chars", F.lit(EVIDENCE))))
    margin = F.sort_array("costs")[1] - best if len(labels) > 1 else F.lit(1.0)
    at = F.array_position("costs", best).cast("int")
    ok = F.col("row.letters")
    return scored.withColumns({"lang_pred": F.when(ok, F.element_at(F.array(*map(F.lit, labels)), at)).otherwise(UNKNOWN), "score": F.when(ok, 1 / weight).otherwise(0.0), "margin": F.when(ok, margin).otherwise(0.0)})


def identify(docs: DataFrame, teaches: Column, text_col: str = "text", lang_col: str = "lang", keep: list[Column] | None = None) -> DataFrame:
    """keep, lang_pred, score, accepted for every row, learnt from the rows where teaches holds and lang is set."""
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    taught = F.coalesce(teaches & F.col(lang_col).isNotNull() & text.isNotNull(), F.lit(False))
    held = F.pmod(F.xxhash64(text), F.lit(CALIBRATION)) == 0
    others = [r[0] for r in docs.where(taught & ~held).select(lang_col).distinct().collect()]
    apart = held & F.col(lang_col).isin(others)
    lessons = docs.where(taught & ~apart).select(F.col(lang_col).alias("label"), text.alias("text"))
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters")
    kept = F.struct(*(keep or [F.lit(None).cast("int").alias("none")])).alias("kept")
    labels, scored = charlm.scored(lessons, docs.select(F.struct(kept, (taught & apart).alias("calibrates"), letters).alias("row"), text.alias("text")), ORDER)
    found = stored(_decided(scored, labels).select("row.*", "lang_pred", "score", "margin"), "langid")
    least = found.where("calibrates AND letters").agg(F.percentile_approx("margin", REJECTED, 10_000).alias("least")).first()["least"]
    accepted = (F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= F.lit(least or 0.0))
    return found.select(*(["kept.*"] if keep else []), "lang_pred", "score", accepted.alias("accepted"))
