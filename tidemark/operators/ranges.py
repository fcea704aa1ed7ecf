"""Key ranges: splitting, density, overlap of committed files, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sweep import high, low, running_max


def split(lo: int, hi: int, k: int) -> list[tuple[int | None, int | None]]:
    """At most k disjoint ranges (low, high] over [lo, hi] that cover all keys: the outer sides are open."""
    k = max(1, min(k, hi - lo + 1))
    cuts = [lo + (hi - lo + 1) * i // k - 1 for i in range(1, k)]
    return list(zip([None, *cuts], [*cuts, None], strict=True))


def predicates(key: str, ranges: list[tuple[int | None, int | None]]) -> list[str]:
    """SQL conditions of the ranges, as JDBC reads take them."""
    return [" AND ".join([*([f"{key} > {a}"] if a is not None else []), *([f"{key} <= {b}"] if b is not None else [])]) or "1 = 1" for a, b in ranges]


def density(rows: int, lo: int, hi: int, total_lo: int, total_hi: int) -> int:
    """Estimated rows of a range if keys were even."""
    return round(rows * (hi - lo) / (total_hi - total_lo)) if total_hi > total_lo else rows


def densities(df: DataFrame, key: str, k: int) -> DataFrame:
    """k, estimated, rows: what each of k equal ranges (low, high] of a whole-number key would hold if keys were even, and what it holds."""
    at = F.col(key)
    whole = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n"))
    cut = lambda i: F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * i / k)
    spans = whole.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))).withColumns({"low": cut(F.col("k")), "high": cut(F.col("k") + 1)})
    estimated = F.round(F.col("n").cast("double") * (F.col("high") - F.col("low")) / (F.col("hi") - F.col("lo"))).cast("long")
    # One row says where the ranges are; keys are counted by number of range, and k rows of counts meet them.
    bounds = F.broadcast(spans.agg(F.array_sort(F.collect_list("high")).alias("highs"), F.min("low").alias("first")))
    number = F.size(F.filter("highs", lambda h: h < at)).cast("long")
    counts = df.join(bounds).where(at > F.col("first")).groupBy(number.alias("k")).agg(F.count("*").alias("rows"))
    return spans.join(counts, "k", "left").select("k", estimated.alias("estimated"), F.coalesce("rows", F.lit(0)).alias("rows"))


def overlaps(files: DataFrame, key: str = "path") -> DataFrame:
    """Pairs (a, b), a before b, of files (path, lo, hi) whose ranges (lo, hi] meet; null is unbounded. contained: b lies in a.

    The key space is cut into as many cells as there are files; ranges meet by an equi-join on
    the cells that they cover, and a pair counts in the one cell where the later range begins.
    """
    span = files.agg(F.min(F.least("lo", "hi")).alias("lo"), F.max(F.greatest("lo", "hi")).alias("hi"), F.count("*").alias("n")).first()
    first, width = span["lo"] or 0, max(1e-9, ((span["hi"] or 0) - (span["lo"] or 0)) / max(1, span["n"]))
    cell = lambda c, otherwise: F.when(c.isNull(), otherwise).otherwise(F.floor((c - F.lit(first)) / F.lit(width)))
    begin, end = cell(F.col("lo"), F.lit(0)).cast("long"), cell(F.col("hi"), F.lit(max(1, span["n"]))).cast("long")
    held = files.select(F.col(key).alias("path"), "lo", "hi", begin.alias("begin"), F.greatest(begin, end).alias("end"))
    held = held.withColumn("cell", F.explode(F.sequence("begin", "end")))
    side = lambda x: held.select("cell", F.col("path").alias(x), F.col("lo").alias(f"{x}lo"), F.col("hi").alias(f"{x}hi"), F.col("begin").alias(f"{x}begin"))
    met = side("a").join(side("b"), "cell").where((F.col("a") < F.col("b")) & (F.col("cell") == F.greatest("abegin", "bbegin")))
    meet = (F.col("alo").isNull() | F.col("bhi").isNull() | (F.col("alo") < F.col("bhi"))) & (F.col("blo").isNull() | F.col("ahi").isNull() | (F.col("blo") < F.col("ahi")))
    inside = (F.col("alo").isNull() | (F.col("blo") >= F.col("alo"))) & (F.col("ahi").isNull() | (F.col("bhi") <= F.col("ahi")))
    return met.where(meet).select("a", "b", F.coalesce(inside, F.lit(False)).alias("contained"))


def covered(points: DataFrame, at: Column, spans: DataFrame, through: Column | None = None) -> DataFrame:
    """points with covered: whether one of the spans (lo, hi] holds the value at; with through, all of [at, through]; null bounds are open.

    Points and spans meet in one order, swept by a running maximum of the spans' ends: n log n however they overlap.
    """
    end = at if through is None else through
    begins = spans.select(low(F.col("lo")).alias("__at"), F.lit(1).alias("__kind"), high(F.col("hi")).alias("__end"), F.lit(None).cast(points.schema).alias("__row"))
    # A span that begins where a point lies does not hold it, but holds a range that begins there.
    asks = points.select(low(at).alias("__at"), F.lit(0 if through is None else 2).alias("__kind"), F.lit(None).cast(begins.schema["__end"].dataType).alias("__end"), F.struct(*points.columns).alias("__row"))
    both = begins.unionByName(asks).withColumn("__no", F.monotonically_increasing_id())
    swept = running_max(both, ["__at", "__kind", "__no"], "__end", "__reach").where("__row IS NOT NULL")
    reach = high(end) if through is not None else F.struct(F.lit(1).alias("side"), end.alias("at"))
    row = swept.select("__row.*", "__reach")
    return row.withColumn("covered", F.coalesce(F.col("__reach") >= reach, F.lit(False))).drop("__reach")


def meeting(files: DataFrame, others: DataFrame) -> DataFrame:
    """files (path, lo, hi) with meets: whether one of the others overlaps it, and inside: whether one holds all of it."""
    held = others.select("lo", "hi")
    inside = covered(files, F.col("lo"), held, F.col("hi")).withColumnRenamed("covered", "inside")
    # One of the spans that begin before a file's end reaches beyond its beginning.
    begins = held.select(low(F.col("lo")).alias("__at"), F.lit(1).alias("__kind"), high(F.col("hi")).alias("__end"), F.lit(None).cast(inside.schema).alias("__row"))
    asks = inside.select(high(F.col("hi")).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(begins.schema["__end"].dataType).alias("__end"), F.struct(*inside.columns).alias("__row"))
    both = begins.unionByName(asks).withColumn("__no", F.monotonically_increasing_id())
    swept = running_max(both, ["__at", "__kind", "__no"], "__end", "__reach").where("__row IS NOT NULL").select("__row.*", "__reach")
    return swept.withColumn("meets", F.coalesce(F.col("__reach") > low(F.col("lo")), F.lit(False))).drop("__reach")


def admit(committed: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming files (path, lo, hi, ...) with action, given those committed: skip (it lies in a committed file or in
    another of the batch), dedup (it overlaps one: its range is to be deleted first) or add.

    Of equal ranges in a batch the first path stays; of two that overlap in part, the one that begins
    later is to be deduplicated. A file without any bound can't be compared and is added.
    """
    known = incoming.where("lo IS NOT NULL OR hi IS NOT NULL")
    ordered = known.withColumns({"__lo": low(F.col("lo")), "__hi": high(F.col("hi"))})
    # By beginning, then the longest first: a file lies in another one if an earlier one reaches as far.
    longest = running_max(ordered, ["__lo", F.desc("__hi"), "path"], "__hi", "__reach")
    apart = longest.where("__reach IS NULL OR __reach < __hi").drop("__reach")
    chain = running_max(apart, ["__lo", "path"], "__hi", "__reach").withColumn("__partly", F.coalesce(F.col("__reach") > F.col("__lo"), F.lit(False)))
    judged = meeting(chain.select(*incoming.columns, "__partly"), committed.where("lo IS NOT NULL OR hi IS NOT NULL"))
    action = F.when(F.col("inside"), "skip").when(F.col("meets") | F.col("__partly"), "dedup").otherwise("add")
    acted = judged.select("path", action.alias("action"))
    return incoming.join(acted, "path", "left").select(*[incoming[c] for c in incoming.columns], F.coalesce("action", F.when(incoming["lo"].isNull() & incoming["hi"].isNull(), "add").otherwise("skip")).alias("action"))


def replaced(table: DataFrame, rows: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """The table after the admitted files: what it held in a range of a dedup file is deleted, then the files' rows are added.

    rows: the table's columns and path; plan: ``admit``'s result. Where two files of the batch share
    keys, the row of the file that begins later stays.
    """
    ranges = plan.where("action = 'dedup'").select("lo", "hi")
    kept = covered(table, F.col(key), ranges).where("NOT covered").drop("covered")
    of = plan.where("action <> 'skip'").select("path", low(F.col("lo")).alias("__lo"))
    named = rows.join(of, "path")
    newest = named.groupBy(key).agg(F.max_by(F.struct(*table.columns), F.struct("__lo", "path")).alias("__row"))
    return kept.select(*table.columns).unionByName(newest.select("__row.*").select(*table.columns))


def orphans(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stored files that no manifest names."""
    return listing.join(manifest.select("path"), "path", "left_anti")
