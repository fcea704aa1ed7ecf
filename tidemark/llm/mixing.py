"""Mixing sources to target weights.

Every source gets a share of a token budget; within a source, documents are taken in the
order of a hash of their id. The prefix sums that find the cut are distributed: each source
is range-split by the leading hex digits of the hash, the sums of these ranges are small,
and only within a range does a window run. Rows of one id and size that are more than ``HOT`` (null
ids above all) go through a range as one; their own places are counted in deals of a bounded
number of rows. No task sees a whole source, or all rows of an id.

Defined cases: null text has size 0; the null source is a source of its own, last in order;
repeated rows are taken independently, ordered by (hash of id, id, size); sources of size 0
get target 0; an empty table gives an empty result; other columns are carried along, but the three
that are added must be free, else it raises.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import small, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Rows that one prefix window should hold, about.
RANGE_ROWS = 20_000
#: Rows of one id and size beyond which they are counted in deals.
HOT = 5_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds rank and target to (source, source_size, ...): one row per source, so small windows.

    The budget is share times all sizes; no target exceeds most times its source, and the excess
    goes to the others by weight until none is above. With sources sorted by cap / weight, the
    level of the first one that its cap does not bind is the common level.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = totals.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    earlier = everything.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    level = ranked.withColumn("level", left / weight_left)
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))
    common = F.min(free).over(everything)["level"]
    return level.withColumn("target", F.least("cap", F.coalesce(common * F.col("weight"), "cap"))).drop("level", "cap", "weight")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size") -> DataFrame:
    """docs with source_size, target and taken; all other columns pass through. docs is stored once, so it should be narrow.

    taken is size times the whole epochs of its source, and once more (in part for the one
    document at the cut) up to the rest of the source's budget in hash order.
    """
    if clash := {"source_size", "target", "taken"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    named = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).alias("size"), key.alias("key"))
    named = stored(named.withColumn("number", F.monotonically_increasing_id()), "mix-rows")
    sums = stored(named.groupBy("source", F.substring("key", 1, 6).alias("fine")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "mix-sums")
    totals = sums.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("rows").alias("rows"))
    plan = stored(targets(totals), "mix-targets")
    largest = plan.agg(F.max("rows")).first()[0] or 1
    digits = min(6, max(1, math.ceil(math.log(max(1, largest / RANGE_ROWS), 16))))
    bucket = F.substring("fine", 1, digits)
    ranges = sums.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    right = ranges.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("rank", F.col("source").alias("s"), F.col("bucket").alias("b"), "range_start", "source_size", "target")

    hot = stored(named.groupBy("source", "id", "size", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "mix-hot")
    some = not hot.isEmpty()
    items = named.withColumn("weight", F.col("size"))
    if some:
        items = items.join(small(hot.select("source", "id", "size")), _same(items, hot), "left_anti")
        items = items.unionByName(hot.select("source", "id", "size", "key", (F.col("size") * F.col("n")).alias("weight")), allowMissingColumns=True)
    items = items.withColumn("bucket", F.substring("key", 1, digits))
    joined = items.join(right, items["source"].eqNullSafe(right["s"]) & (items["bucket"] == right["b"]))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("range_start") + F.coalesce(F.sum("weight").over(inside), F.lit(0))
    placed = joined.select("row", "number", "source", "id", "size", "source_size", "target", start.alias("start"))
    out = placed.where("number IS NOT NULL").select("row", "size", "source_size", "target", "start")
    if some:
        out = out.unionByName(_dealt(named, placed.where("number IS NULL").select("source", "id", "size", "source_size", "target", "start"), hot))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return out.select("row", "source_size", "target", taken.cast("long").alias("taken")).select("row.*", "source_size", "target", "taken")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"]) & a["id"].eqNullSafe(b["id"]) & a["size"].eqNullSafe(b["size"])


def _dealt(named: DataFrame, groups: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of hot groups with their own starts: deals by a hash of the row's number, then the place in the deal."""
    groups = stored(groups.join(hot.select("source", "id", "size", "n"), _same(groups, hot)).select(groups["source"], groups["id"], groups["size"], "source_size", "target", "start", "n").withColumn("group", F.monotonically_increasing_id()), "mix-groups")
    deal = F.pmod(F.xxhash64("number"), F.ceil(F.col("n") / RANGE_ROWS)).cast("int")
    rows = named.join(small(groups), _same(named, groups)).select("row", "number", named["size"], "source_size", "target", "start", "group", deal.alias("deal"))
    counts = rows.groupBy("group", "deal").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("group").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = rows.join(counts.select("group", "deal", before.alias("before")), ["group", "deal"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("group", "deal").orderBy("number")) - 1
    return met.select("row", "size", "source_size", "target", (F.col("start") + place * F.col("size")).alias("start"))


def drawn(mixed: DataFrame, text_col: str = "text", size_col: str = "size") -> DataFrame:
    """The documents that a mix takes, repeated by epoch; the one at a cut keeps its first
    words, joined by single spaces.

    Columns as in mixed. Rows of taken 0 are not in the mix.
    """
    whole = F.floor(F.col("taken") / F.greatest(F.col(size_col), F.lit(1)))
    part = F.col("taken") - whole * F.col(size_col)
    copies = F.sequence(F.lit(1), F.greatest(F.lit(1), whole + F.when(part > 0, 1).otherwise(0)).cast("int"))
    names = mixed.columns
    rows = mixed.where("taken > 0").select(F.struct("*").alias("row"), whole.alias("whole"), part.alias("part"), F.explode(copies).alias("copy"))
    found = F.regexp_extract_all(F.col(f"row.`{text_col}`"), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(found, F.lit(1), F.col("part").cast("int")), " ")
    text = F.when(F.col("copy") <= F.col("whole"), F.col(f"row.`{text_col}`")).otherwise(cut)
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names])
