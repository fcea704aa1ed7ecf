"""Secret scan by ownership: what looks like a credential, and whether one owner or everybody has it.

One pass over the texts writes a narrow table: the spans of three base patterns and of free runs
that look like keys, each with a digest of its value; the values themselves are not stored. Digests
are then counted corpus-wide, first per repository, then per owner: a value that more than ``OWNERS``
owners have is a copied example, all others are owner-specific. A base span always stays; a free run
becomes a span of kind ``owned`` where it looks live, no base span touches it and its value is
owner-specific. Only DataFrame functions are used.

Rows of one value are reduced three times before they meet (repository, owner, value), so a value
that a third of all rows hold costs a task a row for each of its owners at most. Where the counted
values are too many to broadcast, they are joined by digest, and Spark splits skewed digests.

Defined cases: a null text counts as empty and has no span; a null owner or repository is one of its own;
repeated rows and rows without an id are rows like others; an empty table gives an empty result; other columns
of the input play no part, whatever their names. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import small, stored

#: Kinds of spans in the order that breaks ties (fixed values), and what the method adds.
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "owned"]
#: Base patterns (fixed values): Java's case folding is that of ASCII. Runs of access and hex that are too short are no matches,
#: which finds what dropping them finds: a match reaches from its start to the end of its run.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: Runs of letters and digits that may be keys.
FREE = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}"
#: Owners beyond which a value is a copied example.
OWNERS = 3
#: Different characters and runs of digits that a free value needs to look live.
VARIETY, DIGIT_RUNS = 12, 2

SPAN = "struct<start:int,kind:int,stop:int,live:boolean,digest:binary>"


def _matches(text: Column, pattern: str, kind: int, value, live) -> Column:
    """Array of spans (start, kind, stop, live, digest) of all leftmost matches that do not overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    length = lambda x: F.length(x).cast("int")
    # Gaps and matches alternate, so a match starts where all before it ends.
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("match"))
    none = F.lit(None).cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array().cast(f"array<{SPAN}>")).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + length(x["gap"])
        stop = begin + length(x["match"])
        secret = value(x["match"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), live(secret).alias("live"), F.unhex(F.sha2(secret, 256)).alias("digest"))
        return F.struct(stop.alias("at"), F.when(F.length(secret) >= 6, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(pairs, start, step)["spans"]
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def varied(value: Column, least: int = VARIETY) -> Column:
    return F.size(F.array_distinct(F.split(value, ""))) >= least


def looks_live(value: Column) -> Column:
    """Lower and upper letters, digits in several runs, many different characters."""
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & (F.regexp_count(value, F.lit("[0-9]+")) >= DIGIT_RUNS) & varied(value)


def spans_of(text: Column) -> Column:
    """All spans of a text, base and free."""
    text = F.coalesce(text, F.lit(""))
    whole, some = (lambda m: m), (lambda v: varied(v, 6))
    return F.concat(
        _matches(text, ASSIGN, 0, lambda m: F.regexp_extract(m, ASSIGN, 2), lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & varied(v, 6)),
        _matches(text, ACCESS, 1, whole, some),
        _matches(text, HEX, 2, whole, some),
        _matches(text, FREE, 3, whole, looks_live),
    )


def written(spans: Column) -> Column:
    """kind:start:end of every span, by start, then kind, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    text = lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), text), ",")


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories): a row for each different value of candidates (digest, owner, repository)."""
    each = found.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one"))
    owned = each.groupBy("digest", "owner").agg(F.count("one").alias("repositories"))
    return owned.groupBy("digest").agg(F.count("repositories").alias("owners"), F.sum("repositories").alias("repositories"))


def located(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """id, owner, repository, number (a row's own) and spans: the one pass over the texts."""
    rows = docs.select(F.col(id_col).alias("id"), owner.alias("owner"), repository.alias("repository"), F.col(text_col).alias("text"))
    spans = rows.select("id", "owner", "repository", spans_of(F.col("text")).alias("spans"))
    return stored(spans.withColumn("number", F.monotonically_increasing_id()), "secret-spans")


def scan(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text", max_owners: int = OWNERS) -> DataFrame:
    """A row for each row of docs: id, n_assign, n_access, n_hex, n_owned, n_live, n_copied (long), base and spans (text).

    n_live counts base spans whose value looks live and is owner-specific, n_copied those whose value is a copied example.
    """
    rows = located(docs, id_col, text_col, owner, repository)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    asked = F.filter("spans", lambda s: (s["kind"] < len(BASE)) | (s["live"] & apart(s)))
    candidates = rows.select("number", "owner", "repository", F.explode(asked).alias("span")).select("number", "owner", "repository", "span.*")
    counted = stored(ownership(candidates.select("digest", "owner", "repository")), "secret-owners")
    copied = F.col("owners") > max_owners
    judged = candidates.join(small(counted), "digest")
    kept = F.when((F.col("kind") == len(BASE)) & ~copied, F.struct("start", "kind", "stop", "live", "digest"))
    is_base = F.col("kind") < len(BASE)
    of = judged.groupBy("number").agg(F.collect_list(kept).alias("added"), F.count_if(is_base & F.col("live") & ~copied).alias("n_live"), F.count_if(is_base & copied).alias("n_copied"))
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    # Rows without a candidate need no count.
    some = F.size(asked) > 0
    met = rows.where(some).join(of, "number").select("id", base.alias("base"), "added", "n_live", "n_copied")
    none = rows.where(~some).select("id", base.alias("base"), F.array().cast(f"array<{SPAN}>").alias("added"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    out = met.unionByName(none)
    counts = [count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return out.select("id", *counts, F.size("added").cast("long").alias("n_owned"), "n_live", "n_copied", written(F.col("base")).alias("base"), written(F.concat("base", "added")).alias("spans"))
