"""Data-quality rules in one aggregate, policies that split rows, profiles and scores."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Outcome:
    passed: DataFrame
    failed: DataFrame
    report: DataFrame


#: What a rule may say of itself (fixed values).
SEVERITIES, ACTIONS, THRESHOLDS = ("info", "warning", "error", "critical"), ("log", "quarantine", "reject", "alert", "block"), ("percentage", "count")


def checked_rule(rule: dict) -> dict:
    """The rule with its severity and action filled in; unknown ones raise."""
    rule = {"severity": "warning", "action": "log"} | rule
    for key, allowed in (("severity", SEVERITIES), ("action", ACTIONS), ("threshold_type", THRESHOLDS)):
        if rule.get(key) is not None and rule[key] not in allowed:
            raise ValueError(f"{key} must be one of {allowed}, not {rule[key]!r}")
    return rule


def row_flag(rule: dict, number: int = 0) -> Column | None:
    """Whether a row breaks the rule (never null; a null value passes unless nulls are the rule), None for rules on aggregates."""
    kind, c = rule["type"], F.col(rule["column"]) if "column" in rule else None
    if kind in ("null_ratio_check", "null_check"):
        return c.isNull()
    if kind == "range_check":
        sides = [c < F.lit(rule["min"]) if rule.get("min") is not None else None, c > F.lit(rule["max"]) if rule.get("max") is not None else None]
        sides = [s for s in sides if s is not None]
        bad = sides[0] | sides[1] if len(sides) == 2 else sides[0] if sides else F.lit(False)
    elif kind in ("regex_check", "regex"):
        bad = ~c.rlike(rule["pattern"])
    elif kind == "enum_check":
        allowed = rule.get("allowed") or rule.get("allowed_values") or []
        bad = ~c.isin(list(allowed)) if allowed else F.lit(False)
    elif kind == "custom_sql":
        bad = ~F.expr(rule["expression"])
    elif kind == "referential_integrity":
        bad = F.col(_reference_flag(number))
    elif kind in ("freshness_check", "freshness", "row_count_match", "uniqueness"):
        return None
    else:
        raise ValueError(f"unknown rule {kind!r}")
    return F.coalesce(bad, F.lit(False))


def _reference_flag(number: int) -> str:
    return f"__missing_{number}"


def with_references(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds a flag per foreign-key rule by a left join with its distinct keys; Spark picks the join."""
    for i, rule in enumerate(rules):
        if rule["type"] == "referential_integrity":
            keys = rule["reference"].select(F.col(rule.get("reference_column", rule["column"])).alias("__key")).where("__key IS NOT NULL").distinct()
            df = df.join(keys, F.col(rule["column"]) == F.col("__key"), "left").withColumn(_reference_flag(i), F.col(rule["column"]).isNotNull() & F.col("__key").isNull()).drop("__key")
    return df


def _violated(i: int, rule: dict, now: datetime | None) -> Column:
    kind, n, bad = rule["type"], F.col("total"), F.col(f"failing_{i}")
    if rule.get("threshold_type"):
        most = F.lit(float(rule.get("threshold_value", 0)))
        return (bad > most) if rule["threshold_type"] == "count" else (n > 0) & (bad * 100 / F.greatest(n, F.lit(1)) > most)
    if kind == "null_ratio_check":
        return (n > 0) & (bad / F.greatest(n, F.lit(1)) > F.lit(float(rule.get("max_ratio", rule.get("threshold", 0.0)))))
    if kind in ("freshness_check", "freshness"):
        return F.coalesce(F.lit(now) - F.col(f"latest_{i}") > F.make_dt_interval(secs=F.lit(rule.get("max_age_seconds", 3600))), F.lit(False))
    if kind == "row_count_match":
        want = rule.get("expected")
        return F.abs(n - want) / want > F.lit(rule.get("threshold", 0.02)) if want else F.lit(False)
    return bad > 0


def report(df: DataFrame, rules: list[dict], now: datetime | None = None) -> DataFrame:
    """rule, type, total, failing, violated: every rule from one pass over df.

    A rule with a threshold_type is violated above threshold_value rows, or per cent of them.
    """
    return _report(with_references(df, rules), rules, now)


def _report(df: DataFrame, rules: list[dict], now: datetime | None) -> DataFrame:
    """The report on rows that have the flags of their references."""
    aggregates = [F.count("*").alias("total")]
    for i, rule in enumerate(rules):
        flag = row_flag(rule, i)
        if rule["type"] in ("freshness_check", "freshness"):
            aggregates += [F.max(rule["column"]).cast("timestamp").alias(f"latest_{i}"), F.lit(0).cast("long").alias(f"failing_{i}")]
        elif rule["type"] == "uniqueness":
            columns = rule.get("columns") or [rule["column"]]
            aggregates.append((F.count("*") - F.count_distinct(F.struct(*columns))).alias(f"failing_{i}"))
        else:
            aggregates.append(F.count_if(flag if flag is not None else F.lit(False)).alias(f"failing_{i}"))
    one = df.agg(*aggregates)
    rows = [F.struct(F.lit(i).alias("rule"), F.lit(r["type"]).alias("type"), "total", F.col(f"failing_{i}").alias("failing"), _violated(i, r, now).alias("violated")) for i, r in enumerate(rules)]
    return one.select(F.inline(F.array(*rows)))


def apply(df: DataFrame, policy: dict, now: datetime | None = None) -> Outcome:
    """Splits rows by {"rules": [...], "on_fail": block | alert | continue}.

    block: rows that break a row rule fail; a violated aggregate rule fails every row. alert: all
    rows pass, flagged ones are returned as failed too. continue: all rows pass.
    """
    rules, mode = policy["rules"], policy.get("on_fail", "block")
    if mode not in ("block", "alert", "continue"):
        raise ValueError(f"unknown policy {mode!r}")
    joined = with_references(df, rules)  # once, for the report and for the rows
    found = _report(joined, rules, now)
    flags = [f for f in (row_flag(r, i) for i, r in enumerate(rules)) if f is not None]
    flagged = F.lit(False)
    for f in flags:
        flagged = flagged | f
    checked = joined.withColumn("__bad", flagged)
    columns = df.columns
    if mode == "block":
        aggregate = [i for i, r in enumerate(rules) if row_flag(r, i) is None]
        if aggregate:
            broken = found.where(F.col("rule").isin(aggregate)).agg(F.coalesce(F.bool_or("violated"), F.lit(False)).alias("__all"))
            checked = checked.crossJoin(F.broadcast(broken)).withColumn("__bad", F.col("__bad") | F.col("__all"))
        return Outcome(checked.where("NOT __bad").select(*columns), checked.where("__bad").select(*columns), found)
    bad = checked.where("__bad") if mode == "alert" else checked.where("false")
    return Outcome(df, bad.select(*columns), found)


def quarantined(failed: DataFrame, batch_id: str) -> DataFrame:
    """Failed rows as JSON text with the batch they came from."""
    return failed.select(F.to_json(F.struct("*")).alias("row"), F.lit(batch_id).alias("_batch_id"))


def by_action(df: DataFrame, rules: list[dict], now: datetime | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that pass, rows that don't, and the report with severity and action, where every rule has an action of its own.

    block fails the whole batch if its rule is violated; quarantine and reject fail the rows
    that break theirs; alert and log let them pass.
    """
    rules = [checked_rule(r) for r in rules]
    of = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(i), F.struct(F.lit(r["severity"]).alias("severity"), F.lit(r["action"]).alias("action")))])
    marked = with_references(df, rules)
    found = _report(marked, rules, now).withColumn("of", of[F.col("rule")]).select("rule", "type", "total", "failing", "violated", "of.severity", "of.action")
    bad = F.lit(False)
    for i, r in enumerate(rules):
        if r["action"] in ("quarantine", "reject") and (flag := row_flag(r, i)) is not None:
            bad = bad | flag
    blocked = found.where("action = 'block'").agg(F.coalesce(F.bool_or("violated"), F.lit(False)).alias("__all"))
    marked = marked.withColumn("__bad", bad).join(F.broadcast(blocked)).withColumn("__bad", F.col("__bad") | F.col("__all"))
    return marked.where("NOT __bad").select(*df.columns), marked.where("__bad").select(*df.columns), found


def profile(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """Per column: nulls, distinct values, least, most, and for numbers mean, median and deviation, in one pass.

    Distinct values and medians are estimates that merge, unless exact: that expands every row by
    the columns and holds a column's values in one task.
    """
    kinds = dict(df.dtypes)
    aggregates, rows = [F.count("*").alias("total")], []
    distinct = F.count_distinct if exact else F.approx_count_distinct
    median = F.median if exact else lambda x: F.percentile_approx(x, 0.5)
    for i, c in enumerate(columns):
        number = kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))
        x = F.col(c).cast("double") if number else F.lit(None).cast("double")
        aggregates += [F.count_if(F.col(c).isNull()).alias(f"n{i}"), distinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
        aggregates += [F.avg(x).alias(f"avg{i}"), median(x).alias(f"med{i}"), F.stddev(x).alias(f"dev{i}")]
        rows.append(F.struct(F.lit(c).alias("column"), "total", *(F.col(f"{k}{i}").alias(v) for k, v in (("n", "nulls"), ("d", "distinct"), ("lo", "least"), ("hi", "most"), ("avg", "mean"), ("med", "median"), ("dev", "deviation")))))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


#: Of sketches: registers of the distinct counts as a power of 2 (relative error about 1.04 / sqrt(2^12)), and the size of quantile sketches (rank error about 1 %).
LG_K, QUANTILES = 12, 400


def sketched(df: DataFrame, columns: list[str]) -> DataFrame:
    """A mergeable profile of a batch: a row a column with counts, bounds, sums, and sketches of distinct values and quantiles, in one pass."""
    kinds = dict(df.dtypes)
    aggregates, rows = [F.count("*").alias("total")], []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double") if _number(kinds[c]) else F.lit(None).cast("double")
        of = {
            "nulls": F.count_if(F.col(c).isNull()), "least": F.min(c).cast("string"), "most": F.max(c).cast("string"), "low": F.min(x), "high": F.max(x), "numbers": F.count(x), "sum": F.sum(x), "squares": F.sum(x * x),
            "distinct": F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LG_K)), "quantiles": F.kll_sketch_agg_double(x, F.lit(QUANTILES)),
        }
        aggregates += [a.alias(f"{k}{i}") for k, a in of.items()]
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(_number(kinds[c])).alias("number"), "total", *[F.col(f"{k}{i}").alias(k) for k in of]))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _number(kind: str) -> bool:
    return kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))


def merged(profiles: DataFrame) -> DataFrame:
    """Profiles of batches as one profile, of the same columns: it can be merged again. Texts' bounds compare as text, numbers' as numbers."""
    sums = [F.sum(c).alias(c) for c in ("total", "nulls", "numbers", "sum", "squares")]
    by_number = lambda f, text, x: F.when(F.first("number"), f(F.struct(x, text))[text]).otherwise(f(text))
    found = profiles.groupBy("column").agg(
        F.first("number").alias("__number"), *sums, by_number(F.min, "least", "low").alias("least"), by_number(F.max, "most", "high").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )
    return found.withColumnRenamed("__number", "number").select(*profiles.columns)


def described(profiles: DataFrame) -> DataFrame:
    """A merged profile in words: column, total, nulls, distinct, least, most, and for numbers mean, median and deviation."""
    n = F.col("numbers")
    variance = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("squares") - F.col("sum") * F.col("sum") / n) / (n - 1)))
    median = F.when(n > 0, F.kll_sketch_get_quantile_double(F.col("quantiles"), F.lit(0.5)))
    return profiles.select("column", "total", "nulls", F.hll_sketch_estimate("distinct").alias("distinct"), "least", "most", F.when(n > 0, F.col("sum") / n).alias("mean"), median.alias("median"), F.sqrt(variance).alias("deviation"))


def recommended(df: DataFrame, columns: list[str], few: int = 10, exact: bool = False) -> DataFrame:
    """(column, rule): rules that a table meets: null_check without nulls, uniqueness where no value comes twice, enum_check of few values, range_check of numbers."""
    kinds, found = dict(df.dtypes), profile(df, columns, exact)
    number = F.col("column").isin([c for c in columns if kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))])
    some = F.col("total") > 0
    rules = {"null_check": some & (F.col("nulls") == 0), "uniqueness": some & (F.col("distinct") == F.col("total")), "enum_check": some & (F.col("distinct") <= few), "range_check": some & number & F.col("least").isNotNull()}
    of = F.array_compact(F.array(*[F.when(c, r) for r, c in rules.items()]))
    return found.select("column", F.explode(of).alias("rule"))


def patterns(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The commonest shapes of a text column: letters as A or a, digits as 9."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(column).cast("string"), r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\d", "9")
    return top_values(df.where(F.col(column).isNotNull()).select(shape.alias("pattern")), "pattern", n)


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(n)


def score(violations: Column, policies: Column) -> Column:
    """100 less 20 for each violation a policy, between 0 and 100."""
    return F.greatest(F.lit(0.0), 100 - F.least(F.lit(100.0), F.coalesce(F.try_divide(violations, policies), F.lit(0.0)) * 20))


def scores(connections: DataFrame, policies: DataFrame, violations: DataFrame, results: DataFrame) -> DataFrame:
    """Every connection (connection_id) with its score, open violations and last check.

    policies: policy_id, connection_id, is_active; violations: policy_id, status; results: policy_id, executed_at.
    """
    of = policies.select("policy_id", "connection_id", "is_active")
    active = of.where("is_active").groupBy("connection_id").agg(F.count("*").alias("policies"))
    open_ = violations.where("status = 'active'").join(of, "policy_id").groupBy("connection_id").agg(F.count("*").alias("violations"))
    last = results.join(of, "policy_id").groupBy("connection_id").agg(F.max("executed_at").alias("last_check"))
    all_ = connections.select("connection_id").join(active, "connection_id", "left").join(open_, "connection_id", "left").join(last, "connection_id", "left")
    n = F.coalesce("violations", F.lit(0))
    return all_.select("connection_id", F.round(score(n, F.coalesce("policies", F.lit(0))), 1).alias("score"), n.alias("violations"), "last_check")


def dashboard(policies: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: policies, active ones, connections with issues, violations by state, overall score and trend.

    policies: policy_id, connection_id, is_active, severity; violations: policy_id, status.
    """
    of = policies.agg(F.count("*").alias("policies"), F.count_if("is_active").alias("active_policies"))
    open_ = F.col("status") == "active"
    found = violations.join(policies.select("policy_id", "connection_id", "severity"), "policy_id").agg(
        F.count("*").alias("violations"), F.count_if(open_).alias("active_violations"), F.count_if(open_ & (F.col("severity") == "critical")).alias("critical_violations"),
        F.count_distinct(F.when(open_, F.col("connection_id"))).alias("connections_with_issues"),
    )
    trend = F.when(F.col("active_violations") > F.col("policies"), "degrading").when(F.col("active_violations") < F.col("policies") / 2, "improving").otherwise("stable")
    return of.join(F.broadcast(found)).withColumns({"score": score(F.col("active_violations"), F.col("active_policies")), "trend": trend})


def top_failing(policies: DataFrame, violations: DataFrame, n: int = 10) -> DataFrame:
    """The policies (policy_id, severity) with the most open violations."""
    counts = violations.where("status = 'active'").groupBy("policy_id").agg(F.count("*").alias("violations"))
    return policies.join(counts, "policy_id").select("policy_id", "severity", "violations").orderBy(F.desc("violations"), "policy_id").limit(n)
