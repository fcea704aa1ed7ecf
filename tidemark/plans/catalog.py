"""Queries over the test tables, one per operator, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import steps
from ..functions.types import compatible, widened
from ..operators import apply, changes, metrics, quality, ranges, schemas
from ..sources import clean, logs
from ..streaming import eventtime, runner
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def case(name: str, sql: str | None = None):
    """Registers f(t), t(table name) -> DataFrame, with its SQL."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def piped(name: str, table: str, keep: list[str], transforms: list[dict], sql: str, before: dict | None = None) -> None:
    """A query that runs steps over some columns of a table."""

    def f(t: Tables) -> DataFrame:
        df = t(table).select(*keep)
        return pipeline.run(df.withColumns({k: F.expr(v) for k, v in before.items()}) if before else df, {"transforms": transforms}).rows

    case(name, sql)(f)


NOW = datetime(2024, 6, 1)
NOW_SQL = "TIMESTAMP '2024-06-01 00:00:00'"

# -- steps ---------------------------------------------------------------------------------------
FLAGSHIP = {
    "transforms": [
        {"type": "cast", "column": "o_totalprice", "to_type": "double"},
        {"type": "mask", "column": "o_orderpriority", "strategy": "last4", "output_column": "priority"},
        {"type": "date_op", "column": "o_orderdate", "op": "year", "output_column": "order_year"},
        {"type": "expression", "expression": "CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'normal' END", "output_column": "band"},
    ]
}


@case(
    "flagship",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'normal' END AS band,
       repeat('*', length(o_orderpriority) - 4) || right(o_orderpriority, 4) AS priority, count(*) AS orders, round(sum(o_totalprice), 2) AS total
       FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 1000 AND 400000 GROUP BY 1, 2, 3""",
)
def flagship(t: Tables) -> DataFrame:
    rows = pipeline.run(t("orders"), FLAGSHIP).rows
    policy = {"rules": [{"type": "enum_check", "column": "o_orderstatus", "allowed": ["O", "F"]}, {"type": "range_check", "column": "o_totalprice", "min": 1000, "max": 400000}], "on_fail": "block"}
    return quality.apply(rows, policy).passed.groupBy("order_year", "band", "priority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


piped("cast_types", "orders", ["o_orderkey", "o_orderstatus", "o_orderdate"], [
    {"type": "cast", "column": "o_orderkey", "to_type": "int", "output_column": "as_int"},
    {"type": "cast", "column": "o_orderkey", "to_type": "double", "output_column": "as_double"},
    {"type": "cast", "column": "o_orderkey", "to_type": "string", "output_column": "as_string"},
    {"type": "cast", "column": "o_orderdate", "to_type": "date", "output_column": "as_date"},
    {"type": "cast", "column": "o_orderstatus", "to_type": "long", "output_column": "as_long", "on_error": "null"},
    {"type": "cast", "column": "o_orderkey", "to_type": "boolean", "output_column": "as_bool"},
    {"type": "cast", "column": "o_orderstatus", "to_type": "long", "output_column": "kept", "on_error": "keep"},
], """SELECT *, CAST(o_orderkey AS INTEGER) AS as_int, CAST(o_orderkey AS DOUBLE) AS as_double, CAST(o_orderkey AS VARCHAR) AS as_string,
      CAST(o_orderdate AS DATE) AS as_date, TRY_CAST(o_orderstatus AS BIGINT) AS as_long, CAST(o_orderkey AS BOOLEAN) AS as_bool, o_orderstatus AS kept
      FROM (SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders)""")  # fmt: skip
_S = lambda op, out, **p: {"type": "string_op", "column": "c_name", "op": op, "output_column": out, "params": p}
piped("string_ops", "customer", ["c_custkey", "c_name"], [
    _S("upper", "up"), _S("lower", "low"), _S("trim", "tr"), _S("ltrim", "lt"), _S("rtrim", "rt"), _S("substring", "sub", start=2, length=5),
    _S("substring", "sub0", start=0, length=4), _S("replace", "rep", **{"from": "o", "to": "0"}), _S("concat", "cat", suffix="-x"), _S("lpad", "lp", length=25, pad="#"), _S("rpad", "rp", length=4, pad="#"),
], """SELECT c_custkey, c_name, upper(c_name) AS up, lower(c_name) AS low, trim(c_name) AS tr, ltrim(c_name) AS lt, rtrim(c_name) AS rt, substring(c_name, 2, 5) AS sub,
      substring(c_name, 0, 4) AS sub0, replace(c_name, 'o', '0') AS rep, c_name || '-x' AS cat, lpad(c_name, 25, '#') AS lp, rpad(c_name, 4, '#') AS rp FROM customer""")  # fmt: skip
piped("math_op", "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"], [
    {"type": "math_op", "expression": "l_extendedprice * (1 - l_discount) * (1 + l_tax)"},
    {"type": "math_op", "expression": "l_extendedprice / (l_linenumber - 1)", "column": "ratio", "on_error": "null"},
], """SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS math_result, CASE WHEN l_linenumber <> 1 THEN l_extendedprice / (l_linenumber - 1) END AS ratio
      FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax FROM lineitem)""")  # fmt: skip
_D = lambda op, out, **p: {"type": "date_op", "column": "ts", "op": op, "output_column": out, "params": p}
piped("date_parts", "events", ["event_id", "ts"], [_D(o, o[0:2] + "_p") for o in ("year", "day", "hour", "epoch")] + [_D("month", "mon"), _D("minute", "minu")],
      "SELECT event_id, ts, year(ts) AS ye_p, day(ts) AS da_p, hour(ts) AS ho_p, epoch_us(ts) / 1e6 AS ep_p, month(ts) AS mon, minute(ts) AS minu FROM events")
piped("date_format", "events", ["event_id", "ts"], [_D("date_format", "f1", format="%Y/%m/%d %H:%M"), _D("date_format", "f2", format="yyyy-MM-dd"), _D("date_format", "f3", format="%d.%m.%y at %H")],
      "SELECT event_id, ts, strftime(ts, '%Y/%m/%d %H:%M') AS f1, strftime(ts, '%Y-%m-%d') AS f2, strftime(ts, '%d.%m.%y at %H') AS f3 FROM events")
piped("date_add", "events", ["event_id", "ts"], [_D("date_add", "a1"), _D("date_add", "a2", value=3, unit="month"), _D("date_add", "a3", value=-5, unit="hour")],
      "SELECT event_id, ts, ts + INTERVAL 1 DAY AS a1, ts + INTERVAL 3 MONTH AS a2, ts - INTERVAL 5 HOUR AS a3 FROM events")
piped("date_diff", "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate"], [{"type": "date_op", "column": "l_shipdate", "op": "date_diff", "output_column": f"d_{u}", "params": {"unit": u, "other": "base"}} for u in ("day", "month", "year", "hour")],
      """SELECT l_orderkey, l_linenumber, l_shipdate, base, date_diff('day', l_shipdate, base) AS d_day, date_diff('month', l_shipdate, base) AS d_month, date_diff('year', l_shipdate, base) AS d_year, date_diff('hour', l_shipdate, base) AS d_hour
         FROM (SELECT *, TIMESTAMP '1999-03-05 13:30:00' AS base FROM lineitem)""", {"base": "timestamp '1999-03-05 13:30:00'"})  # fmt: skip
piped("json_extract", "events", ["event_id", "props"], [{"type": "json_extract", "column": "props", "path": "$.k", "output_type": "long", "output_column": "k"}, {"type": "json_extract", "column": "props", "json_path": "$.none", "output_column": "none"}],
      "SELECT event_id, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
piped("json_flatten_inline", "events", ["event_id", "props"], [{"type": "json_flatten_inline", "column": "props", "json_schema": {"k": "int", "z": "string"}, "keep_original": False}],
      "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS props_k, json_extract_string(props, '$.z') AS props_z FROM events")


@case("json_flatten_child", "SELECT l_orderkey, l_linenumber AS line, l_partkey AS part FROM lineitem")
def json_flatten_child(t: Tables) -> DataFrame:
    item = F.to_json(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")))
    arrays = t("lineitem").groupBy("l_orderkey").agg(F.concat(F.lit('{"items":['), F.concat_ws(",", F.collect_list(item)), F.lit("]}")).alias("doc"))
    step = {"type": "json_flatten_child", "id": "items", "column": "doc", "array_path": "$.items", "parent_keys": ["l_orderkey"], "output_columns": {"n": "line", "p": "part"}, "json_schema": {"n": "int", "p": "long"}}
    return pipeline.run(arrays, {"transforms": [step]}).children["items"]


_M = lambda s, out, c="c_name": {"type": "mask", "column": c, "strategy": s, "output_column": out}
piped("mask_all", "customer", ["c_custkey", "c_name"], [_M("last4", "l4"), _M("first4", "f4"), _M("hash", "hs"), _M("email", "em", "email"), _M("email", "noat"), _M("null", "nl"), _M("full", "fu"), _M("last4", "short", "seg")],
      """SELECT c_custkey, c_name, c_name || '@mail.example' AS email, 'ABCD' AS seg, repeat('*', length(c_name) - 4) || right(c_name, 4) AS l4, left(c_name, 4) || repeat('*', length(c_name) - 4) AS f4, sha256(c_name) AS hs,
         left(c_name, 1) || '***@mail.example' AS em, repeat('*', length(c_name)) AS noat, CAST(NULL AS VARCHAR) AS nl, repeat('*', length(c_name)) AS fu, 'ABCD' AS short FROM customer""",
      {"email": "concat(c_name, '@mail.example')", "seg": "'ABCD'"})
_E = lambda e, out, lang="sel": {"type": "expression", "expression": e, "language": lang, "output_column": out}
piped("expression_sql", "orders", ["o_orderkey", "o_totalprice"], [_E("CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'normal' END", "band", "spark_sql"), _E("row_number() over (partition by o_orderkey % 10 order by o_orderkey)", "rn", "spark_sql")],
      "SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'normal' END AS band, CAST(row_number() OVER (PARTITION BY o_orderkey % 10 ORDER BY o_orderkey) AS INTEGER) AS rn FROM orders")
piped("sel_language", "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"], [
    _E("IF(o_totalprice > 100000, IF(o_orderstatus = 'O', 'open)', 'big,'), 'small')", "nested"), _E("IN(o_orderstatus, 'O', UPPER('f'))", "is_in"), _E("NOT_IN(o_orderstatus, 'O')", "is_not"),
    _E("IS_NULL(COALESCE(NULLIF(o_orderstatus, 'O'), NULL))", "nul"), _E("IS_NOT_NULL(o_orderstatus) AND o_orderstatus IN ('O', 'P')", "both"), _E("IF(o_orderstatus = 'F', o_totalprice, 0) + 1", "fee"), _E("(o_orderkey % 7) ^ 2", "sq"),
], """SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_totalprice > 100000 THEN CASE WHEN o_orderstatus = 'O' THEN 'open)' ELSE 'big,' END ELSE 'small' END AS nested, o_orderstatus IN ('O', 'F') AS is_in,
      o_orderstatus NOT IN ('O') AS is_not, nullif(o_orderstatus, 'O') IS NULL AS nul, o_orderstatus IN ('O', 'P') AS both, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END + 1 AS fee, power(o_orderkey % 7, 2) AS sq FROM orders""")  # fmt: skip


@case("udf_scalar", "SELECT p_partkey, p_retailprice * 2 AS doubled_result FROM part")
def udf_scalar(t: Tables) -> DataFrame:
    steps.register("doubled", lambda x: None if x is None else x * 2, "double")
    return pipeline.run(t("part").select("p_partkey", "p_retailprice"), {"transforms": [{"type": "udf", "function": "doubled", "args": ["p_retailprice"]}]}).rows.drop("p_retailprice")


@case("column_mapping", "SELECT c_custkey AS id, c_name AS full_name FROM customer")
def column_mapping(t: Tables) -> DataFrame:
    return pipeline.select_and_map(t("customer"), ["c_custkey", "c_name", "c_acctbal"], {"c_custkey": "id", "c_name": "full_name", "c_acctbal": None})


# -- data quality --------------------------------------------------------------------------------
_RULES = [
    {"type": "null_ratio_check", "column": "user_id", "max_ratio": 0.1}, {"type": "range_check", "column": "value", "min": 1, "max": 90},
    {"type": "regex_check", "column": "props", "pattern": "[0-4]"}, {"type": "enum_check", "column": "event_type", "allowed": ["click", "view"]},
    {"type": "freshness_check", "column": "ts", "max_age_seconds": 3600}, {"type": "row_count_match", "expected": 9000}, {"type": "uniqueness", "columns": ["user_id", "event_type"]},
]


@case(
    "dq_report",
    f"""SELECT r.rule, r.type, total, CAST(failing AS BIGINT) AS failing, violated FROM (SELECT count(*) AS total, count(*) FILTER (user_id IS NULL) AS a, count(*) FILTER (value < 1 OR value > 90) AS b, count(*) FILTER (NOT regexp_matches(props, '[0-4]')) AS c,
        count(*) FILTER (event_type NOT IN ('click', 'view')) AS d, {NOW_SQL} - max(ts) > INTERVAL 3600 SECOND AS e, count(*) - count(DISTINCT (user_id, event_type)) AS g FROM events),
        LATERAL (VALUES (0, 'null_ratio_check', a, a / total > 0.1), (1, 'range_check', b, b > 0), (2, 'regex_check', c, c > 0), (3, 'enum_check', d, d > 0), (4, 'freshness_check', 0, e), (5, 'row_count_match', 0, abs(total - 9000) / 9000 > 0.02), (6, 'uniqueness', g, g > 0)) r(rule, type, failing, violated)""",
)
def dq_report(t: Tables) -> DataFrame:
    return quality.report(t("events"), _RULES, NOW)


@case("dq_ref_integrity", "SELECT 0 AS rule, 'referential_integrity' AS type, count(*) AS total, count(*) FILTER (o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)) AS failing, count(*) FILTER (o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)) > 0 AS violated FROM orders")
def dq_ref_integrity(t: Tables) -> DataFrame:
    return quality.report(t("orders"), [{"type": "referential_integrity", "column": "o_custkey", "reference": t("customer").where("c_custkey % 5 <> 0"), "reference_column": "c_custkey"}])


_BAD = "(event_type NOT IN ('click', 'view', 'purchase') OR coalesce(value > 50, false))"
_NULLED = "(SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)"


def _policy(t: Tables, mode: str) -> quality.Outcome:
    rules = [{"type": "enum_check", "column": "event_type", "allowed": ["click", "view", "purchase"]}, {"type": "range_check", "column": "value", "max": 50}]
    return quality.apply(t("events").selectExpr("event_id", "event_type", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value"), {"rules": rules, "on_fail": mode})


case("dq_block_pass", f"SELECT * FROM {_NULLED} WHERE NOT {_BAD}")(lambda t: _policy(t, "block").passed)
case("dq_block_fail", f"SELECT * FROM {_NULLED} WHERE {_BAD}")(lambda t: _policy(t, "block").failed)
case("dq_alert", f"SELECT * FROM {_NULLED} WHERE {_BAD}")(lambda t: _policy(t, "alert").failed)
case("dq_continue", f"SELECT * FROM {_NULLED}")(lambda t: _policy(t, "continue").passed)


@case("dq_block_aggregate", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def dq_block_aggregate(t: Tables) -> DataFrame:
    out = quality.apply(t("events"), {"rules": [{"type": "row_count_match", "expected": 1}], "on_fail": "block"})
    return out.failed.groupBy("event_type").agg(F.count("*").alias("n"))


@case("quality_score", "SELECT user_id, greatest(0.0, 100 - least(100.0, count(*) FILTER (event_type = 'error') * 1.0 / count(DISTINCT event_type) * 20)) AS score FROM events GROUP BY user_id")
def quality_score(t: Tables) -> DataFrame:
    counts = t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("v"), F.count_distinct("event_type").alias("p"))
    return counts.select("user_id", quality.score(F.col("v"), F.col("p")).alias("score"))


@case("profile_columns", """SELECT 'p_size' AS "column", count(*) AS total, count(*) FILTER (p_size IS NULL) AS nulls, count(DISTINCT p_size) AS "distinct", CAST(min(p_size) AS VARCHAR) AS least, CAST(max(p_size) AS VARCHAR) AS most, round(avg(p_size), 6) AS mean, median(p_size) AS median, round(stddev_samp(p_size), 6) AS deviation FROM part
UNION ALL SELECT 'p_brand', count(*), count(*) FILTER (p_brand IS NULL), count(DISTINCT p_brand), min(p_brand), max(p_brand), NULL, NULL, NULL FROM part""")
def profile_columns(t: Tables) -> DataFrame:
    return quality.profile(t("part"), ["p_size", "p_brand"], exact=True).withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


case("top_values", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda t: quality.top_values(t("part"), "p_brand"))
case("quarantine", "SELECT CAST(event_id AS VARCHAR) AS event_id, 'b7' AS _batch_id FROM events WHERE event_type = 'error'")(lambda t: quality.quarantined(t("events").where("event_type = 'error'"), "b7").select(F.get_json_object("row", "$.event_id").alias("event_id"), "_batch_id"))
case("anomalies", "SELECT event_id FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS d FROM events GROUP BY 1) USING (event_type) WHERE abs(value - m) > 2 * d")(lambda t: metrics.anomalies(t("events"), "value", ["event_type"], 2.0).select("event_id"))

# -- change events -------------------------------------------------------------------------------
OP = "CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END"
LOG = f"(SELECT user_id, event_id, ts, value, event_type, {OP} AS op FROM events)"
LAST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM {LOG}) WHERE rn = 1)"


def log(t: Tables) -> DataFrame:
    return t("events").select("user_id", "event_id", "ts", "value", "event_type", F.expr(OP).alias("op"))


@case("event_id", """SELECT event_id, sha256('{"lsn": "' || event_id || '", "pk": {"user_id": ' || user_id || '}}') AS id FROM events""")
def event_id(t: Tables) -> DataFrame:
    pk = F.concat(F.lit('{"user_id": '), F.col("user_id").cast("string"), F.lit("}"))
    return t("events").select("event_id", changes.event_id(pk, F.col("event_id")).alias("id"))


@case("cdc_envelope", f"SELECT CAST(event_id AS VARCHAR) AS event_id, op, epoch_us(ts) // 1000 AS ts_ms, op <> 'c' AS has_before, op <> 'd' AS has_after FROM {LOG} WHERE event_id % 5 <> 0 OR op <> 'd'")
def cdc_envelope(t: Tables) -> DataFrame:
    image = F.to_json(F.struct("user_id", "value", "event_type"))
    e = log(t).select(F.col("event_id").cast("string").alias("event_id"), "op", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.when(F.col("op") != "c", image).alias("before"), F.when((F.col("op") != "d") | (F.col("event_id") % 5 == 0), image).alias("after"))
    good, _ = changes.split_valid(changes.from_wire(changes.to_wire(e)))
    return good.select("event_id", "op", "ts_ms", F.col("before").isNotNull().alias("has_before"), F.col("after").isNotNull().alias("has_after"))


@case("cdc_decode", f"SELECT event_id, user_id, value, event_type FROM {LOG}")
def cdc_decode(t: Tables) -> DataFrame:
    image = F.to_json(F.struct("user_id", "value", "event_type"))
    e = log(t).select("event_id", F.when(F.col("op") == "d", image).alias("before"), F.when(F.col("op") != "d", image).alias("after"))
    return changes.decode(e, "user_id bigint, value double, event_type string", ["event_id"])


case("cdc_compact", f"SELECT user_id, event_id, op, value FROM {LAST}")(lambda t: changes.compact(log(t), ["user_id"], ["event_id"]).select("user_id", "event_id", "op", "value"))
case("cdc_split", f"SELECT user_id, event_id, CASE WHEN op = 'd' THEN 'd' ELSE 'upsert' END AS kind FROM {LAST}")(lambda t: (lambda s: s[0].select("user_id", "event_id", F.lit("upsert").alias("kind")).unionByName(s[1].select("user_id", "event_id", F.lit("d").alias("kind"))))(changes.split(changes.compact(log(t), ["user_id"], ["event_id"]))))
case("cdc_rekey", f"SELECT user_id, event_id, op FROM {LOG} UNION ALL SELECT -user_id - 1, event_id, 'd' FROM {LOG} WHERE op = 'u' AND event_id % 3 = 0 AND user_id IS NOT NULL")(lambda t: changes.rekeyed(log(t).withColumn("old", F.when(F.col("event_id") % 3 == 0, -F.col("user_id") - 1)), "user_id", "old").select("user_id", "event_id", "op"))
case("apply_ledger", "SELECT DISTINCT event_id FROM events WHERE event_id % 4 <> 0")(lambda t: changes.unapplied(t("events").unionByName(t("events").where("event_id < 100")), t("events").where("event_id % 4 = 0")).select("event_id"))
case("tombstones", "SELECT o_orderkey, 'd' AS op FROM orders WHERE o_orderkey % 9 = 0")(lambda t: changes.tombstones(t("orders"), t("orders").where("o_orderkey % 9 <> 0"), ["o_orderkey"]))
_ROUTES = [("app", "click", "t1"), ("*", "click", "t2"), ("*", "*", "t3"), ("app", "*", "t4"), ("app", "error", "t5")]


@case("route_fanout", f"SELECT target, count(*) AS n FROM (SELECT 'app' AS s, event_type AS t FROM events) e JOIN (VALUES {', '.join(map(str, _ROUTES))}) r(rs, rt, target) ON (rs = s OR rs = '*') AND (rt = t OR rt = '*') AND NOT (rs <> '*' AND rt = '*') GROUP BY target")
def route_fanout(t: Tables) -> DataFrame:
    routes = t("events").sparkSession.createDataFrame(_ROUTES, "route_schema string, route_table string, target string")
    e = t("events").select("event_id", F.lit("app").alias("schema_name"), F.col("event_type").alias("table_name"))
    return changes.route(e, routes).groupBy("target").agg(F.count("*").alias("n"))


@case("parse_wal", "SELECT CASE event_id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'u' ELSE 'd' END AS op, CASE WHEN event_id % 3 <> 2 THEN CAST(event_id AS VARCHAR) END AS id FROM events")
def parse_wal(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(F.lit("insert"), F.lit("update"), F.lit("delete")), (F.col("event_id") % 3 + 1).cast("int"))
    image = F.when(kind != "delete", F.concat(F.lit('"columnnames":["id"],"columnvalues":['), F.col("event_id").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit('"oldkeys":{"keynames":["id"],"keyvalues":['), F.col("event_id").cast("string"), F.lit("]}")))
    lines = t("events").select(F.concat(F.lit('{"change":[{"kind":"'), kind, F.lit('","schema":"s","table":"t",'), image, F.lit("}]}")).alias("payload"))
    return logs.wal(lines).select("op", F.get_json_object("after", "$.id").alias("id"))


@case("parse_document_stream", "SELECT CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op, '{\"_id\":' || event_id || '}' AS pk_values, CASE WHEN event_type = 'error' THEN '{\"_id\":' || event_id || '}' END AS before, CASE WHEN event_type <> 'error' THEN event_id END AS a, 't' || event_id AS lsn FROM events WHERE event_type <> 'view'")
def parse_document_stream(t: Tables) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "insert", "error", "delete", "click", "update", "purchase", "replace", "view", "invalidate")]), F.col("event_type"))
    n = F.col("event_id").cast("string")
    lines = t("events").select(F.concat(F.lit('{"_id":"t'), n, F.lit('","operationType":"'), kind, F.lit('","ns":{"db":"d","coll":"c"},"documentKey":{"_id":'), n, F.lit('},"fullDocument":{"a":'), n, F.lit("}}")).alias("payload"))
    return logs.document_stream(lines).select("op", "pk_values", "before", F.get_json_object("after", "$.a").cast("bigint").alias("a"), "lsn")


# -- applying ------------------------------------------------------------------------------------
BASE = "(SELECT o_orderkey AS user_id, o_totalprice AS value, o_orderstatus AS event_type FROM orders WHERE o_orderkey % 2 = 0)"


def base(t: Tables) -> DataFrame:
    return t("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("user_id"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("event_type"))


def last(t: Tables) -> DataFrame:
    return changes.compact(log(t), ["user_id"], ["event_id"])


KEYS = ["user_id"]
case("apply_scd1", f"SELECT * FROM {BASE} WHERE user_id NOT IN (SELECT user_id FROM {LAST}) UNION ALL SELECT user_id, value, event_type FROM {LAST} WHERE op <> 'd'")(lambda t: apply.scd1(base(t), last(t), KEYS))
case("apply_merge", f"SELECT b.user_id, CASE WHEN l.op = 'u' THEN l.value ELSE b.value END AS value, CASE WHEN l.op = 'u' THEN l.event_type ELSE b.event_type END AS event_type FROM {BASE} b LEFT JOIN {LAST} l USING (user_id) WHERE l.op IS DISTINCT FROM 'd' UNION ALL SELECT user_id, value, event_type FROM {LAST} WHERE op = 'c' AND user_id NOT IN (SELECT user_id FROM {BASE})")(lambda t: apply.merge(base(t), last(t), KEYS))
case("apply_delete", f"SELECT * FROM {BASE} WHERE user_id NOT IN (SELECT user_id FROM {LAST} WHERE op = 'd')")(lambda t: apply.delete(base(t), last(t).where("op = 'd'"), KEYS))
case("staging_merge", f"SELECT * FROM {BASE} WHERE user_id NOT IN (SELECT user_id FROM {LAST}) UNION ALL SELECT user_id, value, event_type FROM {LAST}")(lambda t: apply.upsert(base(t), last(t).select("user_id", "value", "event_type"), KEYS))


@case("apply_scd2", f"""WITH h AS (SELECT user_id, value, event_type, TIMESTAMP '2000-01-01' AS valid_from, 'r' AS op, -1 AS event_id FROM {BASE} UNION ALL SELECT user_id, value, event_type, ts, op, event_id FROM {LOG}),
w AS (SELECT *, lead(valid_from) OVER c AS valid_to, coalesce(lead(op) OVER c = 'd', false) AS is_deleted FROM h WINDOW c AS (PARTITION BY user_id ORDER BY valid_from, event_id))
SELECT user_id, value, event_type, valid_from, valid_to, is_deleted FROM w WHERE op <> 'd'""")
def apply_scd2(t: Tables) -> DataFrame:
    history = base(t).withColumns({"valid_from": F.lit("2000-01-01").cast("timestamp"), "valid_to": F.lit(None).cast("timestamp"), "is_deleted": F.lit(False)})
    events = log(t).withColumn("valid_from", F.col("ts").cast("timestamp"))
    return apply.scd2(history, events, KEYS, order=["event_id"])


_CUT = "TIMESTAMP '1996-01-01'"
_OLD, _NEW = f"(SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate < {_CUT})", f"(SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= {_CUT} OR o_orderkey % 10 = 0)"


def _sync(t: Tables, mode: str, **more) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    new = o.where(F.expr(f"o_orderdate >= {_CUT} OR o_orderkey % 10 = 0")).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return apply.sync(mode, o.where(F.expr(f"o_orderdate < {_CUT}")), new, ["o_orderkey"], "o_orderdate", **more)


case("sync_full_overwrite", f"SELECT * FROM {_NEW}")(lambda t: _sync(t, "full_refresh"))
case("sync_full_append", f"SELECT *, CAST(NULL AS TIMESTAMP) AS loaded_at FROM {_OLD} UNION ALL SELECT *, {NOW_SQL} FROM {_NEW}")(lambda t: _sync(t, "full_refresh_append", loaded_at=F.lit(NOW)))
case("sync_incremental", f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW}")(lambda t: _sync(t, "incremental_append"))
case("sync_incremental_dedup", f"SELECT * FROM {_OLD} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_NEW}) UNION ALL SELECT * FROM {_NEW}")(lambda t: _sync(t, "incremental"))
case("partition_transforms", "SELECT strftime(o_orderdate, '%Y-%m') AS o_orderdate_month, strftime(o_orderdate, '%Y') AS o_orderdate_year, substring(o_orderstatus, 1, 1) AS o_orderstatus_trunc, count(*) AS n FROM orders GROUP BY 1, 2, 3")(lambda t: (lambda p: t("orders").withColumns(p).groupBy(*p).agg(F.count("*").alias("n")))(apply.partition_columns([{"column": "o_orderdate", "transform": "month"}, {"column": "o_orderdate", "transform": "year"}, {"column": "o_orderstatus", "transform": "truncate", "n": 1}])))
case("watermark_scan", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")(lambda t: apply.since(t("orders"), "o_orderdate", datetime(1997, 1, 1)).select("o_orderkey"))
case("poll_source", "SELECT o_orderkey, 'c' AS op, 'poll:' || o_orderkey AS lsn FROM orders WHERE o_orderkey > 100")(lambda t: logs.poll(t("orders").select("o_orderkey"), "o_orderkey", 100, None))
case("keyset_chunk", "SELECT page, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS page FROM orders) GROUP BY page")(lambda t: logs.pages(t("orders").select("o_orderkey"), "o_orderkey", 100).groupBy("page").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.count("*").alias("n")))


@case("range_counts", "SELECT 'ranges' AS part, count(*) AS n FROM orders")
def range_counts(t: Tables) -> DataFrame:
    """Every key lies in exactly one range."""
    conditions = ranges.predicates("o_orderkey", ranges.split(1, 60000, 8))
    hits = t("orders").select(F.explode(F.array(*[F.expr(c).cast("int") for c in conditions])).alias("hit"))
    return hits.groupBy(F.lit("ranges").alias("part")).agg(F.sum("hit").alias("n"))


_FILES = "(SELECT l_orderkey // 100 AS path, min(l_partkey) - 1 AS lo, min(l_partkey) + 20 AS hi FROM lineitem GROUP BY 1)"
case("range_overlap", f"SELECT a.path AS a, b.path AS b, b.lo >= a.lo AND b.hi <= a.hi AS contained FROM {_FILES} a JOIN {_FILES} b ON a.path < b.path AND a.lo < b.hi AND b.lo < a.hi")(lambda t: ranges.overlaps(t("lineitem").groupBy(F.expr("l_orderkey div 100").alias("path")).agg((F.min("l_partkey") - 1).alias("lo"), (F.min("l_partkey") + 20).alias("hi"))))
case("orphan_files", "SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")(lambda t: ranges.orphans(t("part").select(F.col("p_partkey").alias("path")), t("lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("path"))))
case("clean_batch", f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name, '{{\"a\":1}}' AS nested, {NOW_SQL} + INTERVAL 330 MINUTE AS audit_updated_date FROM customer")(lambda t: clean.clean(t("customer").select(F.col("c_custkey").alias("C_CUSTKEY"), F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.concat("c_name", F.lit("\0"))).alias("c_name"), F.struct(F.lit(1).alias("a")).alias("nested")), F.lit(NOW)))
case("reconcile_schema", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, CAST(NULL AS DATE) AS born, c_name, c_nationkey FROM customer")(lambda t: schemas.reconcile(t("customer").select("c_name", "c_nationkey", "c_custkey"), t("customer").selectExpr("CAST(c_custkey AS double) c_custkey", "CAST(NULL AS date) born", "c_name").schema))
case("infer_schema", "SELECT 'k' AS field, 'bigint' AS type, count(*) AS present FROM events WHERE props IS NOT NULL UNION ALL SELECT 'm', 'string', (SELECT count(*) FROM events)")(lambda t: schemas.infer(t("events").select(F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.when(F.col("event_id") % 2 == 0, ',"m":1}').otherwise(',"m":"x"}')).alias("props")), "props"))
def columns_of(df: DataFrame, table: str) -> DataFrame:
    """The catalog rows of the columns that a table's rows hold values in."""
    held = df.agg(*[F.count(c).alias(c) for c in df.columns])
    kinds = F.array(*[F.struct(F.lit("s").alias("schema_name"), F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.lit(k).alias("data_type"), F.col(c).alias("n")) for c, k in df.dtypes])
    return held.select(F.inline(kinds)).where("n > 0").drop("n")


@case("schema_diff", """SELECT * FROM (VALUES ('s','a','k','type_changed','bigint','double',false), ('s','a','price','type_changed','double','int',true), ('s','a','status','column_removed','string',NULL,true), ('s','a','late','column_added',NULL,'int',false), ('s','b',NULL,'table_removed',NULL,NULL,true), ('s','c',NULL,'table_added',NULL,NULL,false)) v(schema_name, table_name, column_name, change, old_type, new_type, is_breaking)
WHERE EXISTS (SELECT 1 FROM orders) AND EXISTS (SELECT 1 FROM customer)""")
def schema_diff(t: Tables) -> DataFrame:
    """The columns in use of a source's tables, then and now: a column without any value is in neither."""
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("late"))
    now = o.select(F.col("k").cast("double").alias("k"), F.col("price").cast("int").alias("price"), F.lit(None).cast("string").alias("status"), (F.col("k") % 7).cast("int").alias("late"))
    other = t("customer").select("c_custkey")
    return schemas.diff(columns_of(o, "a").unionByName(columns_of(other, "b")), columns_of(now, "a").unionByName(columns_of(other, "c")))


@case("type_compat", "SELECT c AS column_name, CAST(least AS VARCHAR) AS least, CAST(most AS VARCHAR) AS most FROM (SELECT 'o_orderkey' AS c, CAST(min(o_orderkey) AS VARCHAR) AS least, CAST(max(o_orderkey) AS VARCHAR) AS most FROM orders UNION ALL SELECT 'o_orderdate', strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S'), strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders UNION ALL SELECT 'o_custkey', min(CAST(o_custkey AS VARCHAR)), max(CAST(o_custkey AS VARCHAR)) FROM orders)")
def type_compat(t: Tables) -> DataFrame:
    """Columns in the type that widening gives them, with all their values: a number and a wider one, a date and a time, a number and a text."""
    wide = {"o_orderkey": widened("int", "bigint"), "o_orderdate": widened("date", "timestamp"), "o_custkey": widened("bigint", "string")}
    if not all(compatible(a, b) for a, b in (("int", "bigint"), ("date", "timestamp"), ("bigint", "string"))) or compatible("bigint", "int"):
        raise ValueError("widening and compatibility disagree")
    held = t("orders").select(*[F.col(c).cast(k).alias(c) for c, k in wide.items()])
    bounds = held.agg(*[f(c).cast("string").alias(f"{n}_{c}") for c in wide for n, f in (("least", F.min), ("most", F.max))])
    return bounds.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"least_{c}").alias("least"), F.col(f"most_{c}").alias("most")) for c in wide])))


# -- metrics -------------------------------------------------------------------------------------


def events_stream(t: Tables) -> DataFrame:
    """The events as a stream of files."""
    events = t("events")
    files = events.inputFiles()
    folder, _, name = files[0].rpartition("/")
    return runner.file_events(events.sparkSession, folder, events.schema, glob=name if len(files) == 1 else "*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@case("stream_dedup", "SELECT event_id, user_id, value FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    spark = t("events").sparkSession
    twice = events_stream(t).unionByName(events_stream(t))
    path = runner.scratch(spark, "dedup")
    runner.to_table(runner.deduplicated(twice).select("event_id", "user_id", "value"), path, f"{path}-checkpoint")
    return spark.read.schema("event_id bigint, user_id bigint, value double").parquet(path)


@case("stream_rates", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS events, count(*) / 300 AS rate FROM events GROUP BY 1, 2")
def stream_rates(t: Tables) -> DataFrame:
    spark = t("events").sparkSession
    path = runner.scratch(spark, "rates")
    runner.updates_to_table(runner.rates(events_stream(t), by=["event_type"]), path, f"{path}-checkpoint")
    return runner.newest_updates(spark.read.parquet(path), ["start", "event_type"])


@case("stream_pipeline", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE value <= 50")
def stream_pipeline(t: Tables) -> DataFrame:
    """The micro-batch loop with a pipeline, a blocking policy and a sink that may fail once."""
    spark = t("events").sparkSession
    path, failures = runner.scratch(spark, "loop"), [1]

    def sink(df: DataFrame, number: int) -> None:
        if failures:
            failures.pop()
            raise OSError("a sink that is away for a moment")
        df.select("event_id", "k").write.mode("overwrite").parquet(f"{path}/part={number}")

    spec = {"transforms": [{"type": "json_extract", "column": "props", "path": "$.k", "output_type": "long", "output_column": "k"}]}
    policy = {"rules": [{"type": "range_check", "column": "value", "max": 50}], "on_fail": "block"}
    runner.start(events_stream(t), lambda: spec, policy, runner.retried(sink, pause=0.01), f"{path}-checkpoint", f"{path}-dead").awaitTermination()
    return spark.read.parquet(path).select("event_id", "k")



case("lag_summary", f"SELECT event_type, max(epoch_us({NOW_SQL}) - epoch_us(ts)) / 1e6 AS max_lag, round(avg((epoch_us({NOW_SQL}) - epoch_us(ts)) / 1e6), 3) AS avg_lag, count(*) AS events FROM events GROUP BY 1")(lambda t: metrics.lag(t("events"), F.lit(NOW), F.col("ts").cast("timestamp"), ["event_type"]).withColumn("avg_lag", F.round("avg_lag", 3)))
case("throughput_5m", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS events, count(*) / 300 AS rate FROM events GROUP BY 1, 2")(lambda t: metrics.rate(t("events"), by=["event_type"]))
case("sliding_rate", "SELECT start, count(*) AS events, count(*) / 300 AS rate FROM (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - k * INTERVAL 1 MINUTE AS start FROM events, range(5) r(k)) GROUP BY 1")(lambda t: metrics.rate(t("events"), slide="1 minute"))
case("session_windows", "SELECT user_id, min(ts) AS start, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")(lambda t: eventtime.sessions(t("events"), ["user_id"]).drop("last"))
case("latest_run", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")(lambda t: metrics.latest_of(t("events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"]))
_USAGE = "SELECT n_name, CAST(o_orderdate AS DATE) AS day, count(*) AS orders, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS finished_customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"


def usage_rows(t: Tables) -> DataFrame:
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))


def usage(t: Tables, old: DataFrame | None, rows: DataFrame) -> DataFrame:
    measures = {"orders": F.count("*"), "finished_customers": F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))), "total": F.round(F.sum("o_totalprice"), 2)}
    return metrics.daily_usage(old, rows, ["n_name"], "o_orderdate", measures)


case("tenant_usage", _USAGE)(lambda t: usage(t, None, usage_rows(t)))
case("tenant_usage_upsert", _USAGE)(lambda t: usage(t, usage(t, None, usage_rows(t).where("o_orderkey % 2 = 0")), usage_rows(t)))
case("dlq_summary", "SELECT c_mktsegment, count(*) AS total, count(*) FILTER (c_acctbal < 0) AS open, CASE WHEN count(*) FILTER (c_acctbal < 0) = 0 THEN 'ok' WHEN count(*) FILTER (c_acctbal < 0) > count(*) * 0.1::DOUBLE THEN 'critical' ELSE 'degraded' END AS status FROM customer GROUP BY 1")(lambda t: metrics.queue_status(t("customer"), ["c_mktsegment"], F.col("c_acctbal") < 0))


@case("alert_stats", f"SELECT event_type, count(*) AS n_total, count(*) FILTER (value <= 50 AND user_id % 2 = 1) AS n_active, count(*) FILTER (value <= 50 AND user_id % 2 = 0) AS n_acknowledged, count(*) FILTER (value > 50) AS n_resolved, count(*) FILTER (value > 90) AS n_critical, 0 AS n_error, count(*) FILTER (value <= 90) AS n_warning, 0 AS n_info, count(*) FILTER (ts >= {NOW_SQL} - INTERVAL 24 HOUR) AS n_last_24h, count(*) FILTER (ts >= {NOW_SQL} - INTERVAL 7 DAY) AS n_last_7d, CASE WHEN count(*) FILTER (value > 50) > 0 THEN 30.0 END AS mean_minutes FROM (SELECT * FROM events WHERE value IS NOT NULL) GROUP BY 1")
def alert_stats(t: Tables) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    alerts = t("events").where("value IS NOT NULL").select("event_type", F.when(F.col("value") > 90, "critical").otherwise("warning").alias("severity"), (F.col("user_id") % 2 == 0).alias("acknowledged"), (F.col("value") > 50).alias("resolved"), at.alias("triggered_at"), (at + F.expr("INTERVAL 30 MINUTES")).alias("resolved_at"))
    return metrics.alert_statistics(alerts, ["event_type"], NOW)



case("alert_trend", "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, lag(n) OVER (ORDER BY day) AS before FROM d) SELECT day, n, CASE WHEN n > before * 1.2 THEN 'increasing' WHEN n < before * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM p")(lambda t: metrics.daily(t("events")))

POLICIES = "(SELECT p_partkey AS policy_id, p_size AS connection_id, p_partkey % 5 <> 0 AS is_active, CASE WHEN p_size % 4 = 0 THEN 'critical' ELSE 'warning' END AS severity FROM part)"
VIOLATIONS = "(SELECT l_partkey AS policy_id, CASE WHEN l_linenumber % 2 = 0 THEN 'active' ELSE 'resolved' END AS status, l_shipdate AS executed_at FROM lineitem)"


def policies(t: Tables) -> DataFrame:
    return t("part").selectExpr("p_partkey AS policy_id", "p_size AS connection_id", "p_partkey % 5 <> 0 AS is_active", "CASE WHEN p_size % 4 = 0 THEN 'critical' ELSE 'warning' END AS severity")


def violations(t: Tables) -> DataFrame:
    return t("lineitem").selectExpr("l_partkey AS policy_id", "CASE WHEN l_linenumber % 2 = 0 THEN 'active' ELSE 'resolved' END AS status", "l_shipdate AS executed_at")


case("top_failing", f"SELECT policy_id, severity, count(*) AS violations FROM {VIOLATIONS} JOIN {POLICIES} USING (policy_id) WHERE status = 'active' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10")(lambda t: quality.top_failing(policies(t), violations(t)))
case("dq_dashboard", f"""SELECT *, greatest(0.0, 100 - least(100.0, active_violations / active_policies * 20)) AS score, CASE WHEN active_violations > policies THEN 'degrading' WHEN active_violations < policies / 2 THEN 'improving' ELSE 'stable' END AS trend
FROM (SELECT count(*) AS policies, count(*) FILTER (is_active) AS active_policies FROM {POLICIES}), (SELECT count(*) AS violations, count(*) FILTER (status = 'active') AS active_violations, count(*) FILTER (status = 'active' AND severity = 'critical') AS critical_violations,
count(DISTINCT connection_id) FILTER (status = 'active') AS connections_with_issues FROM {VIOLATIONS} JOIN {POLICIES} USING (policy_id))""")(lambda t: quality.dashboard(policies(t), violations(t)))
case("connection_scores", f"""SELECT c.connection_id, CASE WHEN coalesce(p.n, 0) = 0 THEN 100.0 ELSE round(greatest(0.0, 100 - least(100.0, coalesce(v.n, 0) / p.n * 20)), 1) END AS score, coalesce(v.n, 0) AS violations, r.last_check
FROM (SELECT DISTINCT connection_id FROM {POLICIES}) c LEFT JOIN (SELECT connection_id, count(*) AS n FROM {POLICIES} WHERE is_active GROUP BY 1) p USING (connection_id)
LEFT JOIN (SELECT connection_id, count(*) AS n FROM {VIOLATIONS} JOIN {POLICIES} USING (policy_id) WHERE status = 'active' GROUP BY 1) v USING (connection_id)
LEFT JOIN (SELECT connection_id, max(executed_at) AS last_check FROM {VIOLATIONS} JOIN {POLICIES} USING (policy_id) GROUP BY 1) r USING (connection_id)""")(lambda t: quality.scores(policies(t).select("connection_id").distinct(), policies(t), violations(t), violations(t)))
case("row_tiers", "SELECT CASE WHEN r < 1000000 THEN 'S' WHEN r < 20000000 THEN 'M' WHEN r < 200000000 THEN 'L' ELSE 'XL' END AS tier, count(*) AS n FROM (SELECT o_orderkey * 10000 AS r FROM orders) GROUP BY 1")(lambda t: t("orders").groupBy(metrics.tier(F.col("o_orderkey") * 10000).alias("tier")).agg(F.count("*").alias("n")))
case("throughput_ema", "SELECT event_type, round(sum(CASE WHEN i = 1 THEN power(0.7::DOUBLE, n - 1) ELSE 0.3::DOUBLE * power(0.7::DOUBLE, n - i) END * value), 6) AS ema FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")(lambda t: metrics.moving_average(t("events"), ["event_type"], "event_id", "value").select("event_type", F.round("ema", 6).alias("ema")))

case("copy_eta", "SELECT event_type, greatest(0, 1000000 - count(*)) / (count(*) / 3600) AS seconds FROM events GROUP BY 1")(lambda t: t("events").groupBy("event_type").agg(metrics.remaining(F.count("*"), F.lit(1000000), F.count("*") / 3600).alias("seconds")))
case("last_30d", f"SELECT event_id FROM events WHERE ts >= {NOW_SQL} - INTERVAL 30 DAY AND ts <= {NOW_SQL}")(lambda t: metrics.within(t("events"), "ts", "30d", NOW).select("event_id"))
case("last_1h", "SELECT event_id FROM events WHERE ts >= (TIMESTAMP '2024-01-02 00:00:00') - INTERVAL 1 HOUR AND ts <= TIMESTAMP '2024-01-02 00:00:00'")(lambda t: metrics.within(t("events"), "ts", "1h", datetime(2024, 1, 2)).select("event_id"))
case("alert_page", "SELECT event_id, value FROM events WHERE event_type IN ('error', 'click') AND user_id IS NOT NULL ORDER BY value DESC NULLS LAST, event_id LIMIT 50 OFFSET 100")(lambda t: metrics.page(t("events").where("user_id IS NOT NULL"), {"event_type": ["error", "click"]}, [F.desc("value"), F.col("event_id")], 50, 100).select("event_id", "value"))


@case("threshold_alerts", "SELECT event_type, start, alert, severity, round(most, 6) AS value FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, min(value) AS least, max(value) AS most FROM events WHERE value IS NOT NULL GROUP BY 1, 2) JOIN (VALUES ('lag', 10.0, 'warning'), ('late', 30.0, 'critical')) r(alert, above, severity) ON least > above")
def threshold_alerts(t: Tables) -> DataFrame:
    rules = [{"alert": "lag", "metric": "seconds", "above": 10}, {"alert": "late", "metric": "seconds", "above": 30, "severity": "critical"}]
    samples = t("events").where("value IS NOT NULL").select("event_type", "ts", F.lit("seconds").alias("metric"), "value")
    return metrics.threshold_alerts(samples, rules, ["event_type"]).withColumn("value", F.round("value", 6))


# -- more of quality -----------------------------------------------------------------------------
_KIND_RULES = [{"type": "range_check", "column": "value", "max": 50, "action": "quarantine", "severity": "error", "threshold_type": "percentage", "threshold_value": 10}, {"type": "enum_check", "column": "event_type", "allowed": ["click", "view"], "action": "alert", "threshold_type": "count", "threshold_value": 100000000}, {"type": "null_check", "column": "user_id", "action": "block", "severity": "critical"}, {"type": "custom_sql", "expression": "value + event_id > 20", "action": "reject"}]
case("dq_actions", "SELECT r.rule, r.type, total, failing, violated, severity, action FROM (SELECT count(*) AS total, count(*) FILTER (value > 50) AS a, count(*) FILTER (event_type NOT IN ('click', 'view')) AS b, count(*) FILTER (user_id IS NULL) AS c, count(*) FILTER (NOT value + event_id > 20) AS d FROM events), LATERAL (VALUES (0, 'range_check', a, a * 100 / total > 10, 'error', 'quarantine'), (1, 'enum_check', b, b > 100000000, 'warning', 'alert'), (2, 'null_check', c, c > 0, 'critical', 'block'), (3, 'custom_sql', d, d > 0, 'warning', 'reject')) r(rule, type, failing, violated, severity, action)")(lambda t: quality.by_action(t("events"), _KIND_RULES)[2])
case("dq_actions_pass", "SELECT event_id FROM events WHERE NOT (coalesce(value > 50, false) OR coalesce(NOT value + event_id > 20, false)) AND NOT EXISTS (SELECT 1 FROM events WHERE user_id IS NULL)")(lambda t: quality.by_action(t("events"), _KIND_RULES)[0].select("event_id"))
case("dq_two_references", "SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (o_custkey % 5 = 0) AS a, count(*) FILTER (o_custkey % 7 = 0) AS b FROM orders), LATERAL (VALUES (0, 'referential_integrity', a, a > 0), (1, 'referential_integrity', b, b > 0)) r(rule, type, failing, violated)".replace("SELECT *", "SELECT rule, type, total, failing, violated", 1))(lambda t: quality.report(t("orders"), [{"type": "referential_integrity", "column": "o_custkey", "reference": t("orders").where(f"o_custkey % {n} <> 0").select("o_custkey")} for n in (5, 7)]))
case("value_patterns", "SELECT regexp_replace(regexp_replace(regexp_replace(p_brand, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda t: quality.patterns(t("part"), "p_brand"))
case("recommended_rules", """SELECT c AS "column", rule FROM (SELECT 'p_partkey' AS c, count(*) AS n, count(p_partkey) AS k, count(DISTINCT p_partkey) AS d, true AS num FROM part UNION ALL SELECT 'p_brand', count(*), count(p_brand), count(DISTINCT p_brand), false FROM part UNION ALL SELECT 'p_size', count(*), count(p_size), count(DISTINCT p_size), true FROM part),
LATERAL (VALUES ('null_check', n = k), ('uniqueness', n = d), ('enum_check', d <= 10), ('range_check', num)) r(rule, ok) WHERE ok""")(lambda t: quality.recommended(t("part"), ["p_partkey", "p_brand", "p_size"], exact=True))
case("json_quarantine", "SELECT event_id FROM events WHERE event_id % 10 = 0 AND props IS NOT NULL")(lambda t: pipeline.split_json(t("events").withColumn("props", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))), ["props"])[1].select("event_id"))

# -- more of sources -----------------------------------------------------------------------------
case("high_water", "SELECT strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS mark FROM orders")(lambda t: t("orders").sparkSession.createDataFrame([(apply.high_water(t("orders"), "o_orderdate"),)], "mark string"))
case("name_dedup", """SELECT c_custkey AS id, c_name AS "ID_1", c_nationkey AS "id_2" FROM customer""")(lambda t: clean.deduplicated_names(t("customer").select("c_custkey", "c_name", "c_nationkey").toDF("id", "ID", "id")))
case("strip_nul", "SELECT c_custkey, c_name || 'x' AS c_name FROM customer")(lambda t: clean.clean(t("customer").select("c_custkey", F.concat("c_name", F.lit("\0x\0")).alias("c_name"))))
case("bytes_to_text", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'ff00' ELSE c_name END AS b, CASE WHEN c_custkey % 2 = 0 THEN 'ff00' ELSE c_name END AS inner FROM customer")(lambda t: (lambda b: clean.readable(t("customer").select("c_custkey", b.alias("b"), F.array(F.struct(b.alias("x"))).alias("deep"))).select("c_custkey", "b", F.col("deep")[0]["x"].alias("inner")))(F.when(F.col("c_custkey") % 2 == 0, F.unhex(F.lit("ff00"))).otherwise(F.col("c_name").cast("binary"))))
case("coerce_to_text", """SELECT c_custkey, '{"a":' || c_nationkey || '}' AS nested, CAST(c_nationkey AS VARCHAR) AS n FROM customer""")(lambda t: (lambda df: clean.as_text(df, df.selectExpr("c_custkey", "'' AS nested", "'' AS n").schema))(t("customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("a")).alias("nested"), F.col("c_nationkey").alias("n"))))
case("document_batch", "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-02 00:00:00'")(lambda t: logs.documents(t("orders").select(F.struct(F.col("o_orderkey").cast("string").alias("oid")).alias("_id"), "o_orderdate"), "o_orderdate", "1996/01/02 00:00:00"))
#: Forms that a watermark may have, as Spark formats times in them (fixed values).
_FORMATS = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy/MM/dd HH:mm:ss.SSSSSS", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd"]
_CUTS = "[ts, date_trunc('second', ts), date_trunc('minute', ts), date_trunc('day', ts), ts, date_trunc('second', ts), date_trunc('minute', ts), ts, date_trunc('second', ts), date_trunc('day', ts)]"
case("watermark_formats", f"SELECT event_id, ({_CUTS})[1 + event_id % 10] AS mark FROM events")(lambda t: t("events").withColumn("text", F.element_at(F.array(*[F.date_format("ts", f) for f in _FORMATS]), (F.col("event_id") % 10 + 1).cast("int"))).select("event_id", clean.watermark(F.col("text")).alias("mark")))
_ROW_KIND = "CASE event_type WHEN 'signup' THEN 'write_rows' WHEN 'error' THEN 'delete_rows' WHEN 'view' THEN 'query' ELSE 'update_rows' END"


def binlog_rows(t: Tables) -> DataFrame:
    image = F.concat(F.lit('{"UNKNOWN_COL0":'), F.col("user_id").cast("string"), F.lit(',"UNKNOWN_COL1":"x"}'))
    return t("events").where("user_id IS NOT NULL").select(F.expr(_ROW_KIND).alias("event_type"), F.lit("s").alias("schema_name"), F.when(F.col("event_id") % 4 == 0, "other").otherwise("t").alias("table_name"), F.lit("bin.1").alias("log_file"), F.col("event_id").alias("log_pos"), image.alias("before"), image.alias("after"), F.when(F.col("event_id") % 2 == 0, "ALTER TABLE t").otherwise("BEGIN").alias("query"))


case("parse_binlog", "SELECT CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op, 'bin.1:' || event_id AS lsn, CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS id FROM events WHERE user_id IS NOT NULL AND event_type <> 'view' AND event_id % 4 <> 0")(lambda t: logs.binlog(binlog_rows(t), [("s", "t")], {("s", "t"): ["id", "name"]}).select("op", "lsn", F.get_json_object("after", "$.id").alias("id")))
case("table_changes", "SELECT 's' AS schema_name, 'ALTER TABLE t' AS query FROM events WHERE user_id IS NOT NULL AND event_type = 'view' AND event_id % 2 = 0")(lambda t: logs.table_changes(binlog_rows(t)))
case("new_columns", "SELECT DISTINCT 's' AS schema_name, event_type AS table_name, 'extra' AS column_name FROM events WHERE event_id % 3 = 0")(lambda t: logs.new_columns(t("events").select(F.lit("s").alias("schema_name"), F.col("event_type").alias("table_name"), F.when(F.col("event_id") % 3 == 0, '{"k":1,"extra":2}').otherwise('{"k":1}').alias("after")), t("events").select(F.lit("s").alias("schema_name"), F.col("event_type").alias("table_name"), F.lit("k").alias("column_name")).distinct()))
case("discover_schema", "SELECT * FROM (VALUES ('s', 'region', 'r_regionkey', 'bigint', false, 1, false), ('s', 'region', 'r_name', 'string', true, NULL, true)) v(schema_name, table_name, column_name, data_type, is_nullable, key_position, json_candidate)")(lambda t: logs.discovered(t("region").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name"), "s", "region", ["r_regionkey"]))
case("json_rate", "SELECT event_type, CAST(count(*) FILTER (props IS NOT NULL AND event_id % 2 = 0) AS DOUBLE) / count(props) AS rate FROM events GROUP BY 1")(lambda t: t("events").withColumn("props", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("{"), "props"))).groupBy("event_type").agg(logs.json_rate(F.col("props")).alias("rate")))

# -- more of steps -------------------------------------------------------------------------------
piped("math_guarded", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"], [
    {"type": "math_op", "expression": "(l_quantity + l_tax) / (l_linenumber - 1)", "column": "m1", "on_error": "null"}, {"type": "math_op", "expression": "l_quantity / (l_linenumber - 1) / 2", "column": "m2", "on_error": "null"},
    {"type": "math_op", "expression": "abs(l_quantity) / abs(l_linenumber - 2) + 1", "column": "m3", "on_error": "null"},
], """SELECT *, CASE WHEN l_linenumber <> 1 THEN (l_quantity + l_tax) / (l_linenumber - 1) END AS m1, CASE WHEN l_linenumber <> 1 THEN l_quantity / (l_linenumber - 1) / 2 END AS m2, CASE WHEN l_linenumber <> 2 THEN abs(l_quantity) / abs(l_linenumber - 2) + 1 END AS m3
      FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem)""")  # fmt: skip
piped("string_patterns", "customer", ["c_custkey", "c_name"], [{"type": "string_op", "column": "c_name", "op": "regexp_replace", "pattern": "[0-9]+", "to": "#", "output_column": "r"}], "SELECT c_custkey, c_name, regexp_replace(c_name, '[0-9]+', '#', 'g') AS r FROM customer")
piped("mask_names", "customer", ["c_custkey", "c_name"], [_M("nullify", "nu"), _M("email_domain", "em", "email")], "SELECT c_custkey, c_name, 'bob@x.org' AS email, CAST(NULL AS VARCHAR) AS nu, 'b***@x.org' AS em FROM customer", {"email": "'bob@x.org'"})
piped("json_dotted_path", "events", ["event_id"], [{"type": "json_extract", "column": "doc", "path": "$.a.b", "output_type": "long", "output_column": "b"}], "SELECT event_id, '{\"a\":{\"b\":' || event_id || '}}' AS doc, event_id AS b FROM events", {"doc": "concat('{\"a\":{\"b\":', event_id, '}}')"})

# -- more of applying ----------------------------------------------------------------------------
case("upsert_two_keys", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem")(lambda t: (lambda x: apply.upsert(x, x.where("l_linenumber = 1").withColumn("l_quantity", F.col("l_quantity") + 1), ["l_orderkey", "l_linenumber"]))(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")))
case("write_merge", f"SELECT * FROM {BASE} WHERE user_id NOT IN (SELECT user_id FROM {LAST}) UNION ALL SELECT user_id, value, event_type FROM {LAST} WHERE op <> 'd'")(lambda t: apply.write("merge", base(t), last(t), KEYS))
case("write_append_first", "SELECT o_orderkey FROM orders")(lambda t: apply.write("append", None, t("orders").select("o_orderkey")))
case("sync_history", f"SELECT user_id, events, valid_from, lead(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from) AS valid_to, false AS is_deleted FROM (SELECT user_id, ts AS valid_from, count(*) AS events FROM {LOG} WHERE op <> 'd' GROUP BY 1, 2)")(lambda t: (lambda rows: apply.sync("cdc", None, rows, KEYS))(log(t).where("op <> 'd'").groupBy("user_id", F.col("ts").cast("timestamp").alias("valid_from")).agg(F.count("*").alias("events")).withColumn("op", F.lit("u"))))


@case("scd2_late_event", "SELECT o_orderkey, v, CAST(a AS TIMESTAMP) AS valid_from, CAST(b AS TIMESTAMP) AS valid_to, d AS is_deleted FROM orders, (VALUES (1, '2024-01-01', '2024-02-01', false), (2, '2024-02-01', '2024-03-01', true), (3, '2024-05-01', NULL, false)) x(v, a, b, d)")
def scd2_late_event(t: Tables) -> DataFrame:
    """January to March, deleted then, and again from May; February's value arrives last."""
    at = lambda m: F.lit(f"2024-{m:02}-01").cast("timestamp")
    row = lambda v, a, b, d: F.struct(F.lit(v).alias("v"), at(a).alias("valid_from"), (at(b) if b else F.lit(None).cast("timestamp")).alias("valid_to"), F.lit(d).alias("is_deleted"))
    history = t("orders").select("o_orderkey", F.inline(F.array(row(1, 1, 3, True), row(3, 5, None, False))))
    return apply.scd2(history, t("orders").select("o_orderkey", F.lit(2).alias("v"), F.lit("u").alias("op"), at(2).alias("valid_from")), ["o_orderkey"])


case("partition_more", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate_day, strftime(o_orderdate, '%Y-%m-%d-%H') AS o_orderdate_hour, o_orderstatus, o_orderkey // 100 * 100 AS o_orderkey_trunc, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4")(lambda t: (lambda o: (lambda p: o.withColumns(p).groupBy(*p).agg(F.count("*").alias("n")))(apply.partition_columns([{"column": "o_orderdate", "transform": "day"}, {"column": "o_orderdate", "transform": "hour"}, {"column": "o_orderstatus"}, {"column": "o_orderkey", "transform": "truncate", "n": 100}], o)))(t("orders")))
case("partition_buckets", "SELECT n, CASE WHEN n > 0 THEN true END AS one_bucket_a_key, true AS even FROM (SELECT count(*) AS n FROM orders)")(lambda t: (lambda o: o.groupBy("o_orderkey").agg(F.count_distinct("o_orderkey_bucket").alias("d")).agg(F.max("d").alias("d")).join(F.broadcast(o.groupBy("o_orderkey_bucket").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("b")))).select("n", (F.col("d") == 1).alias("one_bucket_a_key"), ((F.col("b") == 16) & (F.col("hi") < 2 * F.col("lo"))).alias("even")))(t("orders").withColumns(apply.partition_columns([{"column": "o_orderkey", "transform": "bucket", "n": 16}]))))
case("audit_table", "SELECT o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) AS day FROM orders")(lambda t: (lambda o: apply.audit(apply.audit(None, o.where("o_orderkey % 2 = 0"), "o_orderdate"), o.where("o_orderkey % 2 <> 0"), "o_orderdate"))(t("orders").select("o_orderkey", "o_orderdate")))
case("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")(lambda t: t("customer").join(t("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey"))
case("range_density", "WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders), r AS (SELECT k, lo + (hi - lo) * k // 8 AS a, lo + (hi - lo) * (k + 1) // 8 AS z, n, lo, hi FROM b, range(8) x(k)) SELECT k, CAST(round(CAST(n * (z - a) AS DOUBLE) / (hi - lo)) AS BIGINT) AS estimated, (SELECT count(*) FROM orders WHERE o_orderkey > a AND o_orderkey <= z) AS rows FROM r")(lambda t: ranges.densities(t("orders"), "o_orderkey", 8))


_PIPELINE_SQL = "SELECT o.o_orderstatus AS status, count(*) AS n, round(sum(l.l_quantity), 2) AS quantity FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderstatus"
case("sql_pipeline", _PIPELINE_SQL.format(orders="orders", lineitem="lineitem"))(lambda t: pipeline.run_sql(t("orders").sparkSession, _PIPELINE_SQL, {"orders": t("orders"), "lineitem": t("lineitem")}))
