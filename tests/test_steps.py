import pytest

from tidemark.functions import sel, steps
from tidemark.functions.division import guarded
from tidemark.functions.types import compatible, dsl, of_source, widened
from tidemark.plans import pipeline


def one(spark, rows, schema, *transforms, **more):
    return [tuple(r) for r in pipeline.run(spark.createDataFrame(rows, schema), {"transforms": list(transforms)}, **more).rows.collect()]


def test_order_and_types(spark):
    assert one(spark, [("3",)], "x_str string", {"type": "cast", "column": "x_str", "to_type": "double", "output_column": "x"}, {"type": "math_op", "expression": "x * 10", "output_column": "y"}) == [("3", 3.0, 30.0)]


def test_strings(spark):
    op = lambda op, **p: {"type": "string_op", "column": "a", "op": op, "params": p}
    assert one(spark, [("1234567890",)], "a string", op("substring", start=1, length=4)) == [("1234",)]
    assert one(spark, [("abc",)], "a string", op("substring", start=0, length=2)) == [("a",)]
    assert one(spark, [(None,)], "a string", op("concat", suffix="x")) == [("x",)]
    assert one(spark, [("  alice  ",)], "a string", op("trim")) == [("alice",)]
    with pytest.raises(ValueError):
        one(spark, [("a",)], "a string", op("reverse"))


def test_masks(spark):
    m = lambda s: {"type": "mask", "column": "a", "strategy": s}
    assert one(spark, [("1234567890",), ("1234",), (None,)], "a string", m("last4")) == [("******7890",), ("1234",), (None,)]
    assert one(spark, [("bob@x.org",), ("bob",)], "a string", m("email")) == [("b***@x.org",), ("***",)]
    assert len(one(spark, [("secret",)], "a string", m("hash"))[0][0]) == 64


def test_json(spark):
    assert one(spark, [('{"name": "alice", "age": 30}',), ('{"age": "x"}',), ("no",)], "p string", {"type": "json_flatten_inline", "column": "p", "json_schema": {"name": "string", "age": "int"}, "keep_original": False})[0] == ("alice", 30)
    spec = {"transforms": [{"type": "json_flatten_child", "id": "t", "column": "tags", "pk": "id"}]}
    df = spark.createDataFrame([(1, '["a",{"q":2},null]'), (2, None), (3, "bad")], "id int, tags string")
    assert sorted(tuple(r) for r in pipeline.run(df, spec).children["t"].collect()) == [(1, "a"), (1, '{"q":2}')]


def test_unknown_step(spark):
    with pytest.raises(ValueError):
        one(spark, [(1,)], "a int", {"type": "nope"})
    assert one(spark, [(1,)], "a int", {"type": "nope"}, strict=False) == [(1,)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("IF(currency = 'USD', amount, amount * fx_rate)", "(CASE WHEN currency = 'USD' THEN amount ELSE amount * fx_rate END)"),
        ("IN(status, 'a', 'b')", "(status IN ('a', 'b'))"),
        ("status IN ('a)', 'b')", "status IN ('a)', 'b')"),
        ("x NOT IN (1, 2)", "x NOT IN (1, 2)"),
        ("IS_NULL(COALESCE(a, b))", "(COALESCE(a, b) IS NULL)"),
        ("NOT_IN(code, UPPER('x'), ',')", "(code NOT IN (UPPER('x'), ','))"),
        ("a ^ 2", "power(a, 2)"),
        ("NOT IN(a, 1)", "NOT (a IN (1))"),
    ],
)
def test_sel(text, want):
    assert sel.to_sql(text).replace("  ", " ") == want


@pytest.mark.parametrize("text", ["IF(a, b)", "IS_NULL(a", "a)", "IN(a)"])
def test_sel_refuses(text):
    with pytest.raises(ValueError):
        sel.to_sql(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("(a + b) / c", "try_divide((a + b), c)"),
        ("sum(a) / count(b)", "try_divide(sum(a), count(b))"),
        ("a / b / c", "try_divide(try_divide(a, b), c)"),
        ("a - b * c / -d", "a - try_divide(b * c, -d)"),
        ("CASE WHEN x / y > 1 THEN 'a/b' ELSE c END / 2", "try_divide(CASE WHEN try_divide(x, y) > 1 THEN 'a/b' ELSE c END, 2)"),
        ("sum(a) OVER (ORDER BY x / y) / m[b / c]", "try_divide(sum(a) OVER (ORDER BY try_divide(x, y)), m[try_divide(b, c)])"),
    ],
)
def test_divisions(text, want):
    assert guarded(text) == want


@pytest.mark.parametrize("text", ["a /", "(a / b", "a / )"])
def test_divisions_refuse(text):
    with pytest.raises(ValueError):
        guarded(text)


def test_preview_and_guarded_math(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double")
    step = {"type": "math_op", "expression": "(a + a) / b", "column": "c", "on_error": "null"}
    assert sorted((r.c for r in pipeline.preview(df, {"transforms": [step]}).collect()), key=str) == [4.0, None]
    assert pipeline.preview(df, {"transforms": [step]}, 1).count() == 1


@pytest.mark.parametrize("text", ["DROP TABLE t", "SELECT 1 +", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)"])
def test_pipelines_in_sql_are_queries(spark, text):
    with pytest.raises(ValueError):
        pipeline.check_sql(spark, text)
    df = spark.range(3)
    assert pipeline.run_sql(spark, "WITH x AS (SELECT id + 1 AS n FROM {t}) SELECT sum(n) AS s FROM x", {"t": df}).first().s == 6


def test_types():
    assert (dsl("Integer"), of_source("VARCHAR(20)"), of_source("decimal(10,2)")) == ("int", "string", "decimal(38,18)")
    assert widened("int", "double") == "double" and widened("int", "string") == "string" and compatible("int", "bigint") and not compatible("double", "int")
    with pytest.raises(ValueError):
        dsl("blob")
    assert dsl("blob", strict=False) == "string"
    assert steps.java_pattern("%Y at %H") == "yyyy 'at' HH"
