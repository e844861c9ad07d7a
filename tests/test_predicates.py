import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from orrery.functions import predicate as P
from orrery.operators import predicates as ops

SCHEMA = "i int, l long, d double, f float, s string, b boolean, x binary, n string"
NAN = float("nan")
ROWS = [(5, 5, 5.0, 5.0, "abc", True, bytearray(b"abc"), None), (None, None, NAN, NAN, None, None, None, None), (-1, 9, 2.5, 1.5, "a%c", False, bytearray(b"\0\1"), "n")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize(("text", "want"), [
    ("i = 5", [1, 0, 0]), ("i != 5", [0, 1, 1]), ("i > 4", [1, 0, 0]), ("i >= 5", [1, 0, 0]), ("i < 0", [0, 0, 1]), ("i <= -1", [0, 0, 1]),
    ("i = 5.0", [1, 0, 0]), ("d = 5", [1, 0, 0]), ("l > 5.5", [0, 0, 1]), ("d > 1", [1, 0, 1]), ("d != 5", [0, 1, 1]), ("f >= 1.5", [1, 0, 1]),
    ("i = NULL", [0, 1, 0]), ("i != NULL", [1, 0, 1]), ("i IN (NULL, -1)", [0, 1, 1]), ("i IN (5, 7)", [1, 0, 0]), ("i > NULL", [0, 0, 0]),
    ("missing = NULL", [1, 1, 1]), ("missing != NULL", [0, 0, 0]), ("missing != 3", [1, 1, 1]), ("missing = 3", [0, 0, 0]), ("missing > 3", [0, 0, 0]), ("missing IN (1, NULL)", [1, 1, 1]), ("missing MATCHES 'a'", [0, 0, 0]),
    ("s = 5", [0, 0, 0]), ("s != 5", [1, 1, 1]), ("s > 5", [0, 0, 0]), ("i = '5'", [0, 0, 0]), ("i < 'a'", [0, 0, 0]), ("s > 'ab'", [1, 0, 0]), ("s < 'b'", [1, 0, 1]),
    ("s MATCHES 'b'", [1, 0, 0]), ("s MATCHES '%'", [0, 0, 1]), ("s MATCHES ''", [1, 0, 1]), ("s MATCHES ('zz', 'a')", [1, 0, 1]), ("i MATCHES '5'", [0, 0, 0]),
    ("x MATCHES X'6263'", [1, 0, 0]), ("x MATCHES 'bc'", [0, 0, 0]), ("x = X'0001'", [0, 0, 1]),
    ("b = TRUE", [1, 0, 0]), ("b != TRUE", [0, 1, 1]), ("b > FALSE", [0, 0, 0]), ("b = 1", [0, 0, 0]),
    ("i = 5 AND s = 'abc'", [1, 0, 0]), ("i = 5 OR s = 'a%c'", [1, 0, 1]), ("(i = 5 OR i = NULL) AND n = NULL", [1, 1, 0]), ("(AND)", [1, 1, 1]), ("(OR)", [0, 0, 0]), ("[1] = 9", [0, 0, 1]), ("[40] = NULL", [1, 1, 1]),
])
def test_two_valued_logic(df, text, want):
    p = P.parse(text)
    got = df.select(P.to_column(p, df.schema).alias("v")).collect()
    assert [int(r.v) for r in got] == want
    assert P.parse(P.display(p)) == p


def test_nan_equals_nothing(df):
    for op, want in (("eq", [0, 0, 0]), ("ne", [1, 1, 1]), ("ge", [0, 0, 0])):
        assert [int(r[0]) for r in df.select(P.to_column(P.Pred("d", op, (NAN,)), df.schema)).collect()] == want


leaf = st.builds(lambda f, v: P.Pred(f, v[0], v[1]), st.sampled_from(["a", "b_c", 3]), st.one_of(
    st.tuples(st.sampled_from(["eq", "ne", "gt", "le"]), st.tuples(st.one_of(st.integers(-99, 99), st.floats(-9, 9), st.text(alphabet="a' (),", max_size=5), st.none(), st.booleans(), st.binary(max_size=3)))),
    st.tuples(st.sampled_from(["in", "matches"]), st.lists(st.text(alphabet="a'b", max_size=3), min_size=1, max_size=3).map(tuple)),
))
tree = st.recursive(leaf, lambda c: st.builds(lambda k, x: P.Node(k, tuple(x)), st.sampled_from(["and", "or"]), st.lists(c, min_size=2, max_size=3)), max_leaves=6)


@given(tree)
def test_text_form_is_read_again(p):
    again = P.parse(P.display(p))
    assert P.fingerprint(again) == P.fingerprint(p) and [x.values for x in P.leaves(again)] == [x.values for x in P.leaves(p)]


def test_renderings():
    p = P.parse("a = 1 AND b MATCHES 'x''y'")
    assert P.to_sql(p) == "(a IS NOT DISTINCT FROM 1 AND (coalesce(position('x''y' IN b) > 0, FALSE)))"
    assert P.to_cql(p) == "a = 1 AND b LIKE '%x''y%'"
    assert P.to_cddl(P.Pred("a", "in", (1, 2))) == '{ field: "a", op: "in", comparands: [+ number] }'
    with pytest.raises(ValueError):
        P.to_cql(P.parse("a = 1 OR b = 2"))
    for bad in ("a", "a ~ 1", "a = ", "(a = 1", "a = 1 b = 2", "a = 'x"):
        with pytest.raises(ValueError):
            P.parse(bad)
    with pytest.raises(ValueError):
        P.Pred("a", "eq", (1, 2))


def test_one_scan_for_many(spark, df):
    preds = {i: P.parse(f"i = {i}") for i in range(50)}
    out = ops.evaluate_predicates(df, preds, "l")
    assert [tuple(r) for r in out.collect()] == [(5, 5)]
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    with pytest.raises(ValueError, match="match nothing"):
        ops.guard(out, list(preds))
    assert ops.guard(out, list(preds), allow_empty=True).count() == 1


def test_limit_and_window(spark):
    rows = spark.range(100).withColumnRenamed("id", "o")
    preds = {0: P.parse("o >= 10"), 1: P.parse("o < 5")}
    got = ops.evaluate_predicates(rows, preds, "o", limit=3, window=(2, 50)).collect()
    assert sorted(map(tuple, got)) == [(0, 10), (0, 11), (0, 12), (1, 2), (1, 3), (1, 4)]


@pytest.mark.parametrize("style", ["json", "jsonl", "yaml"])
def test_records_are_read_again(style):
    row = {"a": 1, "b": "x: y", "c": None, "d": True}
    assert ops.parse_record(ops.render(row, style), style) == row


def test_record_statements():
    row = {"a": 1, "b": "it's", "c": 1.5}
    assert ops.render(row, "sql") == "INSERT INTO record (a, b, c) VALUES (1, 'it''s', 1.5);"
    assert ops.render(row, "sqlite_schema") == "CREATE TABLE record (a INTEGER, b TEXT, c REAL);"
    assert ops.render(row, "cql_schema") == "CREATE TABLE record (a bigint, b text, c double);"
    assert ops.render(row, "cddl") == "record = { a: int, b: tstr, c: float }"
    with pytest.raises(ValueError):
        ops.render(row, "other")


def test_label_matches(spark):
    df = spark.createDataFrame([("red, blue",), ("reddish",), (None,)], "t string")
    assert [r[0] for r in df.select(P.label_matches(df.t, "red")).collect()] == [True, False, False]
    assert isinstance(df.schema["t"].dataType, T.StringType)
