"""Laws of row identity, of the text join and of the fingerprint signature, on generated rows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemark.functions import scalars as fn
from tidemark.operators import overlap

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
value = st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1.0, float("nan"), float("inf")]))
rows = st.lists(st.tuples(value, st.one_of(st.none(), st.sampled_from(["", "a", "b", "a|b"]))), min_size=0, max_size=12)


def key(x):
    v, s = x
    return (None if v is None or v != v else 0.0 if v == 0 else v, s)


@SETTINGS
@given(rows, rows)
def test_overlap_is_what_python_says(spark, left, right):
    df = lambda r: spark.createDataFrame([(i, *x) for i, x in enumerate(r)], "_pos long, x double, s string")
    first: dict = {}
    for i, x in enumerate(left):
        first.setdefault(key(x), i)
    want = {(j, first[key(x)]) for j, x in enumerate(right) if key(x) in first}
    got = {(r.r_pos, r.l_pos) for r in overlap.first_match(df(left), df(right), ["x", "s"]).collect()}
    assert got == want
    keys = [key(x) for x in right]
    assert overlap.duplicate_rows(df(right), ["x", "s"]).first().duplicate_rows == len(keys) - len(set(keys))


@SETTINGS
@given(st.lists(st.sampled_from("abcd"), max_size=6))
def test_signature_knows_no_order(spark, tokens):
    a = spark.createDataFrame([(tokens, [*reversed(tokens), *tokens])], "a array<string>, b array<string>")
    r = a.select(fn.set_signature(F.col("a")).alias("a"), fn.set_signature(F.col("b")).alias("b")).first()
    assert r.a == r.b


def test_names_and_digests(spark):
    df = spark.createDataFrame([("X_test", "customer_id", 1.0, float("nan")), ("x_tr", "idle", -0.0, None)], "v string, n string, x double, y double")
    got = df.select(fn.name_side(F.col("v")).alias("s"), fn.has_hint(F.col("n"), ["customer", "_id"]).alias("h"), fn.row_digest(df, ["x", "y"]).alias("d"), fn.json_safe(F.col("y")).alias("j")).collect()
    assert [r.s for r in got] == ["test", "train"] and [r.h for r in got] == [True, False] and got[0].d != got[1].d and got[0].j is None
    same = spark.createDataFrame([(0.0, None)], "x double, y double")
    assert same.select(fn.row_digest(same, ["x", "y"]).alias("d")).first().d == got[1].d
