import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from knotwork.operators.diff import diff_copies

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "k string, a string, r struct<x:string,y:int>, l array<string>, o timestamp_ntz, record_id string, difference string"


def row(k, a="a", r=("x", 1), arr=("p",), o=0, extra="e"):
    return (k, a, r, list(arr) if arr is not None else None, T0 + dt.timedelta(o) if o is not None else None, extra, "d")


def diff(spark, first, second):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    out = diff_copies(make(first), make(second), "k", ["a", "r.x", "r.y", "l"], ["o"], {"t": "n"})
    assert out.columns == ["t", "record_id", "difference", "first_value", "second_value"]
    return {(r.record_id, r.difference, r.first_value, r.second_value) for r in out.collect()}


def test_equal_and_missing(spark):
    assert diff(spark, [row("1")], [row("1", extra="other")]) == set()
    assert diff(spark, [row("1")], [row("2")]) == {("1", "only_first", None, None), ("2", "only_second", None, None)}
    assert diff(spark, [], []) == set()
    assert diff(spark, [row("1")], []) == {("1", "only_first", None, None)}


def test_values_as_stored(spark):
    assert diff(spark, [row("1", a=None)], [row("1", a="")]) == {("1", "a", None, "")}
    assert diff(spark, [row("1", arr=None)], [row("1", arr=[])]) == {("1", "l", None, "[]")}
    assert diff(spark, [row("1", arr=["a", "b"])], [row("1", arr=["b", "a"])]) == {("1", "l", '["a","b"]', '["b","a"]')}
    assert diff(spark, [row("1", arr=[None])], [row("1", arr=["null"])]) == {("1", "l", "[null]", '["null"]')}
    assert diff(spark, [row("1", r=None)], [row("1", r=(None, None))]) == set()  # fields of a null struct are null
    assert diff(spark, [row("1", r=None)], [row("1", r=("x", None))]) == {("1", "r.x", None, "x")}
    assert diff(spark, [row("1", a="x" * 300_000)], [row("1", a="x" * 300_000)]) == set()


def test_latest_version_counts(spark):
    assert diff(spark, [row("1", "old", o=1), row("1", "new", o=2), row("1", "new", o=2)], [row("1", "new", o=5)]) == set()
    assert diff(spark, [row("1", "old", o=None), row("1", "new", o=0)], [row("1", "new")]) == set()  # a null time is earliest
    tie = [row("1", "p", o=1), row("1", "q", o=1)]
    assert diff(spark, tie, list(reversed(tie))) == set()  # ties: one fixed row whatever the order


def test_null_key_is_one_record(spark):
    assert diff(spark, [row(None), row(None)], []) == {(None, "only_first", None, None)}
    assert diff(spark, [row(None)], [row(None, a="z")]) == {(None, "a", "a", "z")}


def test_hot_key_and_plan(spark):
    rows = [row("hot", o=i) for i in range(300)] + [row(str(i)) for i in range(600)]
    random.Random(1).shuffle(rows)
    assert diff(spark, rows, rows[::-1]) == set()
    df = spark.createDataFrame(rows, SCHEMA)
    plan = diff_copies(df, df, "k", ["a", "l"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["", "v", None]), st.sampled_from([None, (), ("z",)]), st.integers(0, 2)), max_size=6), st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["", "v", None]), st.sampled_from([None, (), ("z",)]), st.integers(0, 2)), max_size=6))
def test_equals_brute_force(spark, first, second):
    def last(rows):
        out = {}
        for k, a, arr, o in rows:
            key = (o, a is not None, a or "", arr is not None, str(list(arr or [])))
            if k not in out or key > out[k][0]:
                out[k] = (key, a, arr)
        return {k: v[1:] for k, v in out.items()}

    x, y = last(first), last(second)
    want = {(k, "only_first") for k in x.keys() - y.keys()} | {(k, "only_second") for k in y.keys() - x.keys()}
    want |= {(k, n) for k in x.keys() & y.keys() for n, i in (("a", 0), ("l", 1)) if x[k][i] != y[k][i]}
    made = diff(spark, [row(k, a, None, arr, o) for k, a, arr, o in first], [row(k, a, None, arr, o) for k, a, arr, o in second])
    assert {m[:2] for m in made} == want


def test_times_inside_arrays_keep_their_microseconds(spark):
    times = lambda us: [("1", [dt.datetime(2025, 1, 1, 0, 0, 0, us)], dt.datetime(2025, 1, 1, 0, 0, 0, us))]
    for kind in ("timestamp_ntz", "timestamp"):
        make = lambda us: spark.createDataFrame(times(us), f"k string, l array<{kind}>, t {kind}")  # noqa: B023, E731
        assert diff_copies(make(123456), make(123456), "k", ["l", "t"]).count() == 0
        assert {r.difference for r in diff_copies(make(123456), make(123999), "k", ["l", "t"]).collect()} == {"l", "t"}
