import datetime as dt
import random

import pytest

from knotwork.operators import orphans

PARENT = "l string, k string, c timestamp_ntz, d timestamp_ntz, slot string"
CHILD = "id string, r struct<l:string,k:string>, at timestamp_ntz, carry string"


def t(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)


def found(spark, parents, children, slot="day"):
    p = spark.createDataFrame([(a, b, t(c), t(d), "x") for a, b, c, d in parents], PARENT)
    c = spark.createDataFrame([(i, r, t(at), "x") for i, r, at in children], CHILD)
    keys = [orphans.parent_keys(p, "p", ["l", "k"], "c", "d"), orphans.child_keys(c, "p", ["r.l", "r.k"], "child", "id", "r.k", "at")]
    return orphans.orphans(keys, slot)


def ids(df):
    return sorted(r.record_id for r in df.collect())


@pytest.mark.parametrize("slot", ["hour", "day", "month"])
def test_time_of_the_reference(spark, slot):
    parents = [("a", "x", 10, 20), ("a", "x", 30, None), ("a", "y", 5, 5), ("a", "z", 9, 3), (None, "n", 1, None), ("b", "late", 1000, None), ("a", "never", None, None), ("a", "x", 10, 20)]
    children = [("c09", ("a", "x"), 9), ("c10", ("a", "x"), 10), ("c19", ("a", "x"), 19), ("c20", ("a", "x"), 20), ("c25", ("a", "x"), 25), ("c30", ("a", "x"), 30), ("c99", ("a", "x"), 999),
                ("y", ("a", "y"), 5), ("z", ("a", "z"), 9), ("n", (None, "n"), 5), ("early", ("b", "late"), 999), ("now", ("b", "late"), 1000), ("nv", ("a", "never"), 7),
                ("none", ("a", None), 5), ("nostruct", None, 5), ("notime", ("a", "x"), None), ("gone", ("q", "q"), 5), ("gone", ("q", "q"), 5)]
    assert ids(found(spark, parents, children, slot)) == sorted(["c09", "c20", "c25", "y", "z", "n", "early", "nv", "notime", "gone", "gone"])


def test_empty_tables(spark):
    assert ids(found(spark, [], [("a", ("l", "k"), 1)])) == ["a"]
    assert ids(found(spark, [("l", "k", 0, None)], [])) == []


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 3 + list("abcd")
    parents = [("l", rng.choice(keys), rng.randint(0, 200), rng.choice([None, rng.randint(0, 220)])) for _ in range(60)]
    children = [(str(i), ("l", rng.choice([*keys, "e"])), rng.randint(-5, 230)) for i in range(400)]
    alive = lambda r, at: any((a, b) == r and c <= at and (d is None or d > at) for a, b, c, d in parents)
    assert ids(found(spark, parents, children)) == sorted(i for i, r, at in children if not alive(r, at))


def test_counts_by_period(spark):
    rows = orphans.by_period(found(spark, [], [("a", ("l", "k"), 1), ("a", ("l", "k"), 2), ("b", ("l", "k"), 800)])).collect()
    assert sorted((r.table_name, r.field_name, r.period.month, r.n_references, r.n_records) for r in rows) == [("child", "r.k", 1, 2, 1), ("child", "r.k", 2, 1, 1)]
