import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import pack


def placed(capacity, sizes, **kw):
    """Containers of a plan as lists of lengths."""
    lengths, counts = np.unique(np.array(sizes, np.int64), return_counts=True)
    plan = pack.plan(capacity, lengths, counts, **kw)
    out, seen = defaultdict(list), defaultdict(int)
    for length, rank, n, first, each in sorted(plan.rows):
        assert rank == seen[length]
        seen[length] += n
        for k in range(n):
            out[first + k // each].append(length)
    assert dict(seen) == dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    assert sorted(out) == list(range(plan.next))
    assert all(sum(v) <= capacity for v in out.values())
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))), st.sampled_from([0.0, 0.1, 0.25, 1.0]), st.integers(1, 20))
def test_every_item_once_within_capacity(case, large, groups):
    capacity, sizes = case
    out = placed(capacity, sizes, large=large, groups=groups)
    assert sorted(x for v in out.values() for x in v) == sorted(sizes)


@pytest.mark.parametrize("capacity", [512, 2048, 8192])
def test_little_space_is_left(capacity):
    rng = random.Random(capacity)
    sizes = [min(capacity, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(20_000)]
    out = placed(capacity, sizes)
    assert len(out) <= -(-sum(sizes) // capacity) * 1.01 + 1


def test_no_worse_than_best_fit_decreasing_by_much():
    rng = random.Random(1)
    sizes = [rng.randint(180, 260) for _ in range(3000)]
    assert len(placed(512, sizes)) <= len(placed(512, sizes, large=1.0)) * 1.02


def test_table(spark):
    rows = [(1, 5, "a"), (2, 25, "b"), (3, 0, "c"), (4, None, "d"), (5, 10, "e"), (6, 10, "e"), (6, 10, "e"), (7, 3, "f"), (8, 20, "g"), (9, 2, "h")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, container string")
    windows = spark.createDataFrame([("w", 10), ("v", 7)], "window_name string, capacity int")
    out = pack.packed(df, windows).collect()
    for name, capacity in (("w", 10), ("v", 7)):
        fill, per = defaultdict(int), defaultdict(list)
        for r in out:
            if r.window_name == name:
                fill[r.container] += r.n_tokens
                per[r.doc_id].append((r.first_token, r.n_tokens))
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        assert {k: sum(n for _, n in v) for k, v in per.items()} == {1: 5, 2: 25, 5: 10, 6: 20, 7: 3, 8: 20, 9: 2}
        assert all(len(v) == 1 for k, v in per.items() if k in (1, 7, 9))
        assert sorted(per[2]) == [(a, min(capacity, 25 - a)) for a in range(0, 25, capacity)]
    assert pack.packed(df.limit(0), windows).collect() == []
    assert pack.packed(df, windows.limit(0)).collect() == []
    with pytest.raises(ValueError):
        pack.packed(df, spark.createDataFrame([("w", 0)], "window_name string, capacity int"))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 4)], "n long, size long")
    out = pack.packed(df, spark.createDataFrame([("w", 10)], "window_name string, capacity int"), "n", "size")
    assert sorted((r["n"], r["n_tokens"]) for r in out.collect()) == [(1, 5), (2, 5), (3, 4)]
