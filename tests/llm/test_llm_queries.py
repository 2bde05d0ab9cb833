"""The queries of the text problems as they are registered, on the smallest tables."""

import os
from collections import Counter

import pyarrow.parquet as pq
import pytest

from knotwork.llm import encode, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}


def test_p6(spark):
    found = [tuple(r) for r in queries.p6_found(spark, DATA).collect()]
    texts = {}
    for r in queries.p6_lectures(spark, DATA).collect():
        texts.setdefault(r.lecture_id, []).append((r.text or "", r.look or ""))
    want = set()
    for r in queries.p6_spans(spark, DATA).collect():
        own = texts.get(r.lecture_id, [])
        if r.look and any(r.look in f for _, f in own) and not any(r.span in t for t, _ in own):
            want.add((r.table_name, r.record_id, r.span_no))
    assert len(found) == len(set(found)) > 0 and set(found) == want


def test_p7(spark, documents):
    one = encode.encoder()
    got = {r.doc_id: r.ids for r in queries.p7_ids(spark, DATA).collect()}
    assert got == {k: one(t) if t else [] for k, t in documents.items()}


def test_p8(spark, documents):
    one = encode.encoder()
    sizes = {k: len(one(t)) for k, t in documents.items() if t}
    caps = {r["window_name"]: r["capacity"] for r in pq.read_table(f"{DATA}/context_windows.parquet").to_pylist()}
    rows = queries.p8_pack(spark, DATA).collect()
    load = Counter()
    pieces = {}
    for r in rows:
        load[r.window_name, r.container] += r.n_tokens
        pieces.setdefault((r.window_name, r.doc_id), []).append((r.first_token, r.n_tokens))
    assert all(n <= caps[w] for (w, _), n in load.items())
    for w, cap in caps.items():
        for k, n in sizes.items():
            own = sorted(pieces.pop((w, k), []))
            assert sum(p[1] for p in own) == n and [p[0] for p in own] == [sum(q[1] for q in own[:i]) for i in range(len(own))]
            assert len(own) <= 1 or n > cap
    assert pieces == {}
    fill = {r.window_name: r for r in queries.p8_fill(spark, DATA).collect()}
    assert set(fill) == set(caps) and all(r.n_containers >= r.at_least and 0 < r.fill <= 1 for r in fill.values())


def test_p9(spark, documents):
    found = queries.p9_found(spark, DATA).collect()
    windows = {}
    for k, t in documents.items():
        for i in range(len(t or "") - 159):
            windows.setdefault(hash(t[i : i + 160]), set()).add(k)
    want = set()
    for k, t in documents.items():
        marks = [False] * len(t or "")
        for i in range(len(t or "") - 159):
            if windows[hash(t[i : i + 160])] != {k}:
                marks[i : i + 160] = [True] * 160
        start = None
        for i, m in enumerate([*marks, False]):
            if m and start is None:
                start = i
            elif not m and start is not None:
                want.add((k, start, i))
                start = None
    assert {tuple(r) for r in found} == want
    shared = {r.doc_id: r.n_shared for r in queries.p9_shared(spark, DATA).collect()}
    assert shared == {k: sum(e - s for i, s, e in want if i == k) for k in documents}
