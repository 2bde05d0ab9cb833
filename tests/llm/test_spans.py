import random

import pytest

from knotwork.llm import spans

SCHEMA = "doc_id long, text string, anchor string, digest int"


def brute(docs, length):
    owner = {}
    for i, t in docs:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            owner[w] = i if owner.get(w, i) == i else None
    out = set()
    for i, t in docs:
        flags = [False] * len(t)
        for k in range(len(t) - length + 1):
            if owner[t[k : k + length]] is None:
                flags[k : k + length] = [True] * length
        k = 0
        while k < len(t):
            if flags[k]:
                e = k
                while e < len(t) and flags[e]:
                    e += 1
                out.add((i, k, e))
                k = e
            k += 1
    return out


def found(spark, docs, length=160, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    return {tuple(r) for r in spans.shared_spans(df, "doc_id", "text", length, **kw).collect()}


def corpus(seed, n=60, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß東ο🙂") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    docs = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 150))) for _ in range(n)]
    for _ in range(n):
        a, b = rng.randrange(n), rng.randrange(n)
        cut = rng.randint(100, 400)
        at = rng.randrange(max(1, len(docs[a]) - cut))
        to = rng.randrange(len(docs[b]) + 1)
        docs[b] = docs[b][:to] + docs[a][at : at + cut] + docs[b][to:]
    docs += [docs[0], docs[1] + "!", "a" * 500, "a" * 300, "ab" * 200, "ab" * 150, "", "x" * 159, "x" * 159]
    return list(enumerate(docs, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    assert found(spark, docs) == brute(docs, 160)


def test_shuffled_windows_find_the_same(spark):
    docs = corpus(3, 40)
    assert found(spark, docs, together=1) == brute(docs, 160)


def test_joins_without_broadcast_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST_BYTES", -1)
    docs = corpus(4, 40)
    assert found(spark, docs) == brute(docs, 160)


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(spans, "SLICE", 700)
    docs = [(1, corpus(5, 8)[0][1] * 3), *((i + 1, t) for i, t in corpus(5, 8))]
    docs.append((99, "".join(t for _, t in docs)))
    assert found(spark, docs) == brute(docs, 160)


def test_other_length(spark):
    docs = corpus(6, 30)
    assert found(spark, docs, 40, context=16) == brute(docs, 40)
    with pytest.raises(ValueError):
        found(spark, docs, 40, context=64)


def test_cases(spark):
    t = "0123456789" * 20
    assert found(spark, [(1, t), (1, t)]) == set()  # one record delivered twice
    assert found(spark, [(1, t + "abc" + t)]) == set()  # a repeat inside one record
    assert found(spark, [(1, t), (2, t), (None, t), (3, None), (4, "")]) == {(1, 0, 200), (2, 0, 200)}
    assert found(spark, []) == set()
    assert found(spark, [(1, "x" * 159), (2, "x" * 159)]) == set()
    assert found(spark, [(1, "x" * 160), (2, "x" * 160)]) == {(1, 0, 160), (2, 0, 160)}


def test_a_third_are_copies(spark):
    rng = random.Random(9)
    short = "".join(rng.choice("abcdefgh ") for _ in range(200))
    docs = [(i, short if i % 3 == 0 else "".join(rng.choice("abcdefgh ") for _ in range(200))) for i in range(600)]
    assert found(spark, docs) == {(i, 0, 200) for i in range(0, 600, 3)}
