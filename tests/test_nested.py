import json
import random

from knotwork.operators import nested

LISTS = ["results", "results.spans", "results.attempts", "results.attempts.errors"]


def run(spark, bodies, **kw):
    df = spark.createDataFrame([(f"r{i}", b if b is None or isinstance(b, str) else json.dumps(b), "x") for i, b in enumerate(bodies)], "id string, body string, path string")
    return nested.triples(df, "id", "body", LISTS, **kw)


def test_triples(spark):
    body = {"a": {"b": 1, "t": None}, "n": "2.0", "results": [{"p": "x", "spans": {"s": "one"}}, None, {"attempts": [None, {"errors": {"m": True}}], "spans": []}]}
    got = {(r.path, tuple(r.ordinals), r.json_type, r.value) for r in run(spark, [body]).collect()}
    assert got == {
        ("", (), "object", None), ("a", (), "object", None), ("a.b", (), "number", "1"), ("a.t", (), "null", None), ("n", (), "string", "2.0"),
        ("results", (0,), "object", None), ("results.p", (0,), "string", "x"), ("results.spans", (0, 0), "object", None), ("results.spans.s", (0, 0), "string", "one"),
        ("results", (1,), "null", None), ("results", (2,), "object", None), ("results.attempts", (2, 0), "null", None), ("results.attempts", (2, 1), "object", None),
        ("results.attempts.errors", (2, 1, 0), "object", None), ("results.attempts.errors.m", (2, 1, 0), "boolean", "true"),
    }


def test_odd_bodies(spark):
    deep = "x"
    for _ in range(500):
        deep = {"d": deep}
    bodies = [None, "", "{", "[1, 2]", "3", {"results": "text"}, {"results": {"p": 1}}, {"list": [1, [2]]}, deep, {"results": [[{"p": 1}]]}, '{"a": "\\ud800"}']
    rows = run(spark, bodies).collect()
    by = {}
    for r in rows:
        by.setdefault(r.key, []).append((r.path, tuple(r.ordinals), r.json_type, r.value))
    assert "r0" not in by and "r1" not in by and "r2" not in by
    assert by["r5"] == [("", (), "object", None), ("results", (0,), "string", "text")]
    assert ("results", (0,), "object", None) in by["r6"]
    assert ("list", (), "array", "[1, [2]]") in by["r7"]
    assert len(by["r8"]) == 501
    assert ("a", (), "string", "?") in by["r10"]


def test_inferred_lists(spark):
    df = spark.createDataFrame([("1", json.dumps({"results": [{"spans": [{"a": 1}], "n": [1, 2]}]})), ("2", json.dumps({"results": {"spans": {"a": 1}}})), ("3", None)], "id string, body string")
    assert nested.repeated_paths(df, "body") == ["results", "results.spans"]
    assert nested.repeated_paths(df.limit(0), "body") == []


def test_flat_tables_link_and_rebuild(spark):
    rng = random.Random(4)
    bodies = []
    for _ in range(20):
        bodies.append({"v": str(rng.random()), "results": [{"p": str(i), "attempts": [{"ms": rng.randint(1, 9), "errors": [{"m": str(k)} for k in range(rng.randint(0, 2))]} for _ in range(rng.randint(0, 3))]} for i in range(rng.randint(0, 3))]})
    found = spark.createDataFrame([(f"r{i}", json.dumps(b)) for i, b in enumerate(bodies)], "id string, body string")
    rows = nested.flattened(found, "id", "body", LISTS)
    flat = lambda group, **cols: nested.table_of(rows, group, cols, LISTS).collect()
    top = {r.key: r.v for r in flat("", v="v")}
    res = {(r.key, r.results_no): r.p for r in flat("results", p="results.p")}
    att = {(r.key, r.results_no, r.results_attempts_no): r.ms for r in flat("results.attempts", ms="results.attempts.ms")}
    err = {(r.key, r.results_no, r.results_attempts_no, r.results_attempts_errors_no): r.m for r in flat("results.attempts.errors", m="results.attempts.errors.m")}
    for i, body in enumerate(bodies):
        k = f"r{i}"
        assert top[k] == body["v"]
        for a, r in enumerate(body["results"]):
            assert res[k, a] == r["p"]
            for b, t in enumerate(r["attempts"]):
                assert att[k, a, b] == str(t["ms"])
                assert [err[k, a, b, c] for c in range(len(t["errors"]))] == [e["m"] for e in t["errors"]]
    assert len(res) == sum(len(b["results"]) for b in bodies) and all(p[:-1] in att for p in err) and all(p[:-1] in res for p in att)


def test_latest_delivery(spark):
    df = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("a", "3", 2), (None, "x", 1), ("b", None, 5), ("b", "old", 4)], "id string, body string, o int")
    assert {r.key: r.body for r in nested.latest_delivery(df, "id", "body", ["o"]).collect()} == {"a": "3", None: "x", "b": None}


def test_depth_and_numbers_have_no_limit(spark):
    deep = '{"results": [{"p": "1", "x": ' + '{"d":' * 100_000 + "1" + "}" * 100_000 + ', "n": ' + "7" * 5_000 + ', "e": 1e400, "q": 1.50}]}'
    df = spark.createDataFrame([("deep", deep)], "id string, body string")
    assert nested.rejected(df, "id", "body").collect() == []
    only = nested.flattened(df, "id", "body", LISTS, ["results"], ["results.p", "results.n", "results.e", "results.q"]).first()
    assert only.fields == {"results.p": "1", "results.n": "7" * 5_000, "results.e": "1e400", "results.q": "1.50"}
    every = nested.flattened(df, "id", "body", LISTS).filter("group = 'results'").first().fields
    (path, rest) = next((p, v) for p, v in every.items() if v and v.startswith("{"))
    assert path.count(".d") == nested.DEEPEST - 2 and rest.count("{") == 100_000 - (nested.DEEPEST - 2)
    assert nested.repeated_paths(df, "body") == ["results"]


def test_names_with_dots_lists_in_lists_and_repeated_members(spark):
    body = '{"a.b": 1, "a": {"b": 2, "c\\\\d": 3}, "results": [[{"p": 1}], 4, {"p": "x"}], "a": {"b": 5}, "t": {}}'
    got = {(r.path, tuple(r.ordinals), r.json_type, r.value) for r in run(spark, [body]).collect()}
    assert got == {
        ("", (), "object", None), ("a\\.b", (), "number", "1"), ("a", (), "object", None), ("a.b", (), "number", "5"), ("results", (0,), "array", '[{"p": 1}]'),
        ("results", (1,), "number", "4"), ("results", (2,), "object", None), ("results.p", (2,), "string", "x"), ("t", (), "object", None),
    }


def test_new_lists_and_fields_are_rows_too(spark):
    body = {"new": [None, {"k": 1, "more": [{"z": True}]}], "plain": [1, 2], "results": {"p": 1, "extra": {"deep": "x"}}}
    df = spark.createDataFrame([("r", json.dumps(body))], "id string, body string")
    rows = nested.flattened(df, "id", "body", LISTS)
    got = {(r.group, tuple(r.ordinals)): r.fields for r in rows.collect()}
    assert got == {("", ()): {"plain": "[1, 2]"}, ("new", (1,)): {"new.k": "1"}, ("new.more", (1, 0)): {"new.more.z": "true"}, ("results", (0,)): {"results.p": "1", "results.extra.deep": "x"}}
    one = nested.table_of(rows, "results", {"p": "results.p"}, LISTS).first()
    assert one.p == "1" and one.results_no == 0 and one.others == {"results.extra.deep": "x"}


def test_rejects(spark):
    df = spark.createDataFrame([("a", None), ("b", " "), ("c", '{"x": 1'), ("d", "{}"), (None, "{} {}")], "id string, body string")
    assert {(r.key, r.reason) for r in nested.rejected(df, "id", "body").collect()} == {("a", "null"), ("b", "empty"), ("c", "not_json"), (None, "not_json")}
    assert nested.rejected(df.limit(0), "id", "body").collect() == []
