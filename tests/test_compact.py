import datetime as dt
import json

import pytest

from knotwork.functions.records import CONNECTION, RELATION, identified, records_of
from knotwork.operators import compact

FILES = "file_id long, file_path string, feed string, batch_id string, modified_at timestamp_ntz, n_bytes long, content string, record_id string"


def file(i, content, feed="relation", at=0, path=None):
    text = content if isinstance(content, str) or content is None else json.dumps(content)
    return (i, path or f"p/{i}.json", feed, "b", dt.datetime(2025, 1, 1) + dt.timedelta(at), len(text or ""), text, "x")


def rel(n, **kw):
    return {"pair_id": f"rel_dev_{n:08d}", **kw}


@pytest.mark.parametrize(
    ("record", "want"),
    [
        ({"pair_id": "rel_dev_00000007"}, "rel_dev_00000007"), ({"pairId": 7}, "rel_dev_00000007"), ({"id": "7"}, "rel_dev_00000007"), ({"PairID": ["rel_dev_00000007"]}, "rel_dev_00000007"),
        ({"unheard": "rel_dev_00000007"}, "rel_dev_00000007"), ({"attempt_no": 7}, None), ({"labels": ["a", "b"]}, None), ({"artifact_type": "completion_marker"}, None), ([], None), (None, None), ({"pair_id": True}, None), ({"pair_id": -1}, None),
    ],
)
def test_identifier(record, want):
    found = identified(record, RELATION)
    assert (found and found[1]) == want


def test_connection_identifier():
    assert identified({"pair_key": ["conn_dev_pair_00ab"]}, CONNECTION) == ("pair_key", "conn_dev_pair_00ab")
    assert identified({"canonical_pair_id": 12}, CONNECTION) is None


@pytest.mark.parametrize(
    ("text", "n"),
    [('{"pair_id": "rel_dev_00000001"}', 1), ('[{"pair_id": 1}, {"pair_id": 2}]', 2), ('{"results": [{"pair_id": 1}]}', 1), ('{"results": []}', 0), ("", 0), (None, 0), ('{"pair_id": 1', 0), ('{"pair_id": 1} x', 0), ('{"pair_id": NaN}', 0), ("[" * 100_000, 0), ("3", 0), ("crc32:ab", 0), ('{"results": {"pair_id": 1}}', 0)],
)
def test_files_that_hold_records(text, n):
    assert len(records_of(text, RELATION)) == n


FEW = [
    file(1, rel(1, v="old"), at=1), file(2, {"results": [rel(1, v="new"), rel(2)]}, at=5), file(3, "", at=9), file(4, '{"pair_id": "rel_d'), file(5, [rel(3), rel(3)]), file(6, None),
    file(7, {"canonical_pair_id": "conn_dev_pair_0a"}, "connection"), file(8, {"pair_key": ["conn_dev_pair_0a"]}, "connection", 3), file(9, rel(1), "unknown feed"), file(10, rel(4), at=2),
]


def base(store):
    return {(r.feed, r.record_id): (r.n_files, r.file_id) for r in store.base().collect()}


WANT = {("relation", "rel_dev_00000001"): (2, 2), ("relation", "rel_dev_00000002"): (1, 2), ("relation", "rel_dev_00000003"): (1, 5), ("connection", "conn_dev_pair_0a"): (2, 8), ("relation", "rel_dev_00000004"): (1, 10)}


@pytest.mark.parametrize(("target", "fan_in"), [(128 << 20, 1024), (1 << 18, 2)])
def test_each_record_once_with_its_latest_copy(spark, tmp_path, target, fan_in):
    store = compact.Store(spark, f"file://{tmp_path}/s", target, fan_in)
    df = spark.createDataFrame(FEW, FILES).repartition(4)
    store.add(df)
    assert base(store) == WANT
    j = store.journal().filter("level = 1").collect()
    assert sorted(int(i) for r in j for i in r.inputs) == list(range(1, 11))  # every file is some merge's input once


def test_idempotent_and_incremental(spark, tmp_path):
    store = compact.Store(spark, f"file://{tmp_path}/s", 1 << 20, 4)
    df = spark.createDataFrame(FEW, FILES)
    assert store.add(df) == 0
    assert store.add(df) == 0 and base(store) == WANT
    more = spark.createDataFrame([*FEW, file(11, rel(4, v="late"), at=9), file(12, rel(9))], FILES)
    assert store.add(more) == 1
    assert base(store) == {**WANT, ("relation", "rel_dev_00000004"): (2, 11), ("relation", "rel_dev_00000009"): (1, 12)}
    assert store.journal().filter("level = 1 AND generation = 1").selectExpr("sum(size(inputs))").first()[0] == 2


def test_interrupted_generation_is_written_again(spark, tmp_path):
    import shutil

    store = compact.Store(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame(FEW, FILES)
    store.add(df)
    shutil.rmtree(tmp_path / "s/gen=0/journal")
    assert store.base().collect() == []
    store.add(df)
    assert base(store) == WANT


def test_repeated_rows_null_ids_and_empty(spark, tmp_path):
    store = compact.Store(spark, f"file://{tmp_path}/a")
    twice = spark.createDataFrame([*FEW, *FEW, (None, "q", "relation", "b", None, None, json.dumps(rel(8)), "x")], FILES).repartition(3)
    store.add(twice)
    assert {k: v[0] for k, v in base(store).items()} == {**{k: v[0] for k, v in WANT.items()}, ("relation", "rel_dev_00000008"): 1}
    empty = compact.Store(spark, f"file://{tmp_path}/b")
    empty.add(twice.limit(0))
    assert empty.base().collect() == []


def test_levels_merge_until_few(spark, tmp_path):
    rows = [file(i, rel(i % 700, t="x" * 900), at=i) for i in range(1, 1501)]
    store = compact.Store(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan_in=4)
    store.add(spark.createDataFrame(rows, FILES).repartition(6))
    got = base(store)
    assert len(got) == 700 and sum(n for n, _ in got.values()) == 1500
    levels = {r.level for r in store.journal().select("level").distinct().collect()}
    assert levels == {1, 2, 3} and len(list((tmp_path / "s/gen=0/run").glob("*.parquet"))) <= 3
    assert not list((tmp_path / "s/gen=0").glob("level=*"))
    j = store.journal().collect()
    made = {k: sorted(r.output for r in j if r.level == k) for k in (1, 2)}
    used = sorted(i for r in j if r.level == 2 for i in r.inputs)
    assert used == made[1]  # every segment is some merge's input once
    assert sum(r.n_inputs for r in j if r.level == 3) == len(made[2]) and sum(r.n_records for r in j if r.level == 3) == 700
    assert all(r.n_inputs > 1 for r in j if r.level == 2)


def files_under(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_small_add_writes_little_and_full_classes_merge(spark, tmp_path):
    store = compact.Store(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan_in=4)
    store.add(spark.createDataFrame([file(i, rel(i, t="x" * 900), at=i) for i in range(1, 1501)], FILES).repartition(4))
    before = files_under(tmp_path / "s")
    total = sum(p.stat().st_size for p in before)
    store.add(spark.createDataFrame([file(5000, rel(7, t="late"), at=9000), file(5001, rel(5000), at=1)], FILES))
    after = files_under(tmp_path / "s")
    assert all(after[p] == t for p, t in before.items())  # nothing of the old run was written again
    assert sum(p.stat().st_size for p in after if p not in before) < max(total / 2, 60_000)
    got = base(store)
    assert len(got) == 1501 and got["relation", "rel_dev_00000007"] == (2, 5000)
    for n in range(3):
        store.add(spark.createDataFrame([file(6000 + n, rel(6000 + n), at=1), file(7000 + n, rel(8), at=9001 + n)], FILES))
    kinds = [r.kind for r in store.journal().orderBy("generation", "level").collect()]
    assert "runs" in kinds and len(store.runs()) == 2  # four small runs became one, the large one stayed
    assert base(store)["relation", "rel_dev_00000008"] == (4, 7002)
    store.compact()
    assert len(store.runs()) == 1 and len(base(store)) == 1504
    again = store.journal().count()
    store.add(spark.createDataFrame([file(6000, rel(6000), at=1)], FILES))
    assert store.journal().count() == again


def test_record_text_byte_for_byte_and_empty_files_close(spark, tmp_path, monkeypatch):
    texts = ['{"pair_id": 1, "v": 1e400,  "v": 1.50}', '[ {"pair_id":2,"a":{"b":[1, 2 ]}} , {"pair_id": 3, "n": ' + "8" * 5000 + "}]", '{"results": [{"pair_id": 4, "d": ' + '{"d": ' * 20_000 + "1" + "}" * 20_000 + "}]}"]
    store = compact.Store(spark, f"file://{tmp_path}/s")
    store.add(spark.createDataFrame([file(i + 1, t) for i, t in enumerate(texts)] + [file(9, "   ")], FILES))
    got = {r.record_id[-1]: r.record for r in store.base().collect()}
    assert got["1"] == texts[0] and got["2"] == '{"pair_id":2,"a":{"b":[1, 2 ]}}'
    assert got["3"] == '{"pair_id": 3, "n": ' + "8" * 5000 + "}" and got["4"] == texts[2][len('{"results": [') : -2]
    monkeypatch.setattr(compact, "MOST_INPUTS", 50)
    many = compact.Store(spark, f"file://{tmp_path}/m")
    many.add(spark.createDataFrame([file(i, "") for i in range(1, 401)], FILES).repartition(2))
    assert max(r.n_inputs for r in many.journal().filter("level = 1").collect()) == 50
    rows = [(1, "p", "relation", "b", None, 3, "x{}", "x"), (2, "p", "relation", "b", None, 0, None, "x"), (3, "p", "odd", "b", None, 2, "{}", "x"), (4, "p", "relation", "b", None, 2, "{}", "x"), (5, "p", "relation", "b", None, 2, '{"pair_id": 5}', "x")]
    assert {(r.file_id, r.reason) for r in compact.rejected(spark.createDataFrame(rows, FILES)).collect()} == {(1, "not_json"), (2, "empty"), (3, "unknown_feed"), (4, "no_record")}
