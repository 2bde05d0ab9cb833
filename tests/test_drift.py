import json

import pytest

from knotwork.functions import records
from knotwork.functions.jsontree import DEEPEST
from knotwork.operators import drift

FIELDS = [("relation", p, t) for p, t in (("pair_id", "string"), ("source.lecture_id", "string"), ("source.ko_id", "string"), ("target.lecture_id", "string"), ("target.ko_id", "string"), ("relation_type", "string"), ("evidence_spans", "array"), ("rationale", "string"))]
FIELDS += [("connection", p, t) for p, t in (("canonical_pair_id", "string"), ("source_canonical_ko_id", "string"), ("target_canonical_ko_id", "string"), ("relation_type", "string"), ("evidence_ids", "array"), ("rationale", "string"))]
GOOD = {"pair_id": "rel_dev_00000001", "source": {"lecture_id": "calculus_001", "ko_id": "dense_tree_12"}, "target": {"lecture_id": "calculus_002", "ko_id": "open_cell_7"}, "relation_type": "USES", "evidence_spans": [{"lecture_id": "calculus_001", "span": "a dense tree"}], "rationale": "Since it is so."}
CONN = {"canonical_pair_id": "conn_dev_pair_00ff", "source_canonical_ko_id": "conn_dev_ko_001", "target_canonical_ko_id": "conn_dev_ko_002", "relation_type": "USES", "evidence_ids": ["evidence_001"], "rationale": "Since it is so."}
FILES = "file_id long, feed string, batch_id string, content string, tags string"


def changed(record, **kw):
    out = json.loads(json.dumps(record))
    for path, value in kw.items():
        at = out
        *steps, last = path.split("__")
        for s in steps:
            at = at[s]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return out


def report(spark, records, feed="relation"):
    rows = [(i, feed, "good", json.dumps(GOOD if feed == "relation" else CONN), "x") for i in range(20)]
    rows += [(100 + i, feed, "b", r if isinstance(r, str) else json.dumps(r), "x") for i, r in enumerate(records)]
    contracts = drift.contracts_from(spark.createDataFrame(FIELDS, "feed string, field_path string, json_type string"))
    union, evidence = drift.infer(spark.createDataFrame(rows, FILES), contracts)
    return {(r.field_path, r.change) for r in drift.changes(union, contracts, evidence).collect() if r.batch_id == "b"}


CASES = [
    (GOOD, set()),
    (changed(GOOD, pair_id=..., pairId=5), {("pair_id", "renamed"), ("pair_id", "type_changed")}),
    (changed(GOOD, pair_id=..., id="rel_dev_00000005"), {("pair_id", "renamed")}),
    (changed(GOOD, rationale=..., justification="For it is so."), {("rationale", "renamed")}),
    (changed(GOOD, rationale=["For it is so."]), {("rationale", "type_changed")}),
    (changed(GOOD, rationale=None), set()),
    (changed(GOOD, rationale=...), {("rationale", "removed")}),
    (changed(GOOD, source=..., from_ref={"lecture_id": "calculus_001", "ko_id": "a_b_1"}), {("source.lecture_id", "renamed"), ("source.ko_id", "renamed")}),
    (changed(GOOD, target=..., target__lecture_id="x_001", target__ko_id="a_b_1") if False else {**changed(GOOD, target=...), "target__lecture_id": "calculus_009", "target__ko_id": "a_b_1"}, {("target.lecture_id", "renamed"), ("target.ko_id", "renamed")}),
    (changed(GOOD, source__ko_id=..., source__object_id="a_b_1"), {("source.ko_id", "renamed")}),
    (changed(GOOD, source__ko_id=7), {("source.ko_id", "type_changed")}),
    (changed(GOOD, source__role="premise"), {("source.role", "added")}),
    (changed(GOOD, source__ko_id=..., source__role="premise"), {("source.role", "added"), ("source.ko_id", "removed")}),
    (changed(GOOD, target__revision=3, confidence=0.5, labels=["pilot"]), {("target.revision", "added"), ("confidence", "added"), ("labels", "added")}),
    (changed(GOOD, evidence_spans={"lecture_id": "l", "span": "s"}), {("evidence_spans", "type_changed")}),
    (changed(GOOD, evidence_spans=..., supporting_spans=[{"lecture_id": "l", "span": "s"}]), {("evidence_spans", "renamed")}),
    (changed(GOOD, relation_type=..., edge_type="USES"), {("relation_type", "renamed")}),
    (changed(GOOD, extra={"a": {"b": 1}}), {("extra", "added")}),
    ('{"pair_id": "rel_dev_0', set()),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_changes(spark, i):
    record, want = CASES[i]
    assert report(spark, [record]) == want


def test_connection_changes(spark):
    record = changed(CONN, source_canonical_ko_id=..., src_canonical_ko_id=43, canonical_pair_id=["conn_dev_pair_00ff"], evidence_ids="evidence_001,evidence_002", relation_type=..., relation="USES")
    want = {("source_canonical_ko_id", "renamed"), ("source_canonical_ko_id", "type_changed"), ("canonical_pair_id", "type_changed"), ("evidence_ids", "type_changed"), ("relation_type", "renamed")}
    assert report(spark, [record], "connection") == want


def test_unified_table_and_alternatives(spark):
    records = [GOOD, changed(GOOD, pair_id=7, rationale=["Why"], evidence_spans={"span": "s", "lecture_id": "l"}, source__ko_id=..., source__koId="k_1"), changed(CONN)]
    rows = [(i, "relation" if i < 2 else "connection", f"b{i}", json.dumps(r), "x") for i, r in enumerate(records)]
    contracts = drift.contracts_from(spark.createDataFrame(FIELDS, "feed string, field_path string, json_type string"))
    files = spark.createDataFrame(rows, FILES)
    union, evidence = drift.infer(files, contracts)
    made = {r.file_id: r for r in drift.unified(files, contracts["relation"], evidence["relation"]).collect()}
    assert set(made) == {0, 1} and made[0].branches == {}
    assert made[1].pair_id == "rel_dev_00000007" and made[1].rationale == "Why" and made[1].source_ko_id == "k_1"
    assert made[1].evidence_spans == ['{"lecture_id": "l", "span": "s"}']
    assert made[1].branches == {"pair_id": "number:7", "rationale": 'array:["Why"]', "evidence_spans": 'object:{"span": "s", "lecture_id": "l"}'}
    types = {(r.field_path, r.json_type): (r.n_records, r.first_batch) for r in drift.alternatives(union).collect() if r.feed == "relation"}
    assert types["pair_id", "number"] == (1, "b1") and types["pair_id", "string"] == (1, "b0")


def test_no_files(spark):
    contracts = drift.contracts_from(spark.createDataFrame(FIELDS, "feed string, field_path string, json_type string"))
    files = spark.createDataFrame([], FILES)
    union, evidence = drift.infer(files, contracts)
    assert drift.changes(union, contracts, evidence).collect() == []
    assert drift.unified(files, contracts["relation"], evidence["relation"]).collect() == []
    nulls = spark.createDataFrame([(1, None, None, None, None), (2, "relation", None, "[1, null]", None)], FILES)
    assert drift.tagged_union(drift.fused(nulls, contracts)).collect() == []


def test_rare_shapes_count(spark):
    """A shape of one value in hundreds is as much a shape of the field as the usual one."""
    rare = changed(CONN, source_canonical_ko_id="free text it is")
    rows = [(i, "connection", "good", json.dumps(CONN), "x") for i in range(300)] + [(400, "connection", "good", json.dumps(rare), "x")]
    rows.append((401, "connection", "b", json.dumps(changed(CONN, source_canonical_ko_id=..., src="more free text", target_canonical_ko_id=..., relation_type=...)), "x"))
    contracts = drift.contracts_from(spark.createDataFrame(FIELDS, "feed string, field_path string, json_type string"))
    union, evidence = drift.infer(spark.createDataFrame(rows, FILES), contracts)
    assert ("source_canonical_ko_id", "renamed") in {(r.field_path, r.change) for r in drift.changes(union, contracts, evidence).collect() if r.batch_id == "b"}


def test_renames_by_evidence_without_a_word_list(spark, monkeypatch):
    """Values of one record in two layouts, then shapes, name a renamed field; no list of synonyms is needed."""
    monkeypatch.setattr(records, "SYNONYMS", {})
    old, new = [], []
    for i in range(6):
        r = changed(GOOD, pair_id=f"rel_dev_{i:08d}", rationale=f"Since {i} it is.", source__ko_id=f"tree_{i}", relation_type=["USES", "REQUIRES"][i % 2])
        old.append(r)
        r = {**r, "blurb": r["rationale"], "sort": r["relation_type"], "head": r["source"], "note": "a text of its own"}
        for gone in ("rationale", "relation_type", "source"):
            del r[gone]
        new.append(r)
    rows = [(i, "relation", "a", json.dumps(r), "x") for i, r in enumerate(old)] + [(100 + i, "relation", "b", json.dumps(r), "x") for i, r in enumerate(new)]
    contracts = drift.contracts_from(spark.createDataFrame(FIELDS, "feed string, field_path string, json_type string"))
    union, evidence = drift.infer(spark.createDataFrame(rows, FILES), contracts)
    got = {(r.field_path, r.change) for r in drift.changes(union, contracts, evidence).collect()}
    assert got == {("rationale", "renamed"), ("relation_type", "renamed"), ("source.ko_id", "renamed"), ("source.lecture_id", "renamed"), ("note", "added")}
    lone = changed(GOOD, target__ko_id=..., target__thing="a_b_1")
    assert report(spark, [lone]) == {("target.ko_id", "renamed")}  # the only unknown member in place of the only missing one
    assert report(spark, [changed(GOOD, rationale=..., confidence=0.5)]) == {("rationale", "removed"), ("confidence", "added")}


def test_deep_records_long_numbers_and_dotted_names(spark):
    deep = json.dumps(GOOD)[:-1] + ', "extra": ' + '{"d": ' * 20_000 + "1" + "}" * 20_000 + ', "count": ' + "9" * 5_000 + "}"
    assert report(spark, [deep]) == {("extra", "added"), ("count", "added")}
    flat = {**changed(GOOD, source=...), "source.lecture_id": "calculus_001", "source.ko_id": "a_b_1"}
    assert report(spark, [flat]) == {("source.lecture_id", "renamed"), ("source.ko_id", "renamed")}
    assert len(drift.tags_of(json.loads('{"d": ' * 900 + "1" + "}" * 900))) == 900 < DEEPEST
    contracts = drift.contracts_from(spark.createDataFrame(FIELDS, "feed string, field_path string, json_type string"))
    files = spark.createDataFrame([(1, "relation", "b", deep, "x"), (2, "relation", "b", json.dumps(flat), "x")], FILES)
    _, evidence = drift.infer(files, contracts)
    made = {r.file_id: r for r in drift.unified(files, contracts["relation"], evidence["relation"]).collect()}
    assert made[1].pair_id == "rel_dev_00000001" and made[2].source_ko_id == "a_b_1"
