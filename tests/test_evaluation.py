"""Evaluation with evidence and alternatives, validators of candidates and connections, keys with null ends."""

import json

from pyspark.sql import functions as F

from knotwork.functions import measures as M
from knotwork.operators import evaluation, matching, metrics, pipelines, scoring, validate

SPANS = "array<struct<lecture_id:string,span:string>>"
EDGE = "struct<source:string,target:string,relation_type:string,symmetric:boolean>"
TEXTS = [("l", "a dense tree and a root"), ("m", "other words")]


def run(spark, rows, decisions=None, **options):
    """``rows`` of (id, category, gold edge, alternatives, gold spans, predicted edge, spans, rationale); one allowed lecture, l."""
    gold = [(i, c, *g, alt, ge, ["l"]) for i, c, g, alt, ge, _, _, _ in rows]
    pred = [(i, *p, pe, why) for i, _, _, _, _, p, pe, why in rows]
    g = spark.createDataFrame(gold, f"id string, category string, source string, target string, relation_type string, symmetric boolean, alternatives array<{EDGE}>, evidence_spans {SPANS}, lectures array<string>")
    p = spark.createDataFrame(pred, f"id string, source string, target string, relation_type string, evidence_spans {SPANS}, rationale string")
    d = spark.createDataFrame(decisions, "id string, decision string") if decisions else None
    return evaluation.relation_facts(p, g, "id", spark.createDataFrame(TEXTS, "lecture_id string, text string"), d, **options)


TREE = [("l", "a dense tree")]
ROWS = [
    ("1", "positive", ("a", "b", "USES", False), None, TREE, ("a", "b", "USES"), TREE, "why"),
    ("2", "positive", ("a", "b", "USES", False), None, TREE, ("b", "a", "USES"), [("l", "no such"), ("m", "other words"), None], " "),
    ("3", "ambiguous", ("a", "b", "RELATED_TO", False), [("b", "a", "REQUIRES", False), ("a", "b", "USES", False)], TREE, ("a", "b", "USES"), [("l", "root")], "why"),
    ("4", "hard_negative", ("a", "b", "NO_RELATION", False), None, [], ("b", "a", "NO_RELATION"), TREE, "why"),
    ("5", "hard_negative", ("a", "b", "NO_RELATION", False), None, None, ("a", "b", "RELATED_TO"), None, None),
    ("6", "schema_gap", ("a", "b", None, False), [], None, (None, "b", None), [], "why"),
    ("7", "positive", ("a", "b", "CONTRASTS_WITH", None), None, TREE, ("b", "a", "CONTRASTS_WITH"), TREE, "why"),
]


def test_facts_and_errors(spark):
    f = run(spark, ROWS, [("3", "not_supported")])
    got = {r.id: r for r in f.collect()}
    assert {i: (r.strict, r.acceptable, r.support) for i, r in got.items()} == {
        "1": (True, True, evaluation.SUPPORTED), "2": (False, False, None), "3": (False, True, "not_supported"), "4": (True, True, None), "5": (False, False, None), "6": (False, False, None), "7": (False, False, None),
    }
    assert (got["2"].n_spans, got["2"].n_exact, got["2"].n_outside, got["2"].n_invalid) == (3, 0, 2, 1)
    errors = {(r.id, r.error_type, r.n) for r in evaluation.relation_errors(f, "id").collect()}
    assert errors == {
        ("2", "missing_rationale", 1), ("2", "evidence_lecture_outside_candidate", 2), ("2", "invalid_evidence_span", 1), ("2", "wrong_direction", 1), ("3", "evidence_does_not_support_relation", 1),
        ("4", "unexpected_evidence_for_no_relation", 1), ("5", "missing_rationale", 1), ("5", "missing_evidence", 1), ("5", "overused_related_to", 1), ("5", "false_positive_relation", 1), ("5", "wrong_relation_type", 1), ("7", "wrong_direction", 1),
    }
    m = evaluation.relation_metrics(f).first()
    assert (m.n_primary, m.strict_accuracy, m.ambiguous_acceptable_accuracy, m.n_pending, m.status) == (5, 0.4, 1.0, 0, "final")
    assert evaluation.relation_metrics(run(spark, ROWS)).first().status == "draft_pending_adjudication"
    none = evaluation.relation_metrics(f.limit(0)).first()
    assert none.n_pairs == 0 and none.strict_accuracy is None and none.status == "final"


def test_the_two_rules_of_matching_differ(spark):
    """The first takes ends in either order only where the edge is marked symmetric, the second also for the symmetric types."""
    first, second = (run(spark, ROWS, unordered=u).filter("id = '7'").first().strict for u in ((metrics.NONE,), metrics.SYMMETRIC))
    assert (first, second) == (False, True)


def test_pipeline_loci(spark):
    f = evaluation.pipeline_facts(run(spark, ROWS), spark.createDataFrame([("2",), ("5",), ("7",), ("7",)], "id string"), "id")
    assert {r.id: r.locus for r in f.collect()} == {"1": "candidate_miss", "2": "wrong_direction", "3": "not_primary_scored", "4": "correct", "5": "false_positive", "6": "not_primary_scored", "7": "wrong_direction"}
    m = evaluation.pipeline_metrics(f).first()
    assert (m.strict_accuracy, m.edge_precision, m.edge_recall, m.n_candidate_miss) == (0.2, 0.0, 0.0, 1)


def test_endpoint_recovery(spark):
    df = spark.createDataFrame([("x", "y", True, False), ("x", "z", True, True), (None, "y", None, False)], "a string, b string, ra boolean, rb boolean")
    r = evaluation.endpoint_recovery(df, ("a", "b"), ("ra", "rb")).first()
    assert (r.n_pairs, r.n_endpoints, r.n_recovered, r.weighted_rate, r.n_both, r.n_one, r.n_none) == (3, 3, 2, 0.5, 1, 1, 1)


def test_half_pairs_meet_nothing(spark):
    a = spark.createDataFrame([(None, "x"), ("y", "x")], "p string, q string")
    b = spark.createDataFrame([("x", "x", "self"), ("x", "y", "ok"), (None, None, "null")], "u string, v string, decision string")
    assert {(r.p, r.decision) for r in matching.unordered_join(a, b, ("p", "q"), ("u", "v")).collect()} == {(None, None), ("y", "ok")}
    refs = spark.createDataFrame([(None, "x"), ("x", None), ("x", "y")], "l string, k string")
    assert [r[0] for r in refs.select(M.ref_label(F.col("l"), F.col("k"))).collect()] == [None, None, "x::y"]
    assert [r[0] is None for r in refs.select(M.pair_id("p", F.col("l"), F.col("k"))).collect()] == [True, True, False]
    gate = metrics.binary_metrics(spark.createDataFrame([(True, None), (None, True), (False, False)], "g boolean, p boolean"), F.col("g"), F.col("p")).first()
    assert (gate.tp, gate.fp, gate.fn, gate.tn, gate.n_unlabelled) == (0, 0, 1, 1, 1)


def test_mismatch_classes_count_the_pairs(spark):
    left = spark.createDataFrame([("k", "g1", "a1"), ("k", "g1", "a2"), ("k", "g2", "a3"), ("j", "g1", "a4"), (None, "g1", "a5")], "key string, g string, id string")
    right = spark.createDataFrame([("k", "g3", "b1"), ("k", "g2", "b2"), ("k", "g4", "b3"), ("i", "g1", "b4")], "key string, g string, id string")
    pairs = [(r.a, r.b) for r in matching.provenance_mismatches(left, right, "key", "g", "id").collect()]
    got = {(r.side, r.id): r.n_links for r in matching.mismatch_classes(left, right, "key", "g", "id").collect()}
    assert got == {**{("left", a): sum(p[0] == a for p in pairs) for a, _ in pairs}, **{("right", b): sum(p[1] == b for p in pairs) for _, b in pairs}} and len(pairs) == 4


def test_contained_is_alike_when_spread(spark, monkeypatch):
    needles = spark.createDataFrame([("l", x) for x in ("a", "tree", "", "zz", None)], "g string, n string")
    texts = spark.createDataFrame([("l", "a tree"), ("l", "none"), ("m", "a")], "g string, t string")
    small = {tuple(r) for r in matching.contained(needles, texts, "g", "n", "t").select("n", "t").collect()}
    monkeypatch.setattr(matching, "SOURCE_BYTES", -1)
    assert {tuple(r) for r in matching.contained(needles, texts, "g", "n", "t").select("n", "t").collect()} == small == {("a", "a tree"), ("tree", "a tree")}


def test_values_are_no_placeholders_and_repair_keeps_its_retries(spark):
    df = spark.createDataFrame([("USES", "{d}", "b")], "t string, s string, d string")
    assert scoring.rendered(df, {"USES": "{s} uses {d}{d}"}, "t", {"s": "s", "d": "d"}).first().text == "{d} uses bb"
    log = []

    def scorer(body):
        log.append(body)
        if len(log) in (1, 3):
            raise scoring.TransportError("busy")
        return "bad" if len(log) == 2 else "good"

    def one_partition(scorer):
        return scoring.scored(spark.createDataFrame([("q",)], "request string").coalesce(1), "request", scorer, retries=1, check=lambda a: None if a == "good" else "bad").first()

    r = one_partition(scorer)
    assert (r.response, r.attempts) == ("good", 4)


def test_the_typer_sees_the_gates_evidence_only(spark):
    items = [("e1", "one"), ("e2", "two")]
    df = spark.createDataFrame([("1", items), ("2", items), ("3", items), ("4", None)], "id string, evidence array<struct<evidence_id:string,span:string>>")
    answer = lambda t, ids: json.dumps({"choices": [{"message": {"content": json.dumps({"relation_type": t, "evidence_ids": ids, "rationale": "r"})}}]})

    def gate(body):
        seen = json.loads(json.loads(body)["messages"][1]["content"])
        return answer("DIRECT" if seen["id"] != "4" else "NO_RELATION", {"1": ["e2"], "2": ["e9"], "3": ["e1", "e1"], "4": []}[seen["id"]])

    def typer(body):
        seen = json.loads(json.loads(body)["messages"][1]["content"])
        return answer("USES" if [e["evidence_id"] for e in seen["evidence"]] == ["e2"] else "REQUIRES", ["e2"])

    out = pipelines.two_stage_classified(df, "id", gate, typer, ["id", "evidence"], evidence="evidence")
    assert {r.id: (r.relation_type, r.error) for r in out.collect()} == {"1": ("USES", None), "2": ("NO_RELATION", "evidence_id_unknown"), "3": ("NO_RELATION", "evidence_id_repeated"), "4": ("NO_RELATION", None)}


def test_candidate_annotations(spark):
    rel = "struct<source:string,target:string,relation_type:string,role:string,symmetric:boolean,evidence_spans:array<string>>"
    schema = f"pair_id string, lecture_id string, ko_a string, ko_b string, candidate_label string, annotation_status string, gold_relations array<{rel}>, out_of_schema struct<relation_description:string,schema_exclusion_rationale:string,evidence_spans:array<string>>, ambiguity struct<rationale:string,competing_interpretations:array<string>,adjudication_status:string>, negative_rationale string, annotation_source string"
    good = ("a", "b", "USES", "primary", False, ["a dense tree"])
    rows = [
        ("1", "l", "a", "b", "IN_SCHEMA_RELATION", "final", [good], None, None, None, "manual"),
        ("2", "l", "a", "b", "NO_IN_SCHEMA_RELATION", "final", [], None, None, "no tie", "manual"),
        ("3", "l", "a", "b", "OUT_OF_SCHEMA_RELATION", "final", None, ("d", "x", ["root"]), None, None, "manual"),
        ("4", "l", "a", "b", "AMBIGUOUS", "final", [], None, ("r", ["x", "y"], "adjudicated_final"), None, "adjudicated"),
        ("5", "l", "a", "b", "IN_SCHEMA_RELATION", "final", [good, good, ("a", "c", "ODD", "other", True, None)], None, None, "no", "manual"),
        ("6", "l", "a", "b", "NO_IN_SCHEMA_RELATION", "draft", [("a", "b", "FORMALIZES", "primary", False, ["no such"])], None, None, None, None),
        ("7", "l", "a", "b", "AMBIGUOUS", "final", None, None, ("r", ["x"], "pending_review"), None, "manual"),
        ("8", "l", "a", "b", None, "final", None, None, None, "x", None),
    ]
    objects = spark.createDataFrame([("l", "a", "Concept"), ("l", "b", "Formula")], "lecture_id string, obj_id string, obj_type string")
    got = {}
    for r in validate.candidates(spark.createDataFrame(rows, schema), objects, spark.createDataFrame(TEXTS, "lecture_id string, text string")).collect():
        got.setdefault(r.key, set()).add(r.violation)
    assert got == {
        "5": {"primary_not_one", "positive_with_other_payload", "relation_repeated", "relation_type_unknown", "ends_not_of_pair", "symmetric_type", "evidence_not_exact"},
        "6": {"status_not_final", "negative_with_relations", "negative_without_rationale", "source_missing", "formalizes_without_formula", "evidence_not_exact"},
        "7": {"ambiguous_incomplete", "ambiguous_not_adjudicated"}, "8": {"label_missing", "payload_without_label"},
    }


def test_connection_audit_files_and_numbers(spark):
    items = "array<struct<evidence_id:string,lecture_id:string,block_index:int,span:string>>"
    gold = [("p1", "a", "b", "IN_SCHEMA_CONNECTION", "manual", True, [("e1", "l", 0, "x")]), ("p2", "a", "b", "NO_IN_SCHEMA_CONNECTION", "default", True, []), ("p2", "a", "c", "NO_IN_SCHEMA_CONNECTION", "explicit_reviewed_decision", True, None), ("p4", "c", "b", "DIAGNOSTIC", None, True, [("e1", "l", 1, "old")])]
    g = spark.createDataFrame(gold, f"pair_id string, a string, b string, category string, origin string, primary boolean, evidence {items}")
    catalog = spark.createDataFrame([("p1", "e1", "l", 0, "x"), ("p2", "e1", "l", 0, "x"), ("p4", "e1", "l", 1, "new")], "pair_id string, evidence_id string, lecture_id string, block_index int, span string")
    places = spark.createDataFrame([("a", "l", 0), ("b", "l", 0), ("c", "l", 3)], "object string, lecture_id string, block_index int")
    found = validate.connections(g, spark.createDataFrame([("p1",), ("p2",), ("p3",)], "pair_id string"), catalog, places)
    assert {(r.key, r.violation) for r in found.collect()} == {
        ("p3", "pair_without_gold"), ("p4", "pair_not_in_universe"), ("p2", "pair_repeated"), ("p4", "evidence_not_in_catalog"), ("p2", "shared_block_negative_unreviewed"), ("p4", "primary_of_other_category"),
    }
    files = spark.createDataFrame([("f1", "i", "h"), ("f2", "j", "h"), ("f3", "i", None), ("f4", None, None)], "file string, id string, h string")
    assert {(r.key, r.violation) for r in validate.files_repeated(files, {"id": F.col("id"), "content": F.col("h")}).collect()} == {("f3", "id"), ("f2", "content")}
    ids = spark.createDataFrame([("r_001",), ("r_2",), ("r_5",), ("x",), ("r_2",)], "id string")
    assert {(r.key, r.violation) for r in validate.contiguous(ids, "id", "r").collect()} == {("r_5", "id_not_contiguous"), ("x", "id_form")}
