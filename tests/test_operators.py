import json
import random

import pytest
from pyspark.sql import functions as F

from knotwork.functions import measures as M
from knotwork.functions import text as X
from knotwork.operators import audit, clusters, evidence, matching, metrics, pairs, pipelines, scoring, validate


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()), key=str)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("name", "key"), [("  Newton’s   Method ", "newton's method"), ("Ｆｕｌｌ–Width", "full-width"), ("Straße", "strasse"), ("a b", "a b"), ("", ""), (None, None)])
def test_name_key(spark, name, key):
    assert one(spark, name, X.name_key) == key
    if name != "Ｆｕｌｌ–Width":
        assert one(spark, name, X.name_key_native) == key


def test_name_audit(spark):
    got = one(spark, "  **Newton’s  Method** ", X.name_audit)
    assert got.key == "newton's method" and got.operations == ["unicode_normalization", "apostrophe_normalization", "trim_whitespace", "outer_wrapper_removed:bold", "collapse_whitespace", "casefold"]
    assert one(spark, "plain", X.name_audit).operations == []
    assert one(spark, "****", X.name_audit).key == "****"
    assert one(spark, "  ", X.name_audit) is None and one(spark, None, X.name_audit) is None


def test_tokens_and_blocks(spark):
    assert one(spark, "The use of A and B's", X.token_set) == ["use", "b", "s"]
    assert one(spark, "the of", X.lexical_tokens) == ["the", "of"]
    assert one(spark, "newton's fixed-point", X.name_words) == ["newton", "fixed", "point"]
    assert one(spark, "a\n\n b \n\n\n\nb", X.blocks) == ["a", "b", "b"]
    assert one(spark, "meta\n---\na\n\nb\n---\nc", X.body_blocks) == ["a", "b\n---\nc"]
    assert one(spark, "no separator", X.body_blocks) is None
    assert one(spark, "a\n \t\nb\n\na", X.exact_blocks) == ["a", "b"]
    assert one(spark, "a\n\n$$x$$\n\nb\n\n\\[y\\]", X.math_blocks) == ["a\n\n$$x$$", "b\n\n\\[y\\]"]
    assert one(spark, "$$x$$\n\na", X.math_blocks) == ["$$x$$", "a"]
    assert one(spark, "m\n---\n\nbody ", X.lecture_body) == "body\n" and one(spark, " only ", X.lecture_body) == "only\n"
    assert one(spark, "# A\none\n# B\ntwo\n---\nthree", lambda x: X.section(x, "B")) == "two" and one(spark, "x", lambda x: X.section(x, "B")) is None
    assert one(spark, ["\\alpha x_1 f(x)", None, "Q2"], X.symbol_tokens, "array<string>") == ["\\alpha", "x", "f", "q2"]


def test_phrases(spark):
    df = spark.createDataFrame([("gradient", "the gradients"), ("ab cd", "x ab-cd y"), ("ab", "xab c"), ("ab", "a b"), ("", "a"), ("!", "a")], "p string, t string")
    assert [r[0] for r in df.select(X.phrase_present(F.col("p"), F.col("t"))).collect()] == [True, True, True, False, False, False]
    assert one(spark, "abc", lambda x: X.exact_span(x, F.lit(""))) is False and one(spark, None, lambda x: X.exact_span(x, F.lit("a"))) is False


def test_measures(spark):
    df = spark.createDataFrame([(1, 0), (1, 4), (None, 2)], "n int, d int")
    assert [r[0] for r in df.select(M.ratio(F.col("n"), F.col("d"))).collect()] == [None, 0.25, None]
    ids = spark.createDataFrame([("a", "b")], "a string, b string").select(M.pair_id("p_", F.col("a"), F.col("b")).alias("x"), M.pair_id("p_", F.col("b"), F.col("a")).alias("y")).first()
    import hashlib

    assert ids.x == ids.y == "p_" + hashlib.sha256(b"connection_pair_v0.1|a|b").hexdigest()[:16]
    edges = spark.createDataFrame([("a", "b", "b", "a", True), ("a", "b", "b", "a", False), ("a", None, "a", None, True), ("a", "b", "a", "b", False)], "s string, t string, gs string, gt string, sym boolean")
    k = F.lit("USES")
    assert [r[0] for r in edges.select(M.same_edge(F.col("s"), F.col("t"), k, F.col("gs"), F.col("gt"), k, F.col("sym"))).collect()] == [True, False, False, True]


def test_numbered_is_total(spark):
    df = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)], "v int, no_ string").repartition(5)
    assert values(pairs.numbered(df, ["v"]), "v", "no") == sorted([(i, i + 1) for i in range(101)], key=str)
    assert pairs.numbered(df.limit(0), ["v"]).collect() == []


def test_pair_universes(spark):
    df = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("g", 3), ("h", 1), (None, 4), ("h", None)], "g string, k int")
    assert values(pairs.local_universe(df, "g", "k")) == [("g", 1, 2), ("g", 1, 3), ("g", 2, 3)]
    assert values(pairs.universe_counts(df, "g", "k")) == [("g", 3, 3), ("h", 1, 0)]


def test_weighted_jaccard_equals_brute_force(spark):
    import math

    rng = random.Random(2)
    objects = [(i, "b", [rng.choice("pqrstuv") for _ in range(rng.randint(0, 4))]) for i in range(30)]
    df = spark.createDataFrame(objects, "k int, token string, t array<string>")
    weights = pairs.idf(df, "k", "t")
    got = {(r.a, r.b): r.weighted_jaccard for r in pairs.weighted_jaccard(df, ["token"], "k", "t", weights).collect()}
    freq = {t: sum(t in o[2] for o in objects) for t in "pqrstuv"}
    w = {t: math.log(31 / (n + 1)) + 1 for t, n in freq.items()}
    for a, _, ta in objects:
        for b, _, tb in objects:
            if a < b and set(ta) & set(tb):
                want = sum(w[t] for t in set(ta) & set(tb)) / sum(w[t] for t in set(ta) | set(tb))
                assert abs(got.pop((a, b)) - want) < 1e-9
    assert got == {}
    with pytest.raises(ValueError):
        pairs.weighted_jaccard(df.withColumnRenamed("token", "b"), ["b"], "k", "t", weights)


def test_rank_and_retention(spark):
    df = spark.createDataFrame([("g", i, float(i % 3)) for i in range(7)], "g string, id int, s double")
    r = pairs.ranked(df, "s", ["id"], ["g"])
    assert [x.id for x in r.orderBy("rank").collect()] == [2, 5, 1, 4, 0, 3, 6]
    assert values(pairs.ranked(df, "s", ["id"]), "id", "rank") == values(r, "id", "rank")
    sizes = lambda n: spark.createDataFrame([("g", n)], "g string, n_pairs long")
    assert sorted(x.rank for x in pairs.top_fraction(r, sizes(7), 0.5, ["g"]).collect()) == [1, 2, 3]
    assert pairs.top_fraction(r, sizes(1), 0.1, ["g"]).count() == 1 and pairs.top_fraction(r, sizes(100), 0.5, ["g"]).count() == 7
    two = spark.createDataFrame([(None, 1, 1.0), (None, 2, 3.0), ("h", 3, 2.0), ("h", 4, None)], "g string, id int, s double")
    assert values(pairs.ranked(two, "s", ["id"], ["g"]), "id", "rank") == [(1, 2), (2, 1), (3, 2), (4, 1)]


@pytest.mark.parametrize(("seed", "fraction", "kinds"), [(5, 0.8, "CM"), (7, 0.55, "CMF"), (8, 0.95, "C"), (9, 0.02, "CM")])
def test_connection_candidates_equal_brute_force(spark, monkeypatch, seed, fraction, kinds):
    """The kept pairs are those of the whole universe, tail included, wherever the cut falls."""
    import math

    monkeypatch.setattr(pairs, "BLOCK", 7)
    rng = random.Random(seed)
    objects = [(f"k{i:02}", sorted({rng.choice("lmnop") for _ in range(rng.randint(1, 2))}), [rng.choice("pqrstuvw") for _ in range(rng.randint(0, 3))], rng.choice([*kinds, None])) for i in range(24)]
    df = spark.createDataFrame([*objects, objects[3], (None, ["l"], [], "C"), ("zz", [], ["p"], "C"), ("zzz", None, ["p"], "C")], "k string, l array<string>, t array<string>, kind string")
    w = {t: math.log((len(objects) + 1) / (sum(t in o[2] for o in objects) + 1)) + 1 for t in "pqrstuvw"}
    universe = [(a, b) for a in objects for b in objects if a[0] < b[0] and any(x != y for x in a[1] for y in b[1])]

    def scores(method):
        rows = []
        for a, b in universe:
            both, shared, met = set(a[2]) | set(b[2]), bool(set(a[1]) & set(b[1])), bool(set(a[2]) & set(b[2]))
            lexical = (sum(w[t] for t in set(a[2]) & set(b[2])) / sum(w[t] for t in both) if met else 0) + 0.03 * (a[3] != b[3])
            hybrid = method == "hybrid_provenance_lexical"
            rows.append((-round(lexical + shared * hybrid, 9), a[0], b[0], met or (shared and hybrid)))
        return sorted(rows)

    for method in pairs.METHODS[2:]:
        rows = scores(method)
        kept = rows[: max(1, math.floor(len(rows) * fraction))]
        got, tail = pairs.connection_candidates(df, "k", "l", "t", method, fraction, kind="kind")
        assert {(-round(r.score, 9), r.a, r.b) for r in got.collect()} == {r[:3] for r in kept if r[3]}, method
        place = {(r[1], r[2]): i for i, r in enumerate(rows, 1)}
        assert all(r["rank"] == (place[r.a, r.b] if r.score > 0.03 else None) for r in got.collect())
        made = set()
        for t in tail.collect():
            own = [r[1:3] for r in rows if not r[3] and -r[0] == t.score]
            assert t.n_pairs == len(own) and (t.last_a is None) == (t.n_kept in (0, t.n_pairs))
            assert t.last_a is None or sum(p <= (t.last_a, t.last_b) for p in own) == t.n_kept
            made |= {(-t.score, *p) for p in own[: t.n_kept]}
        assert made == {r[:3] for r in kept if not r[3]}, method
    bridge, none = pairs.connection_candidates(df, "k", "l", "t", "overlap_bridge")
    assert [(r.a, r.b) for r in bridge.orderBy("rank").collect()] == sorted((a[0], b[0]) for a, b in universe if set(a[1]) & set(b[1])) and none.collect() == []
    assert pairs.connection_candidates(df, "k", "l", "t", "all_pairs")[1].first().n_kept == len(universe)
    if seed == 5:
        for method in pairs.METHODS:
            empty, tail = pairs.connection_candidates(df.limit(0), "k", "l", "t", method)
            assert empty.collect() == [] and all(r.n_pairs == 0 for r in tail.collect())
        with pytest.raises(ValueError):
            pairs.connection_candidates(df, "k", "l", "t", "other")


def test_scoped_universe_equals_brute_force(spark):
    rng = random.Random(6)
    places = [(f"l{i}", rng.choice(["c1", "c2", "c3", None]), rng.choice(["t1", "t2", "t3"])) for i in range(7)]
    objects = {f"k{i:02}": sorted(rng.sample([p[0] for p in places], rng.randint(1, 3))) for i in range(30)}
    df = spark.createDataFrame([(k, x) for k, ls in objects.items() for x in ls], "k string, l string")
    at, want = {p[0]: p for p in places}, {}
    for a in objects:
        for b in objects:
            if a < b and (combos := [(at[x], at[y]) for x in objects[a] for y in objects[b] if x != y]):
                shared = "overlapping_provenance" if set(objects[a]) & set(objects[b]) else "disjoint_provenance"
                want[a, b] = (shared, *(any((x[i] == y[i]) == same for x, y in combos) for i in (1, 2) for same in (True, False)))
    got = pairs.scoped_universe(df, "k", "l", spark.createDataFrame(places, "lecture string, course string, topic string"))
    assert {(r.a, r.b): (r.stratum, r.same_course_cross_lecture, r.cross_course, r.same_topic_cross_lecture, r.cross_topic) for r in got.collect()} == want


def test_rule_decisions(spark):
    blocks = spark.createDataFrame([("l", 0, "The Ｆｕｌｌ  rank matters."), ("l", 1, "nothing"), ("l", 2, "Newton step"), ("l", 3, "x"), ("l", 4, "y"), ("l", 5, "Momentum is based on the step of inertia"), ("m", 0, "full rank")], "g string, block_index int, span string")
    rows = [
        ("l", "1", "Matrix", ["full rank"]), ("l", "2", "Newton step", None), ("l", "3", "inertia", ["no such span"]), ("l", "4", "momentum", []), ("l", "5", "Alpha", [r"\\beta and Q"]), ("l", "6", "Gamma", [r"\\beta", None]),
        ("l", "7", "Newton method", []), ("l", "8", "nothing", []), ("m", "9", "Matrix", []), (None, "10", "Matrix", []),
    ]
    df = spark.createDataFrame(rows, "g string, id string, n string, s array<string>")
    rows = pairs.rule_decisions(df, blocks, "g", "id", "n", "s").collect()
    assert len(rows) == 28 and all(r.selected == bool(r.reasons) and (r.exclusion_reason is None) == r.selected for r in rows)
    assert {(r.a, r.b): r.reasons for r in rows if r.selected} == {
        ("1", "8"): ["source_proximity"], ("2", "8"): ["source_proximity"], ("2", "7"): ["lexical_overlap"], ("3", "4"): ["source_proximity", "explicit_reference"], ("5", "6"): ["symbol_overlap"],
    }


def test_identity_reasons(spark):
    rows = [("l", "1", "Concept", "Gradient Descent", ["s1"]), ("l", "2", "Concept", "gradient–descent", []), ("l", "3", "Concept", "GD", None), ("l", "4", "Concept", "gradient", ["s1"]), ("l", "5", "Method", "GD", []), ("l", "6", "Concept", "gradient descent", [None]), ("m", "7", "Concept", "GD", []), ("l", "8", None, "GD", []), ("l", "9", "Concept", "other", [])]
    df = spark.createDataFrame(rows, "g string, id string, t string, n string, s array<string>")
    got = {(r.a, r.b): r.reasons for r in pairs.identity_candidates(df, "g", "id", "t", "n", "s").collect()}
    assert got == {
        ("1", "2"): ["name_token_equivalence"], ("1", "6"): ["exact_normalized_name"], ("2", "6"): ["name_token_equivalence"], ("1", "3"): ["initialism_name_match"], ("2", "3"): ["initialism_name_match"], ("3", "6"): ["initialism_name_match"],
        ("1", "4"): ["name_token_containment", "exact_source_span"], ("2", "4"): ["name_token_containment"], ("4", "6"): ["name_token_containment"],
    }


def test_identity_over_all_lectures(spark):
    rows = [("l::1", "Concept", "Naïve Bayes", ["s1"]), ("m::1", "Concept", "naive bayes", []), ("m::2", "Concept", "NAIVE BAYES", None), ("n::1", "Concept", "NB", ["s2"]), ("n::2", "Method", "naive bayes", ["s1"]), ("o::1", "Concept", "bayes", ["s1", "s2"]), ("p::1", "Concept", "++", []), ("q::1", "Concept", "--", [])]
    df = spark.createDataFrame(rows, "id string, t string, n string, s array<string>")
    aliases = spark.createDataFrame([("naïve bayes", "naive bayes", "Concept"), ("nb", "naive bayes", "Method")], "alias string, alias_key string, type string")
    found = pairs.identity_candidates(df, None, "id", "t", "n", "s", aliases)
    assert found.columns == ["a", "b", "reasons"]
    assert {(r.a, r.b): r.reasons for r in found.collect()} == {
        ("m::1", "m::2"): ["exact_normalized_name"], ("l::1", "m::1"): ["frozen_alias_identity"], ("l::1", "m::2"): ["frozen_alias_identity"], ("m::1", "n::1"): ["initialism_name_match"], ("m::2", "n::1"): ["initialism_name_match"],
        ("l::1", "o::1"): ["name_token_containment", "exact_source_span"], ("m::1", "o::1"): ["name_token_containment"], ("m::2", "o::1"): ["name_token_containment"], ("n::1", "o::1"): ["exact_source_span"], ("p::1", "q::1"): ["name_token_equivalence"],
    }


def test_rule_reasons(spark):
    df = spark.createDataFrame([(1, 0, 0, False), (2, 1, 0, None), (None, 0, 2, True), (None, 0, 0, False)], "d int, w int, s int, c boolean")
    assert [r[0] for r in df.select(pairs.rule_reasons(F.col("d"), F.col("w"), F.col("s"), F.col("c"))).collect()] == [["source_proximity"], ["lexical_overlap"], ["symbol_overlap", "explicit_reference"], []]


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(None, 3), (5, 5)] + [(200, i) for i in range(201, 240)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    nodes = list(range(0, 62)) + list(range(100, 161)) + list(range(200, 240))
    df = spark.createDataFrame(edges, "a int, b int").repartition(3)
    got = {r.node: r.component for r in clusters.components(df, "a", "b", spark.createDataFrame([(n,) for n in nodes], "node int")).collect()}
    assert got == {n: root(n) for n in nodes}
    assert clusters.components(df.limit(0), "a", "b").collect() == []


def test_contradictions_and_bipartite(spark):
    same = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    labels = clusters.components(same, "a", "b")
    assert values(clusters.contradictions(labels, spark.createDataFrame([("a", "c"), ("a", "z")], "a string, b string"), "a", "b")) == [("a", "c", "a")]
    m = spark.createDataFrame([("g1", "p1"), ("g2", "p2"), ("g2", "p3")], "g string, p string")
    assert values(clusters.bipartite(m, "g", "p"), "left", "right", "status") == [("g1", "p1", "matched"), ("g2", "p2", "ambiguous"), ("g2", "p3", "ambiguous")]


def test_edge_aggregation(spark):
    rows = [("p1", True, "a", "b", "USES", 2, "w2"), ("p1", True, "a", "b", "USES", 1, "w9"), ("p1", False, "x", "y", "USES", 0, "w0"), ("p2", True, "a", "b", "USES", 1, "w1"), ("p2", True, "b", "a", "USES", 1, "w2"), ("p3", None, "a", "b", "USES", 1, "w1"), ("p4", True, None, "b", "USES", 1, "w1")]
    df = spark.createDataFrame(rows, "pair string, direct boolean, s string, t string, k string, size int, w string")
    every = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p4",), ("p5",)], "pair string")
    got = {r.pair: (r.outcome, r.s, r.window) for r in clusters.aggregate_edges(df, "pair", "direct", ["s", "t", "k"], "size", "w", every).collect()}
    assert got == {"p1": ("unique_direct_edge", "a", "w9"), "p2": ("conflicting_direct_edges", None, None), "p3": ("no_direct_edge", None, None), "p4": ("unique_direct_edge", None, "w1"), "p5": ("no_direct_edge", None, None)}


@pytest.mark.parametrize("seed", range(4))
def test_minimal_windows_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    blocks = [i for i in range(30) if rng.random() < 0.85]
    rows = [("p", "l", i, rng.random() < 0.25, rng.random() < 0.25) for i in blocks]
    shown = {r[2]: r for r in rows}
    covering = [(s, e) for s in blocks for e in range(s, s + 3) if all(i in shown for i in range(s, e + 1)) and any(shown[i][3] for i in range(s, e + 1)) and any(shown[i][4] for i in range(s, e + 1))]
    want = [(s, e) for s, e in covering if not any((a, b) != (s, e) and a >= s and b <= e for a, b in covering)]
    df = spark.createDataFrame(rows, "p string, l string, i int, a boolean, b boolean").repartition(3)
    assert values(evidence.minimal_windows(df, "p", "l", "i", "a", "b"), "start", "end") == sorted(want, key=str)


def test_catalog_and_windows(spark):
    lect = spark.createDataFrame([("l1", "one A\n\ntwo A B\n\nthree"), ("l2", "four\n\nfive B"), ("l2", "four\n\nfive B"), ("l3", None)], "lecture_id string, text string")
    blocks = evidence.block_rows(lect, "lecture_id", "text")
    cat = evidence.catalog(spark.createDataFrame([("p", "l1"), ("p", "l2"), ("q", "l2")], "pair string, lecture_id string"), blocks, "pair", "lecture_id")
    assert values(cat.filter("pair = 'p'"), "evidence_id", "span") == [("evidence_001", "one A"), ("evidence_002", "two A B"), ("evidence_003", "three"), ("evidence_004", "four"), ("evidence_005", "five B")]
    seen = cat.withColumn("a", F.contains("span", F.lit("A"))).withColumn("b", F.contains("span", F.lit("B")))
    w = evidence.window_ids(evidence.minimal_windows(seen, "pair", "lecture_id", "block_index", "a", "b"), cat, "pair", "lecture_id")
    assert values(w, "pair", "evidence_ids") == [("p", ["evidence_002"])]


def facts(spark, rows):
    gold = spark.createDataFrame([(r[0], *r[1]) for r in rows], "id string, source string, target string, relation_type string, symmetric boolean")
    pred = spark.createDataFrame([(r[0], *r[2]) for r in rows], "id string, source string, target string, relation_type string")
    return metrics.edge_facts(pred, gold, "id")


def test_wrong_direction_scenario(spark):
    f = facts(spark, [("1", ("a", "b", "USES", False), ("a", "b", "USES")), ("2", ("c", "d", "REQUIRES", False), ("d", "c", "REQUIRES")), ("3", ("e", "f", "CONTRASTS_WITH", True), ("f", "e", "CONTRASTS_WITH")), ("4", ("g", "h", "NO_RELATION", False), ("h", "g", "NO_RELATION"))])
    m = metrics.edge_metrics(f).first()
    assert (m.strict_accuracy, m.type_accuracy, m.direction_accuracy) == (0.75, 1.0, 0.5)
    assert values(metrics.edge_errors(f, "id")) == [("2", "wrong_direction")]


def test_overconnection_scenario(spark):
    f = facts(spark, [("1", ("a", "b", "USES", False), ("a", "b", "USES")), ("2", ("c", "d", "NO_RELATION", False), ("c", "d", "RELATED_TO"))])
    m = metrics.edge_metrics(f).first()
    assert (m.no_relation_accuracy, m.positive_accuracy, m.related_to_rate) == (0.0, 1.0, 0.5)
    assert values(metrics.edge_errors(f, "id")) == [("2", "false_positive_relation"), ("2", "overused_related_to")]
    assert metrics.edge_metrics(f.limit(0)).first().strict_accuracy is None


def test_candidate_scenario(spark):
    df = spark.createDataFrame([("positive", True)] * 2 + [("negative", True)] * 2 + [("diagnostic", True)], "label string, sel boolean")
    m = metrics.candidate_metrics(df, F.col("label"), F.col("sel")).first()
    assert (m.recall, m.precision, m.retention, m.workload) == (1.0, 0.5, 1.0, 5)


def test_cluster_scenarios(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9), rng.randint(0, 9)) for i in range(80)]
    df = spark.createDataFrame(rows, "m int, g int, p int")
    ab = [(x, y) for x in rows for y in rows if x[0] < y[0]]
    tp, fp, fn = (sum((x[1] == y[1], x[2] == y[2]) == k for x, y in ab) for k in ((True, True), (False, True), (True, False)))
    m = metrics.pairwise_clusters(df, "g", "p").first()
    assert (m.tp, m.fp, m.fn) == (tp, fp, fn)
    b = metrics.b_cubed(df, "g", "p").first()
    want = sum(sum(y[1] == x[1] and y[2] == x[2] for y in rows) / sum(y[2] == x[2] for y in rows) for x in rows) / len(rows)
    assert abs(b.precision - want) < 1e-12
    e = metrics.exact_clusters(spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 2, 2), (4, 3, 5), (5, 4, 5)], "m int, g int, p int"), "m", "g", "p").first()
    assert (e.n_gold, e.n_predicted, e.n_exact, e.singleton_precision) == (4, 3, 2, 1.0)
    assert metrics.pairwise_clusters(df.limit(0), "g", "p").first().f1 is None


def test_per_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), ("c", "c")], "g string, p string")
    c = {r.label: (r.support, r.precision, r.recall, r.f1) for r in metrics.per_class(metrics.confusion(df, "g", "p", ["a", "b", "c", "d"])).collect()}
    assert c["a"] == (2, 1.0, 0.5, 2 / 3) and c["b"] == (0, 0.0, None, None) and c["d"] == (0, None, None, None)


def test_entities(spark):
    gold = spark.createDataFrame([("l", "g1", "required", "Concept"), ("l", "g2", "required", "Method"), ("l", "g3", "optional", "Concept"), ("l", "g4", "excluded", "Concept"), ("m", "g1", "required", "Concept")], "l string, gold_id string, category string, type string")
    pred = spark.createDataFrame([("l", 1, "g1", "Concept", True), ("l", 2, "g1", "Concept", True), ("l", 3, "g3", "Concept", False), ("l", 4, "g4", "Concept", None), ("l", 5, None, "Concept", True), ("l", 6, "g2", "Concept", True)], "l string, index int, gold_id string, type string, exact boolean")
    r = {x.l: x for x in metrics.entity_metrics(pred, gold, "l").collect()}
    assert (r["l"].tp, r["l"].fp, r["l"].fn, r["l"].precision, r["l"].type_accuracy) == (2, 3, 0, 0.4, 0.5)
    assert (r["m"].tp, r["m"].fn, r["m"].precision) == (0, 1, None) and (r[None].n_required, r[None].recall) == (3, 2 / 3)


def test_gates_and_audit(spark):
    one_row = spark.createDataFrame([(0.9, None)], "a double, b double")
    g = audit.gates(one_row, [("a", ">=", 0.9), ("b", ">=", 0.1), ("a", "<", 0.5)])
    assert values(g, "metric", "operator", "passed") == [("a", "<", False), ("a", ">=", True), ("b", ">=", False)]
    assert tuple(audit.all_passed(g).first()) == (False, 2)
    a, b = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string"), spark.createDataFrame([("y",), ("z",), (None,)], "k string")
    assert values(audit.bijection(a, b, "k")) == sorted([("x", "extra"), ("x", "repeated_left"), ("z", "missing"), (None, "null_key")], key=str)
    assert tuple(audit.same_set(a, b).first()) == (False, 1, 1)
    with pytest.raises(audit.IntegrityError):
        audit.require_empty(a, "rows")
    nested = spark.createDataFrame([], "a struct<b:array<struct<gold_label:string>>>, m map<string,struct<q:int>>")
    assert audit.require_no_leak(nested, ["other"]) is nested
    with pytest.raises(audit.IntegrityError):
        audit.require_no_leak(nested, ["gold_label"])
    h = lambda rows: audit.content_hash(spark.createDataFrame(rows, "a int, b string"), ["a", "b"]).first()
    assert h([(1, "x"), (2, None)]) == h([(2, None), (1, "x")]) != h([(1, "x"), (2, "")]) and h([(1, "x")]) != h([(1, "x"), (1, "x")])


def test_matching(spark):
    gold = spark.createDataFrame([("l", "g1", "newton", ["nm"]), ("l", "g2", "nm", [])], "l string, gold_id string, key string, alias_keys array<string>")
    pred = spark.createDataFrame([("l", "p1", "nm"), ("l", "p2", "newton"), ("m", "p3", "newton"), ("l", "p4", None)], "l string, pred_id string, key string")
    assert values(matching.identity_matches(pred, gold, "l"), "pred_id", "gold_id", "match_type") == [("p1", "g2", "exact"), ("p2", "g1", "exact")]
    items = spark.createDataFrame([("e1", "one"), ("e2", "two")], "e string, v string")
    df = spark.createDataFrame([("a", ["e2", "e9", "e1"]), ("b", []), ("c", None)], "k string, ids array<string>")
    assert values(matching.materialized(df, "k", "ids", items, "e", "v")) == [("a", ["two", None, "one"])]
    d = matching.with_default(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", "X"), ("b", None)], "k string, v string"), "k", "v", F.lit("D"))
    assert values(d, "k", "v", "decided") == [("a", "X", True), ("b", "D", False)]
    al = spark.createDataFrame([("x", "matched", "1"), ("y", "matched", "1"), ("z", "deleted", None)], "ref string, status string, counterpart string")
    r = matching.recoverable(spark.createDataFrame([("1", "x", "y"), ("2", "x", "z"), ("3", "q", "z")], "k string, a string, b string"), al, "k", ("a", "b"))
    assert values(r, "k", "reasons", "recoverable") == [("1", ["ends_merged"], False), ("2", ["deleted"], False), ("3", ["deleted", "unaligned"], False)]
    s = matching.slots(spark.createDataFrame([("1", "x", "y"), ("2", "x", None)], "k string, a string, b string"), "k", ["a", "b"])
    assert values(s) == [("x", "ko_slot_001", "1"), ("x", "ko_slot_001", "2"), ("y", "ko_slot_002", "1")]
    assert values(matching.fanned_out(s, "slot")) == [("1", ["ko_slot_001", "ko_slot_002"]), ("2", ["ko_slot_001"])]


def test_scorer(spark):
    calls = spark.createDataFrame([("1", "ok"), ("2", "flaky"), ("3", "bad"), ("4", "dead"), ("5", None)], "k string, request string")

    def scorer(body):
        if body == "dead":
            raise scoring.TransportError("down")
        return json.dumps({"fixed": True}) if '"problem"' in body and "flaky" in body else "?" if body != "ok" else "{}"

    check = lambda a: None if a.startswith("{") else "not an object"
    got = {r.k: (r.response, r.attempts, r.error) for r in scoring.scored(calls, "request", scorer, retries=2, check=check).collect()}
    assert got["1"] == ("{}", 1, None) and got["2"] == ('{"fixed": true}', 2, None) and got["3"] == (None, 2, "invalid: not an object") and got["4"] == (None, 3, "transport: down") and got["5"] == (None, 0, "no request")
    replay = scoring.replayed(calls, "k", spark.createDataFrame([("1", "r1")], "key string, response string"))
    assert values(replay, "k", "response", "error")[0] == ("1", "r1", None) and replay.count() == 5
    assert values(scoring.to_resume(calls, "k", calls.filter("k < '4'")), "k") == [("4",), ("5",)]
    req = json.loads(scoring.requests(calls, "k", ["request"], ["gold"], "sys", "m").first().request)
    assert req["temperature"] == 0 and req["messages"][0] == {"role": "system", "content": "sys"}
    assert values(scoring.batches(calls, "k", 2), "k", "batch") == [("1", 0), ("2", 0), ("3", 1), ("4", 1), ("5", 2)]
    t = scoring.rendered(spark.createDataFrame([("USES", "a", None), ("X", "a", "b")], "t string, s string, d string"), {"USES": "{s} uses {d}!"}, "t", {"s": "s", "d": "d"})
    assert values(t, "t", "text") == [("USES", "a uses !"), ("X", None)]


def test_adjudication(spark):
    pending, none = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([], "k string, decision string")
    assert values(scoring.adjudicated(pending, none, "k", "h", None), "status") == [("draft_pending_adjudication",)] * 2
    some = spark.createDataFrame([("a", "supported")], "k string, decision string")
    assert values(scoring.adjudicated(pending, some, "k", "h", "h"), "k", "status") == [("a", "final"), ("b", "draft_pending_adjudication")]
    with pytest.raises(ValueError):
        scoring.adjudicated(pending, some, "k", "h", "old")
    with pytest.raises(audit.IntegrityError):
        scoring.adjudicated(pending, spark.createDataFrame([("z", "x")], "k string, decision string"), "k", "h", "h")


def test_canonicalization_pipelines(spark):
    m = spark.createDataFrame([("m1", "Concept", "Newton’s Method", 1), ("m2", "Concept", "newton's  method", 2), ("m3", "Method", "Newton's method", 3), ("m4", "Concept", "NM", 4)], "mention_id string, type string, name string, position int")
    c = pipelines.canonicalize(m)
    assert values(c, "type", "identity_key", "canonical_name", "mention_ids") == [("Concept", "newton's method", "Newton’s Method", ["m1", "m2"]), ("Concept", "nm", "NM", ["m4"]), ("Method", "newton's method", "Newton's method", ["m3"])]
    aliased = pipelines.canonicalize(m, spark.createDataFrame([("Concept", "nm", "newton's method")], "type string, alias string, key string"))
    assert ["m1", "m2", "m4"] in [r.mention_ids for r in aliased.collect()]
    assert values(pipelines.canonicalize(m.repartition(4)), "cluster_id") == values(c, "cluster_id")
    decide = lambda *rows: spark.createDataFrame(rows, "a string, b string, decision string")
    made, bad = pipelines.context_clusters(m, decide(("m1", "m2", "SAME_OBJECT"), ("m2", "m4", "SAME_OBJECT"), ("m1", "m4", "DISTINCT_OBJECT")))
    assert values(made, "mention_ids") == [(["m1", "m2", "m4"],), (["m3"],)] and values(bad, "a", "b") == [("m1", "m4")]
    for wrong in (("m1", "m2", "UNRESOLVED"), ("m1", "m9", "SAME_OBJECT")):
        with pytest.raises(audit.IntegrityError):
            pipelines.context_clusters(m, decide(wrong))
    scored = pipelines.resolve_context(m.withColumn("g", F.lit("l")), "g", lambda body: json.dumps({"decision": "SAME_OBJECT" if "exact" in body else "huh"}))
    assert {(r.a, r.b): r.decision for r in scored.collect()} == {("m1", "m2"): "SAME_OBJECT", ("m1", "m4"): "UNRESOLVED", ("m2", "m4"): "UNRESOLVED"} or scored.count() >= 1


def test_discovery_pipelines(spark):
    p = spark.createDataFrame([("p1", "a"), ("p2", "b"), ("p3", "c")], "id string, name string")

    def answer(kind):
        return json.dumps({"choices": [{"message": {"content": json.dumps({"relation_type": kind, "evidence_ids": ["e"], "rationale": "r"})}}]})

    gate = lambda body: answer("DIRECT" if '\\"a\\"' in body or '\\"b\\"' in body else "NO_RELATION")
    typer = lambda body: answer("USES" if '\\"a\\"' in body else "WRONG")
    out = pipelines.two_stage_classified(p, "id", gate, typer, ["name"])
    assert values(out, "id", "relation_type", "error") == [("p1", "USES", None), ("p2", "NO_RELATION", "invalid_relation_type"), ("p3", "NO_RELATION", None)]
    w = spark.createDataFrame([("p1", "w1", ["e1"]), ("p1", "w2", ["e1", "e2"]), ("p2", "w3", ["e1"])], "pair string, window_id string, evidence_ids array<string>")
    verify = lambda body: json.dumps({"support_decision": "DIRECT_IN_SCHEMA" if "w3" not in body else "NO", "source": "a", "target": "b", "relation_type": "USES"})
    assert values(pipelines.verified_windows(w, "pair", verify, ["window_id"]), "pair", "outcome", "window") == [("p1", "unique_direct_edge", "w1"), ("p2", "no_direct_edge", None)]


def test_alignment_and_projection(spark):
    gold = spark.createDataFrame([("l1", "g1", "Newton's method", ["NM"]), ("l1", "g2", "Bisection", []), ("l2", "g3", "Secant", []), ("l2", "g4", "Moved", [])], "lec string, gold_id string, name string, aliases array<string>")
    pred = spark.createDataFrame([("l1", "p1", "nm"), ("l1", "p2", "bisection"), ("l1", "p3", "Bisection"), ("l2", "p4", "other"), ("l1", "p5", "moved")], "lec string, pred_id string, name string")
    rows = pipelines.aligned(gold, pred, "lec")
    assert values(rows, "gold_id", "pred_id", "status") == sorted([("g1", "p1", "matched"), ("g2", "p2", "ambiguous"), ("g2", "p3", "ambiguous"), ("g3", None, "unmatched"), ("g4", None, "provenance_mismatch"), (None, "p4", "unmatched"), (None, "p5", "provenance_mismatch")], key=str)
    assert validate.alignment(rows, gold, pred).collect() == []
    pairs_ = spark.createDataFrame([("k1", "a", "b"), ("k2", "a", "c")], "k string, x string, y string")
    al = spark.createDataFrame([("a", "matched", "A"), ("b", "matched", "B"), ("c", "deleted", None)], "ref string, status string, counterpart string")
    names = lambda *r: spark.createDataFrame(r, "ref string, name string")
    manifest, g, p = pipelines.projected(pairs_, al, "k", ("x", "y"), names(("a", "alpha"), ("b", "beta")), names(("A", "α"), ("B", "β")))
    assert values(manifest, "k", "recoverable") == [("k1", True), ("k2", False)]
    assert values(g) == [("k1", "ko_slot_001", "ko_slot_002", "alpha", "beta")] and values(p) == [("k1", "ko_slot_001", "ko_slot_002", "α", "β")]
    pipelines.check_projection(g, p, ["k", "x_slot", "y_slot"])
    with pytest.raises(audit.IntegrityError):
        pipelines.check_projection(g, p, ["x_name"])


def test_gold_and_comparison(spark):
    c = spark.createDataFrame([("cand_dev_001", "POSITIVE"), ("cand_dev_002", "NEGATIVE")], "pair_id string, candidate_label string")
    assert values(pipelines.relation_gold(c), "pair_id", "category") == [("rel_dev_001", "positive"), ("rel_dev_002", "hard_negative")]
    u = spark.createDataFrame([("1", "a", "b"), ("2", "a", "c")], "k string, p string, q string")
    d = lambda *r: spark.createDataFrame(r, "x string, y string, relation_type string")
    assert values(pipelines.connection_gold(u, d(("b", "a", "USES")), "k", ("p", "q")), "k", "relation_type", "basis") == [("1", "USES", "explicit"), ("2", "NO_RELATION", "reviewed_negative")]
    for wrong in ([("b", "a", "USES"), ("a", "b", "USES")], [("b", "z", "USES")]):
        with pytest.raises(audit.IntegrityError):
            pipelines.connection_gold(u, d(*wrong), "k", ("p", "q"))
    inst, blind = pipelines.explanation_benchmark(u.withColumn("relation_type", F.when(F.col("k") == "1", "USES").otherwise("NO_RELATION")), "k", ["p"])
    assert inst.count() == blind.count() == 1 and "relation_type" not in blind.columns
    runs = {"a": spark.createDataFrame([(0.9,)], "r double"), "b": spark.createDataFrame([(None,)], "r double")}
    assert values(pipelines.compared(runs, {"recall": F.col("r") >= 0.8}), "method", "accepted") == [("a", True), ("b", False)]
    meta = lambda m, t: spark.createDataFrame([(m, t)], "model string, t double")
    assert values(pipelines.matched_execution(meta("x", 0.0), meta("x", None), ["model", "t"])) == [("t", "0.0", None)]


def test_validators(spark):
    objects = spark.createDataFrame([("l", "a", "Newton", "Concept", "required", ["NM"]), ("l", "b", "nm", "Formula", "optional", None), ("l", "c", " ", "Odd", "required", []), ("l", "c", "z", "Concept", "required", [])], "lecture_id string, obj_id string, name string, obj_type string, category string, aliases array<string>")
    assert values(validate.objects(objects)) == sorted([("l::c", "name_missing"), ("l::c", "type_unknown"), ("l::c", "id_repeated"), ("l::a", "name_or_alias_clash")], key=str)
    ref = "struct<lecture_id:string,ko_id:string>"
    rel = spark.createDataFrame(
        [("1", ("l", "b"), ("l", "a"), "FORMALIZES", "positive", False, [("l", "text")]), ("2", ("l", "a"), ("l", "b"), "FORMALIZES", "hard_negative", True, [("l", "nope")]), ("3", ("l", "a"), ("l", "q"), "NO_RELATION", "hard_negative", False, [])],
        f"pair_id string, source {ref}, target {ref}, relation_type string, category string, symmetric boolean, evidence_spans array<struct<lecture_id:string,span:string>>",
    )
    got = values(validate.relations(rel, objects.filter("obj_id <> 'c'"), spark.createDataFrame([("l", "the text")], "lecture_id string, text string")))
    assert got == sorted([("2", "category_disagrees"), ("2", "formalizes_without_formula"), ("2", "symmetric_type"), ("3", "target_unknown"), ("1", "unordered_pair_repeated"), ("2", "evidence_not_exact")], key=str)
    mentions = spark.createDataFrame([("m1", "C"), ("m2", "C"), ("m3", "M")], "mention_id string, type string")
    cl = spark.createDataFrame([("k1", "C", ["m1", "m3", "m9"]), ("k2", "C", ["m1"])], "canonical_id string, canonical_type string, mention_ids array<string>")
    assert values(validate.partition(cl, mentions)) == sorted([("m1", "mention_in_two_places"), ("m2", "mention_in_no_cluster"), ("m9", "mention_unknown"), ("k1", "cluster_of_two_types")], key=str)
    u = spark.createDataFrame([("1", "a", "b"), ("2", "a", "c")], "k string, p string, q string")
    s = spark.createDataFrame([("1", "a", "b"), ("1", "a", "b"), ("2", "a", "a"), ("9", "a", "d")], "k string, p string, q string")
    assert values(validate.selection(s, u, "k", ("p", "q"))) == sorted([("9", "pair_unknown"), ("1", "pair_repeated"), ("2", "self_pair"), ("2", "field_changed")], key=str)
    pr = spark.createDataFrame([("1", "USES", ["e1"]), ("2", "USES", []), ("3", "NO_RELATION", ["e1"]), ("4", "Odd", ["e9", "e9"]), ("6", "USES", ["e1"])], "k string, relation_type string, evidence_ids array<string>")
    ex = spark.createDataFrame([(str(i), ["e1"]) for i in range(1, 6)], "k string, allowed array<string>")
    assert values(validate.predictions(pr, ex, "k")) == sorted([("2", "positive_without_evidence"), ("3", "negative_with_evidence"), ("4", "type_unknown"), ("4", "evidence_not_allowed"), ("4", "evidence_repeated"), ("5", "missing"), ("6", "extra")], key=str)
    assert ("2", "positive_without_evidence") not in values(validate.predictions(pr, ex, "k", False))
    rv = spark.createDataFrame(
        [("1", [("c1", "t")], (True, True, True), [], (3, 3)), ("2", [("c1", ""), ("c1", "t")], (False, True, True), [], (3, 9))],
        "explanation_instance_id string, claims array<struct<claim_id:string,claim_text:string>>, faithfulness struct<relation_faithful:boolean,direction_faithful:boolean,endpoint_faithful:boolean>, failure_labels array<string>, learning_value_scores struct<clarity:int,specificity:int>",
    )
    assert values(validate.reviews(rv)) == sorted([("2", v) for v in ("claim_repeated", "claim_text_empty", "relation_distortion_label", "scores_of_unfaithful", "score_out_of_range")], key=str)
    good = {"reason_order": ["source_proximity", "lexical_overlap", "symbol_overlap", "explicit_reference", "type_compatibility"], "source_proximity": {"max_distance": 1}, "lexical_overlap": {"min_words": 1}, "symbol_overlap": {"min_symbols": 1}}
    assert validate.rule_config(good) == [] and validate.rule_config({**good, "source_proximity": {"max_distance": 9}}) == ["max_distance"]


def test_reviewed_explanations(spark):
    rows = [([("c", "SOURCE_GROUNDED")], (True, True, True, None), (4,)), ([("c", "UNSUPPORTED"), ("d", "SOURCE_GROUNDED")], (True, True, True, True), (2,))]
    df = spark.createDataFrame(rows, "claims array<struct<claim_id:string,support_label:string>>, faithfulness struct<relation_faithful:boolean,direction_faithful:boolean,endpoint_faithful:boolean,evidence_faithful:boolean>, learning_value_scores struct<clarity:int>")
    m = metrics.explanation_metrics(df).first()
    assert (m.n_claims, m.unsupported_rate, m.pass_rate, m.mean_clarity) == (3, 1 / 3, 0.5, 4.0)


def test_shared_tables_are_cleaned(spark):
    import os

    from knotwork.session import clean, discard, shared_dir, written

    root = shared_dir(spark).removeprefix("file://")
    df = written(spark.range(3), "some")
    assert df.count() == 3 and any(n.startswith("knotwork_some") for n in os.listdir(root))
    discard(df)
    assert not any(n.startswith("knotwork_some") for n in os.listdir(root))
    written(spark.range(3), "more")
    clean(spark)
    assert not any(n.startswith("knotwork_") for n in os.listdir(root))


def test_rule_decisions_over_blocks_of_a_group(spark, monkeypatch):
    """A group of many blocks and rows of many members: every pair once, as without blocks, and no side is broadcast."""
    blocks = spark.createDataFrame([(g, i, t) for g in "lm" for i, t in enumerate(("full rank", "nothing", "the step is based on inertia", "x", "y"))], "g string, block_index int, span string")
    vocabulary = ["rank", "step", "inertia", "matrix", "of", "newton", "Q"]
    rng = random.Random(4)
    rows = [(rng.choice("lm"), f"k{i:02}", " ".join(rng.sample(vocabulary, rng.randint(0, 2))) or None, rng.choice([None, [], ["full rank"], ["Q"], ["the step", r"\beta"]])) for i in range(90)]
    df = spark.createDataFrame([*rows, rows[0]], "g string, id string, n string, s array<string>")
    whole = pairs.rule_decisions(df, blocks, "g", "id", "n", "s")
    want = sorted(tuple(r) for r in whole.collect())
    assert [r[:3] for r in want] == sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1])
    assert len({tuple(r[4]) for r in want}) > 6
    for block, members in ((7, 64), (16, 2), (2048, 3)):
        monkeypatch.setattr(pairs, "GROUP_BLOCK", block)
        monkeypatch.setattr(pairs, "MEMBERS", members)
        assert sorted(tuple(r) for r in pairs.rule_decisions(df, blocks, "g", "id", "n", "s").collect()) == want
    plan = pairs.rule_decisions(df, blocks, "g", "id", "n", "s", joined=",")
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in plan.collect()) == [(*r[:4], ",".join(r[4]), r[5]) for r in want]
