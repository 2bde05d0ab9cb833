"""Evaluation of typed relations with evidence and accepted alternatives, and of whole pipelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import measures as M
from knotwork.functions import text as X
from knotwork.operators.metrics import NONE, RELATIONS
from knotwork.session import col, small

# Categories of gold pairs that the primary figures count (the others are reported apart), and two states of support.
PRIMARY = ("positive", "hard_negative")
SUPPORTED = "auto_supported_by_gold_evidence"
PENDING = "pending_adjudication"


def _no(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def accepts(source: Column, target: Column, kind: Column, edge: Column, unordered: Sequence[str] = (NONE,)) -> Column:
    """Whether a predicted edge is the edge ``struct<source, target, relation_type, symmetric>``.

    Ends may be in either order where the edge is marked symmetric or its type is one of
    ``unordered``: only the empty type under the first rule of matching (the default), the symmetric
    types under the second (``unordered=SYMMETRIC``). Anything null is no match.
    """
    either = _no(edge["symmetric"]) | _no(edge["relation_type"].isin(*unordered))
    return M.same_edge(source, target, kind, edge["source"], edge["target"], edge["relation_type"], either)


def evidence_counts(df: DataFrame, key: str, spans: str, allowed: str, texts: DataFrame) -> DataFrame:
    """``key, n_spans, n_exact, n_outside, n_invalid`` of arrays of ``struct<lecture_id, span>``.

    A span is outside if its lecture is not one of ``allowed``, else exact if its lecture's text holds
    it, else invalid; a null element is outside. Rows without spans have no row. ``texts`` has
    ``lecture_id, text``, once each.
    """
    each = df.select(col(key).alias("key_"), col(allowed).alias("a_"), F.explode(col(spans)).alias("s_")).select("key_", "a_", F.col("s_.lecture_id").alias("lecture_id"), F.col("s_.span").alias("span_"))
    held = each.join(small(texts.select("lecture_id", F.col("text").alias("t_"))), "lecture_id", "left")
    inside = _no(F.array_contains("a_", F.col("lecture_id")))
    exact = inside & X.exact_span(F.col("t_"), F.col("span_"))
    n = held.groupBy("key_").agg(F.count("*").alias("n_spans"), F.count_if(exact).alias("n_exact"), F.count_if(~inside).alias("n_outside"), F.count_if(inside & ~exact).alias("n_invalid"))
    return n.withColumnRenamed("key_", key)


def relation_facts(predicted: DataFrame, gold: DataFrame, key: str, texts: DataFrame, decisions: DataFrame | None = None, unordered: Sequence[str] = (NONE,)) -> DataFrame:
    """One row of facts per gold pair that was predicted.

    ``predicted`` has ``key, source, target, relation_type, evidence_spans, rationale``; ``gold`` has ``key,
    category, source, target, relation_type, symmetric, alternatives, evidence_spans, lectures``, where
    ``alternatives`` is a null or an array of further accepted edges and ``lectures`` those that evidence
    may come from; ``decisions`` has ``key, decision`` on evidence that is not the gold one. ``support`` is
    null unless an accepted edge is predicted.
    """
    c = F.col
    p = predicted.select(col(key), c("source").alias("ps"), c("target").alias("pt"), c("relation_type").alias("predicted_type"), c("evidence_spans").alias("pe"), c("rationale").alias("why"))
    g = gold.select(col(key), "category", F.struct("source", "target", "relation_type", "symmetric").alias("edge"), "alternatives", c("evidence_spans").alias("ge"), "lectures")
    j = g.join(p, key)
    j = j.join(evidence_counts(j, key, "pe", "lectures", texts), key, "left").fillna(0, ["n_spans", "n_exact", "n_outside", "n_invalid"])
    j = j.join(decisions.select(key, "decision"), key, "left") if decisions is not None else j.withColumn("decision", F.lit(None).cast("string"))
    edge = _no(c("predicted_type").isin(*RELATIONS))
    matches = lambda e: accepts(c("ps"), c("pt"), c("predicted_type"), e, unordered)
    strict = matches(c("edge"))
    accepted = strict | _no(F.exists("alternatives", matches))
    eligible = _no(c("category") == "positive") & ~_no(c("edge.symmetric")) & edge
    directed = _no((c("ps") == c("edge.source")) & (c("pt") == c("edge.target")))
    same = _no(F.array_sort("pe") == F.array_sort("ge"))
    all_exact = (c("n_spans") > 0) & (c("n_exact") == c("n_spans"))
    support = F.when(accepted & edge, F.when(all_exact & same, F.lit(SUPPORTED)).otherwise(F.coalesce("decision", F.lit(PENDING))))
    return j.select(
        key, "category", c("edge.relation_type").alias("gold_type"), "predicted_type", _no(c("category").isin(*PRIMARY)).alias("primary"), _no(c("category") == "positive").alias("positive"), edge.alias("predicted_edge"),
        strict.alias("strict"), accepted.alias("acceptable"), _no(c("predicted_type") == c("edge.relation_type")).alias("type_correct"), eligible.alias("direction_eligible"), (eligible & directed).alias("direction_correct"),
        _no(F.trim("why") != "").alias("rationale_present"), "n_spans", "n_exact", "n_outside", "n_invalid", support.alias("support"),
    )


def relation_metrics(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All figures of a relation evaluation in one pass; accuracies count primary pairs, evidence counts all."""
    c, n = F.col, F.count_if
    prime = c("primary")
    typed = prime & c("direction_eligible") & c("type_correct")
    weak, none = _no(c("predicted_type") == "RELATED_TO"), c("predicted_type").eqNullSafe(F.lit(NONE))
    negative, ambiguous = _no(c("category") == "hard_negative"), _no(c("category") == "ambiguous")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return facts.groupBy(*map(col, by)).agg(
        F.count("*").alias("n_pairs"), n(prime).alias("n_primary"), n(c("positive")).alias("n_positive"), n(negative).alias("n_hard_negative"), n(ambiguous).alias("n_ambiguous"), n(_no(c("category") == "schema_gap")).alias("n_schema_gap"),
        M.ratio(n(prime & c("strict")), n(prime)).alias("strict_accuracy"), M.ratio(n(prime & c("type_correct")), n(prime)).alias("type_accuracy"),
        M.ratio(n(prime & c("direction_correct")), n(prime & c("direction_eligible"))).alias("direction_accuracy"), M.ratio(n(typed & c("direction_correct")), n(typed)).alias("conditioned_direction_accuracy"),
        M.ratio(n(c("positive") & c("strict")), n(c("positive"))).alias("positive_accuracy"), M.ratio(n(negative & none), n(negative)).alias("no_relation_accuracy"),
        M.ratio(n(ambiguous & c("acceptable")), n(ambiguous)).alias("ambiguous_acceptable_accuracy"), M.ratio(n(prime & weak), n(prime)).alias("related_to_rate"),
        n(prime & weak & ~_no(c("gold_type") == "RELATED_TO")).alias("n_related_to_overused"), n(prime & _no(c("gold_type") == NONE) & c("predicted_edge")).alias("n_unsupported_relations"),
        M.ratio(total("n_exact"), total("n_spans")).alias("exact_evidence_rate"), total("n_spans").alias("n_spans"), total(c("n_spans") - c("n_exact")).alias("n_invalid_spans"), total("n_outside").alias("n_outside_spans"),
        n(c("predicted_edge") & (c("n_spans") == 0)).alias("n_missing_evidence"), n(none & (c("n_spans") > 0)).alias("n_unexpected_evidence"), n(~c("rationale_present")).alias("n_missing_rationale"),
        n(_no(c("support") == PENDING)).alias("n_pending"), F.when(n(_no(c("support") == PENDING)) > 0, "draft_pending_adjudication").otherwise("final").alias("status"),
    )


def relation_errors(facts: DataFrame, key: str) -> DataFrame:
    """``key, error_type, n``: every error a pair shows; ``n`` counts the spans of an error of spans, else it is 1."""
    c = F.col
    prime, none = c("primary"), c("predicted_type").eqNullSafe(F.lit(NONE))
    rules: Mapping[str, tuple[Column, Column | None]] = {
        "missing_rationale": (~c("rationale_present"), None),
        "missing_evidence": (c("predicted_edge") & (c("n_spans") == 0), None),
        "unexpected_evidence_for_no_relation": (none & (c("n_spans") > 0), None),
        "evidence_lecture_outside_candidate": (c("n_outside") > 0, c("n_outside")),
        "invalid_evidence_span": (c("n_invalid") > 0, c("n_invalid")),
        "overused_related_to": (prime & _no(c("predicted_type") == "RELATED_TO") & ~_no(c("gold_type") == "RELATED_TO"), None),
        "false_positive_relation": (prime & _no(c("gold_type") == NONE) & c("predicted_edge"), None),
        "false_negative_relation": (prime & _no(c("gold_type").isin(*RELATIONS)) & none, None),
        "wrong_relation_type": (prime & ~c("type_correct"), None),
        "wrong_direction": (prime & c("type_correct") & c("direction_eligible") & ~c("direction_correct"), None),
        "evidence_does_not_support_relation": (_no(c("support") == "not_supported"), None),
    }
    rows = [F.when(when, F.struct(F.lit(name).alias("error_type"), (n if n is not None else F.lit(1)).cast("long").alias("n"))) for name, (when, n) in rules.items()]
    return facts.select(key, M.multi(rows).alias("e")).select(key, "e.*")


def pipeline_facts(facts: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Facts with ``selected, outcome, locus``: where a pair that the pipeline got wrong was lost.

    ``selected`` has the keys that candidate selection let through. A pair that was not selected is a
    prediction of no relation.
    """
    c = F.col
    j = facts.join(selected.select(col(key).alias(key)).distinct().withColumn("sel_", F.lit(True)), key, "left").withColumn("selected", _no(c("sel_"))).drop("sel_")
    correct = F.when(c("positive"), c("selected") & c("strict")).otherwise(~c("selected") | ~c("predicted_edge"))
    locus = M.first_true({
        "not_primary_scored": ~c("primary"), "correct": correct, "candidate_miss": c("positive") & ~c("selected"), "false_positive": ~c("positive"), "false_negative": ~c("predicted_edge"),
        "wrong_type": ~c("type_correct"), "wrong_direction": c("direction_eligible") & ~c("direction_correct"),
    }, "wrong_endpoints")
    return j.withColumn("outcome", F.when(c("primary"), correct)).withColumn("locus", locus)


def pipeline_metrics(run: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Strict accuracy over all primary pairs, typed-edge precision, recall and F1, and the failures by locus; denominators are counted."""
    c, n = F.col, F.count_if
    prime = c("primary")
    hit, edges, gold = n(prime & c("positive") & c("selected") & c("strict")), n(prime & c("selected") & c("predicted_edge")), n(prime & c("positive"))
    loci = ("candidate_miss", "false_positive", "false_negative", "wrong_type", "wrong_direction", "wrong_endpoints")
    return run.groupBy(*map(col, by)).agg(
        n(prime).alias("n_primary"), n(c("selected")).alias("n_selected"), M.ratio(n(prime & c("outcome")), n(prime)).alias("strict_accuracy"), M.ratio(hit, edges).alias("edge_precision"), M.ratio(hit, gold).alias("edge_recall"),
        M.f1(M.ratio(hit, edges), M.ratio(hit, gold)).alias("edge_f1"), *(n(c("locus") == x).alias(f"n_{x}") for x in loci),
    )


def endpoint_recovery(pairs: DataFrame, ends: tuple[str, str], recovered: tuple[str, str], by: Sequence[str] = ()) -> DataFrame:
    """How many endpoints have a counterpart: each distinct one once, and each as often as pairs refer to it, and pairs with 0, 1 or 2.

    ``recovered`` are two boolean columns; an end that is null is not recovered and no distinct endpoint.
    """
    c = F.col
    one, two = _no(col(recovered[0])), _no(col(recovered[1]))
    each = pairs.select(*map(col, by), F.explode(F.array(F.struct(col(ends[0]).alias("ref"), one.alias("ok")), F.struct(col(ends[1]).alias("ref"), two.alias("ok")))).alias("e")).select(*by, "e.*")
    unique = each.filter("ref IS NOT NULL").groupBy(*by, "ref").agg(F.max("ok").alias("ok")).groupBy(*by).agg(F.count("*").alias("n_endpoints"), F.count_if("ok").alias("n_recovered"))
    weighed = pairs.groupBy(*map(col, by)).agg(F.count("*").alias("n_pairs"), (F.count_if(one) + F.count_if(two)).alias("n_ends"), F.count_if(one & two).alias("n_both"), F.count_if(one != two).alias("n_one"), F.count_if(~one & ~two).alias("n_none"))
    joined = weighed.join(unique, list(by), "left") if by else weighed.crossJoin(unique)  # one row each
    joined = joined.fillna(0, ["n_endpoints", "n_recovered"])
    return joined.select(*by, "n_pairs", "n_endpoints", "n_recovered", M.ratio(c("n_recovered"), c("n_endpoints")).alias("unique_rate"), M.ratio(c("n_ends"), 2 * c("n_pairs")).alias("weighted_rate"), "n_both", "n_one", "n_none")
