"""Metrics of candidates, edges, gates, clusters, entities and explanations.

Undefined ratios are null. Each function is one pass of partial aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import measures as M
from knotwork.operators.matching import first_hits
from knotwork.session import col

# The relation types of the graph, the one that says there is none, and the symmetric ones.
RELATIONS = ("REQUIRES", "EXAMPLE_OF", "USES", "FORMALIZES", "CONTRASTS_WITH", "RELATED_TO")
NONE = "NO_RELATION"
LABELS = (*RELATIONS, NONE)
SYMMETRIC = ("CONTRASTS_WITH", "RELATED_TO")


def candidate_metrics(df: DataFrame, label: Column, selected: Column, by: Sequence[str] = ()) -> DataFrame:
    """Recall, precision, retention, reduction, workload and yield of a selection.

    ``label`` is ``positive``, ``negative`` or anything else (diagnostic: counts as workload only).
    """
    pos, neg = F.coalesce(label == "positive", F.lit(False)), F.coalesce(label == "negative", F.lit(False))
    sel = F.coalesce(selected, F.lit(False))
    n = df.groupBy(*map(col, by)).agg(
        F.count("*").alias("n_pairs"), F.count_if(pos).alias("n_positive"), F.count_if(pos & sel).alias("tp"), F.count_if(neg & sel).alias("fp"),
        F.count_if(pos & ~sel).alias("fn"), F.count_if(neg & ~sel).alias("tn"), F.count_if(sel).alias("workload"),
    )
    c = F.col
    kept = M.ratio(c("tp") + c("fp"), c("tp") + c("fp") + c("fn") + c("tn"))
    return n.select(
        *by, "n_pairs", "tp", "fp", "fn", "tn", "workload", M.ratio(c("tp"), c("n_positive")).alias("recall"), M.ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        kept.alias("retention"), (1 - kept).alias("reduction"), M.ratio(c("tp"), c("workload")).alias("yield"),
    )


def candidate_outcome(label: Column, selected: Column) -> Column:
    return M.first_true({
        "true_positive": (label == "positive") & selected, "false_negative": label == "positive", "false_positive": (label == "negative") & selected,
        "true_negative": label == "negative", "diagnostic_selected": selected,
    }, "diagnostic_unselected")


def coverage(df: DataFrame, kind: str, key: str, kinds: Sequence[str]) -> DataFrame:
    """Distinct keys and instances per type, types without any included, and the coverage label."""
    n = df.groupBy(col(kind).alias("kind")).agg(F.countDistinct(col(key)).alias("n_distinct"), F.count("*").alias("n_instances"))
    every = df.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    out = every.join(n, "kind", "left").fillna(0, ["n_distinct", "n_instances"])
    label = F.when(F.col("n_instances") > 0, F.format_string("covered_with_%d_primary_instances", "n_instances")).otherwise("no_primary_support")
    return out.withColumn("label", label)


def strata(df: DataFrame, members: Mapping[str, Column], counted: Mapping[str, Column]) -> DataFrame:
    """Counts per stratum, where a row belongs to every stratum whose condition holds."""
    each = df.select(M.all_true(members).alias("s_"), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in counted.items()))
    exploded = each.select(F.explode("s_").alias("stratum"), *counted)
    return exploded.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(F.col(n)).alias(n) for n in counted))


def confusion(df: DataFrame, gold: str, predicted: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """``gold, predicted, n`` for every pair of labels, zero cells included (labels squared rows)."""
    n = df.groupBy(col(gold).alias("gold"), col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    cells = df.sparkSession.createDataFrame([(g, p) for g in labels for p in labels], "gold string, predicted string")
    return cells.join(n, ["gold", "predicted"], "left").fillna(0, ["n"])


def per_class(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class of a confusion table: F1 is null without support, else 0 where undefined."""
    n, none = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("gold") == F.col("predicted"), n).otherwise(none)
    as_gold = F.struct(F.col("gold").alias("label"), n.alias("support"), none.alias("n_predicted"), hit.alias("tp"))
    as_predicted = F.struct(F.col("predicted").alias("label"), none.alias("support"), n.alias("n_predicted"), none.alias("tp"))
    both = matrix.select(F.explode(F.array(as_gold, as_predicted)).alias("x")).select("x.*")
    sums = both.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "n_predicted", "tp")))
    p, r = M.ratio(F.col("tp"), F.col("n_predicted")), M.ratio(F.col("tp"), F.col("support"))
    score = F.when(F.col("support") > 0, F.coalesce(M.f1(p, r), F.lit(0.0)))
    return sums.select("label", "support", "n_predicted", "tp", p.alias("precision"), r.alias("recall"), score.alias("f1"))


def macro_f1(classes: DataFrame) -> DataFrame:
    """The mean F1 over classes with support, and the least recall over them."""
    with_support = F.col("support") > 0
    return classes.agg(F.avg(F.when(with_support, F.col("f1"))).alias("macro_f1"), F.count_if(with_support).alias("n_classes"))


def min_recall(classes: DataFrame, support: int = 4) -> DataFrame:
    return classes.filter(F.col("support") >= support).agg(F.min("recall").alias("min_recall"), F.count("*").alias("n_groups"))


def edge_facts(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """One fact row per pair from tables with ``key, source, target, relation_type`` (gold also ``symmetric``)."""
    p = predicted.select(col(key), F.col("source").alias("ps"), F.col("target").alias("pt"), F.col("relation_type").alias("pk"))
    g = gold.select(col(key), F.col("source").alias("gs"), F.col("target").alias("gt"), F.col("relation_type").alias("gk"), "symmetric")
    j = g.join(p, key)
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    graph = no(c("pk").isin(*RELATIONS))
    positive = no(c("gk").isin(*RELATIONS))
    directed = no((c("ps") == c("gs")) & (c("pt") == c("gt")))
    eligible = positive & ~no(c("symmetric")) & graph
    return j.select(
        key, c("gk").alias("gold_type"), c("pk").alias("predicted_type"), positive.alias("positive"),
        M.same_edge(c("ps"), c("pt"), c("pk"), c("gs"), c("gt"), c("gk"), no(c("symmetric")) | no(c("gk") == NONE)).alias("strict"),
        no(c("pk") == c("gk")).alias("type_correct"), eligible.alias("direction_eligible"), (eligible & directed).alias("direction_correct"), graph.alias("predicted_edge"),
    )


def edge_metrics(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Strict, type, direction, positive, no-relation accuracy and the rate of the weak type."""
    c = F.col
    n = F.count_if
    typed = c("direction_eligible") & c("type_correct")
    return facts.groupBy(*by).agg(
        F.count("*").alias("n"),
        M.ratio(n(c("strict")), F.count("*")).alias("strict_accuracy"),
        M.ratio(n(c("type_correct")), F.count("*")).alias("type_accuracy"),
        M.ratio(n(c("direction_correct")), n(c("direction_eligible"))).alias("direction_accuracy"),
        M.ratio(n(c("direction_correct") & typed), n(typed)).alias("conditioned_direction_accuracy"),
        M.ratio(n(c("positive") & c("strict")), n(c("positive"))).alias("positive_accuracy"),
        M.ratio(n(~c("positive") & ~c("predicted_edge")), n(~c("positive"))).alias("no_relation_accuracy"),
        M.ratio(n(F.coalesce(c("predicted_type") == "RELATED_TO", F.lit(False))), F.count("*")).alias("related_to_rate"),
        M.ratio(n(c("positive") & c("strict")), n(c("predicted_edge"))).alias("edge_precision"),
    )


def edge_errors(facts: DataFrame, key: str) -> DataFrame:
    """``key, error_type``: every error a pair shows."""
    c = F.col
    errors = M.all_true({
        "false_positive_relation": ~c("positive") & c("predicted_edge"), "false_negative_relation": c("positive") & ~c("predicted_edge"),
        "wrong_relation_type": c("positive") & c("predicted_edge") & ~c("type_correct"),
        "wrong_direction": c("direction_eligible") & c("type_correct") & ~c("direction_correct"),
        "overused_related_to": F.coalesce((c("predicted_type") == "RELATED_TO") & (c("gold_type") != "RELATED_TO"), F.lit(False)),
    })
    return facts.select(key, F.explode(errors).alias("error_type"))


def strict_outcome() -> Column:
    """The first failure of an edge fact, in order."""
    c = F.col
    return M.first_true({
        "correct": c("strict"), "false_positive": ~c("positive") & c("predicted_edge"), "false_negative": c("positive") & ~c("predicted_edge"),
        "wrong_type": ~c("type_correct"), "wrong_direction": c("direction_eligible") & ~c("direction_correct"),
    }, "wrong_endpoints")


def universe_metrics(universe: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Over all pairs of ``key, positive``: pairs without a fact are correct negatives or missed positives."""
    j = universe.select(col(key), F.col("positive").alias("gold_positive")).join(facts.select(col(key), "strict", "predicted_edge"), key, "left")
    c = F.col
    edge, strict = F.coalesce(c("predicted_edge"), F.lit(False)), F.coalesce(c("strict"), F.lit(False))
    hit = c("gold_positive") & strict
    n = j.agg(F.count("*").alias("n"), F.count_if(c("gold_positive")).alias("n_positive"), F.count_if(edge).alias("n_edges"), F.count_if(hit).alias("n_hits"), F.count_if(~c("gold_positive") & ~edge).alias("n_true_negatives"))
    p, r = M.ratio(c("n_hits"), c("n_edges")), M.ratio(c("n_hits"), c("n_positive"))
    return n.select("*", M.ratio(c("n_hits") + c("n_true_negatives"), c("n")).alias("accuracy"), p.alias("precision"), r.alias("recall"), M.f1(p, r).alias("f1"))


def binary_metrics(df: DataFrame, gold: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """The four cells of a gate and what follows from them. A null prediction is a refusal (false); a null gold row is counted apart in no cell but ``n_unlabelled``."""
    c = F.col
    unlabelled, predicted = gold.isNull(), F.coalesce(predicted, F.lit(False))
    n = df.groupBy(*map(col, by)).agg(F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"), F.count_if(~gold & ~predicted).alias("tn"), F.count_if(unlabelled).alias("n_unlabelled"))
    p, r = M.ratio(c("tp"), c("tp") + c("fp")), M.ratio(c("tp"), c("tp") + c("fn"))
    return n.select("*", p.alias("precision"), r.alias("recall"), M.f1(p, r).alias("f1"), M.ratio(c("tn"), c("tn") + c("fp")).alias("negative_accuracy"))


def _choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def pairwise_clusters(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Pairwise precision, recall and F1 of a partition, from the contingency table: linear, no pairs are made."""
    cell = df.groupBy(col(gold).alias("g"), col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    g, p = cell.groupBy("g").agg(F.sum("n").alias("n")), cell.groupBy("p").agg(F.sum("n").alias("n"))
    sums = [x.agg(F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0.0)).alias(a)) for x, a in ((cell, "both"), (p, "pred"), (g, "gold"))]
    one = sums[0].crossJoin(sums[1]).crossJoin(sums[2])  # one row each
    c = F.col
    pr, re = M.ratio(c("both"), c("pred")), M.ratio(c("both"), c("gold"))
    return one.select(c("both").cast("long").alias("tp"), (c("pred") - c("both")).cast("long").alias("fp"), (c("gold") - c("both")).cast("long").alias("fn"), pr.alias("precision"), re.alias("recall"), M.f1(pr, re).alias("f1"))


def b_cubed(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """B-cubed precision, recall and F1, from the contingency table."""
    cell = df.groupBy(col(gold).alias("g"), col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    sizes = cell.join(cell.groupBy("g").agg(F.sum("n").alias("ng")), "g").join(cell.groupBy("p").agg(F.sum("n").alias("np")), "p")
    c = F.col
    one = sizes.agg(F.try_divide(F.sum(c("n") * c("n") / c("np")), F.sum("n")).alias("precision"), F.try_divide(F.sum(c("n") * c("n") / c("ng")), F.sum("n")).alias("recall"))
    return one.select("precision", "recall", M.f1(c("precision"), c("recall")).alias("f1"))


def exact_clusters(df: DataFrame, key: str, gold: str, predicted: str) -> DataFrame:
    """How many clusters are equal as sets, and precision and recall of singletons: equal sizes and one common cell as large."""
    cell = df.groupBy(col(gold).alias("g"), col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sizes = cell.join(cell.groupBy("g").agg(F.sum("n").alias("ng")), "g").join(cell.groupBy("p").agg(F.sum("n").alias("np")), "p")
    c = F.col
    same = (c("n") == c("ng")) & (c("n") == c("np"))
    n = sizes.agg(F.countDistinct("g").alias("n_gold"), F.countDistinct("p").alias("n_predicted"), F.count_if(same).alias("n_exact"),
                  F.count_if(same & (c("n") == 1)).alias("hit"), F.countDistinct(F.when(c("np") == 1, c("p"))).alias("n_p1"), F.countDistinct(F.when(c("ng") == 1, c("g"))).alias("n_g1"))
    return n.select("n_gold", "n_predicted", "n_exact", M.ratio(c("hit"), c("n_p1")).alias("singleton_precision"), M.ratio(c("hit"), c("n_g1")).alias("singleton_recall"))


def partition_summary(df: DataFrame, cluster: str, group: str) -> DataFrame:
    """Clusters by size, pairs inside clusters, those across groups, and all pairs."""
    cell = df.groupBy(col(cluster).alias("c"), col(group).alias("g")).agg(F.count("*").cast("double").alias("n"))
    size = cell.groupBy("c").agg(F.sum("n").alias("n"), F.sum(_choose2(F.col("n"))).alias("inside"))
    c = F.col
    one = size.agg(F.count("*").alias("n_clusters"), F.count_if(c("n") == 1).alias("n_singletons"), F.count_if(c("n") > 1).alias("n_multi"), F.max("n").cast("long").alias("largest"),
                   F.sum(_choose2(c("n"))).cast("long").alias("n_same_pairs"), F.sum(_choose2(c("n")) - c("inside")).cast("long").alias("n_cross_group_pairs"), _choose2(F.sum("n")).cast("long").alias("n_pairs"))
    return one.withColumn("n_distinct_pairs", c("n_pairs") - c("n_same_pairs"))


def entity_metrics(predictions: DataFrame, gold: DataFrame, group: str) -> DataFrame:
    """Required precision, recall, F1, type accuracy and span rate per group and over all (group null), from summed counts.

    ``predictions`` has ``group, index, gold_id, type, exact`` (gold_id null: unmatched), ``gold`` has
    ``group, gold_id, category, type``. The first prediction in order that meets a gold object is its
    match, later ones are duplicates; duplicates, unmatched and excluded ones are false positives;
    matches of optional objects count on neither side.
    """
    g = gold.select(col(group).alias("g"), "gold_id", "category", F.col("type").alias("gold_type"))
    p = predictions.select(col(group).alias("g"), "index", "gold_id", "type", "exact").join(g, ["g", "gold_id"], "left")
    hit = first_hits(p.filter(F.col("gold_id").isNotNull()), ["g", "gold_id"], "index", "dup")
    p = hit.unionByName(p.filter(F.col("gold_id").isNull()).withColumn("dup", F.lit(False)))
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    required = no(c("category") == "required") & ~c("dup")
    counts = p.groupBy("g").agg(
        F.count("*").alias("n_predictions"), F.count_if(required).alias("tp"), F.count_if(c("dup") | c("gold_id").isNull() | no(c("category") == "excluded")).alias("fp"),
        F.count_if(required & no(c("type") == c("gold_type"))).alias("typed"), F.count_if(no(c("exact"))).alias("exact"), F.count_if(c("dup")).alias("n_duplicates"),
        F.count_if(no(c("category") == "optional") & ~c("dup")).alias("n_optional"), F.count_if(no(c("category") == "excluded")).alias("n_excluded"), F.count_if(c("gold_id").isNull()).alias("n_unsupported"),
    )
    totals = g.groupBy("g").agg(F.count_if(c("category") == "required").alias("n_required"))
    joined = totals.join(counts, "g", "full").fillna(0)
    summed = joined.rollup("g").agg(*(F.sum(x).alias(x) for x in ("n_predictions", "n_required", "tp", "fp", "typed", "exact", "n_duplicates", "n_optional", "n_excluded", "n_unsupported")))
    pr, re = M.ratio(c("tp"), c("tp") + c("fp")), M.ratio(c("tp"), c("n_required"))
    return summed.select(
        c("g").alias(group), "n_predictions", "n_required", "tp", "fp", (c("n_required") - c("tp")).alias("fn"), "n_duplicates", "n_optional", "n_excluded", "n_unsupported", pr.alias("precision"), re.alias("recall"),
        M.f1(pr, re).alias("f1"), M.ratio(c("typed"), c("tp")).alias("type_accuracy"), M.ratio(c("exact"), c("n_predictions")).alias("exact_span_rate"),
    )


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    return df.groupBy(col(before).alias("before"), col(after).alias("after")).agg(F.count("*").alias("n"))


def recoverability(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recoverable pairs, and strict accuracy among them and over all."""
    c = F.col
    ok = c("recoverable") & F.coalesce(c("strict"), F.lit(False))
    return df.groupBy(*map(col, by)).agg(
        F.count("*").alias("n_pairs"), F.count_if(c("recoverable")).alias("n_recoverable"), M.ratio(F.count_if(c("recoverable")), F.count("*")).alias("recoverable_rate"),
        M.ratio(F.count_if(ok), F.count_if(c("recoverable"))).alias("conditional_accuracy"), M.ratio(F.count_if(ok), F.count("*")).alias("pipeline_accuracy"),
    )


# Labels of claims, and the kinds of faithfulness of a review.
SUPPORT_LABELS = ("SOURCE_GROUNDED", "UNSUPPORTED", "CONTRADICTED", "UNRESOLVED")
FAITHFUL = ("relation_faithful", "direction_faithful", "endpoint_faithful", "evidence_faithful")


def explanation_metrics(reviews: DataFrame, scores: Sequence[str] = ("clarity",)) -> DataFrame:
    """Claim labels, faithfulness rates and mean scores over passing reviews.

    A review passes if every stated kind of faithfulness holds and no claim is unsupported,
    contradicted or unresolved. The unsupported rate counts contradicted claims too and leaves
    unresolved ones out; evidence that is not stated (null) is in no denominator.
    """
    c = F.col
    labelled = lambda label: F.size(F.filter("claims", lambda x: F.coalesce(x["support_label"] == label, F.lit(False))))
    marked = reviews.select("*", F.size("claims").alias("n_"), *(labelled(x).alias(f"{x}_") for x in SUPPORT_LABELS))
    faith = [F.coalesce(c(f"faithfulness.{f}"), F.lit(f == "evidence_faithful")) for f in FAITHFUL]
    passes = faith[0] & faith[1] & faith[2] & faith[3] & (c("UNSUPPORTED_") + c("CONTRADICTED_") + c("UNRESOLVED_") == 0)
    marked = marked.withColumn("passes_", passes)
    stated = c("faithfulness.evidence_faithful")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return marked.agg(
        F.count("*").alias("n_reviews"), total("n_").alias("n_claims"), *(total(f"{x}_").alias(f"n_{x.lower()}") for x in SUPPORT_LABELS),
        M.ratio(total(c("UNSUPPORTED_") + c("CONTRADICTED_")), total(c("n_") - c("UNRESOLVED_"))).alias("unsupported_rate"),
        *(M.ratio(F.count_if(F.coalesce(c(f"faithfulness.{f}"), F.lit(False))), F.count("*")).alias(f"{f.split('_')[0]}_rate") for f in FAITHFUL[:3]),
        M.ratio(F.count_if(F.coalesce(stated, F.lit(False))), F.count(stated)).alias("evidence_rate"), M.ratio(F.count_if(c("passes_")), F.count("*")).alias("pass_rate"),
        *(F.avg(F.when(c("passes_"), c(f"learning_value_scores.{x}"))).alias(f"mean_{x}") for x in scores),
        F.when(total("UNRESOLVED_") > 0, "draft_pending_adjudication").otherwise("final").alias("status"),
    )


def usage(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    return df.agg(F.count("*").alias("n_requests"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in fields.items()))


def deltas(left: DataFrame, right: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``metric, left_value, right_value, delta`` of two one-row tables; null where either is."""
    j = left.select(*(F.col(m).cast("double").alias(f"l_{m}") for m in metrics)).crossJoin(right.select(*(F.col(m).cast("double").alias(f"r_{m}") for m in metrics)))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"l_{m}").alias("left_value"), F.col(f"r_{m}").alias("right_value"), (F.col(f"r_{m}") - F.col(f"l_{m}")).alias("delta")) for m in metrics))
    return j.select(F.explode(rows).alias("x")).select("x.*")
