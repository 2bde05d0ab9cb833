"""Queries of metrics, gates, joins of predictions, set algebra, constraints and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import measures as M
from knotwork.functions import text as X
from knotwork.operators import audit, clusters, evaluation, matching, metrics, scoring
from knotwork.plans.base import CON, CON2, KO, LEC, NAME_KEY, REL, REL2, connections, lectures, objects, query, relations
from knotwork.session import table
from knotwork.streaming import events

_TYPES = "('REQUIRES', 'EXAMPLE_OF', 'USES', 'FORMALIZES', 'CONTRASTS_WITH', 'RELATED_TO')"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results do not depend on the order of summing."""
    return df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def relation_facts(spark: SparkSession, d: str) -> DataFrame:
    """The first system's predictions against the second system's copy as gold."""
    edge = lambda df: df.select("pair_id", M.ref_label(F.col("source.lecture_id"), F.col("source.ko_id")).alias("source"), M.ref_label(F.col("target.lecture_id"), F.col("target.ko_id")).alias("target"), "relation_type")
    gold = edge(relations(spark, d, "_copy")).withColumn("symmetric", F.col("relation_type").isin(*metrics.SYMMETRIC))
    return metrics.edge_facts(edge(relations(spark, d)), gold, "pair_id")


_REF = "({0}.lecture_id || '::' || {0}.ko_id)"
_FACTS = f"""f AS (SELECT pair_id, gk, pk, coalesce(gk IN {_TYPES}, false) AS pos, coalesce(pk IN {_TYPES}, false) AS edge, coalesce(pk = gk, false) AS typed,
        coalesce(ps = gs AND pt = gt, false) AS directed, coalesce(pk = gk AND ((ps = gs AND pt = gt) OR (gk IN ('CONTRASTS_WITH', 'RELATED_TO', 'NO_RELATION') AND ps = gt AND pt = gs)), false) AS strict,
        coalesce(gk IN {_TYPES}, false) AND NOT coalesce(gk IN ('CONTRASTS_WITH', 'RELATED_TO'), false) AND coalesce(pk IN {_TYPES}, false) AS elig
    FROM (SELECT g.pair_id, g.relation_type AS gk, p.relation_type AS pk, {_REF.format('p.source')} AS ps, {_REF.format('p.target')} AS pt, {_REF.format('g.source')} AS gs, {_REF.format('g.target')} AS gt
        FROM {REL2} g JOIN {REL} p USING (pair_id)))"""
_N = "count(*) FILTER (WHERE {0})"
_RATE = "round(count(*) FILTER (WHERE {0}) / nullif(count(*) FILTER (WHERE {1}), 0), 6)"


@query(f"""WITH {_FACTS} SELECT count(*) AS n, {_RATE.format('strict', 'true')} AS strict_accuracy, {_RATE.format('typed', 'true')} AS type_accuracy, {_RATE.format('elig AND directed', 'elig')} AS direction_accuracy,
    {_RATE.format('elig AND typed AND directed', 'elig AND typed')} AS conditioned_direction_accuracy, {_RATE.format('pos AND strict', 'pos')} AS positive_accuracy, {_RATE.format('NOT pos AND NOT edge', 'NOT pos')} AS no_relation_accuracy,
    {_RATE.format("pk = 'RELATED_TO'", 'true')} AS related_to_rate, {_RATE.format('pos AND strict', 'edge')} AS edge_precision FROM f""")
def edge_scoring(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.edge_metrics(relation_facts(spark, d)))


@query(f"""WITH {_FACTS} SELECT gk AS gold_type, count(*) AS n, {_RATE.format('elig AND directed', 'elig')} AS direction_accuracy, {_RATE.format('elig AND typed AND directed', 'elig AND typed')} AS conditioned_direction_accuracy FROM f GROUP BY 1""")
def direction_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.edge_metrics(relation_facts(spark, d), ["gold_type"]).select("gold_type", "n", "direction_accuracy", "conditioned_direction_accuracy"))


@query(f"""WITH {_FACTS} SELECT * FROM (SELECT pair_id, unnest(list_filter([CASE WHEN NOT pos AND edge THEN 'false_positive_relation' END, CASE WHEN pos AND NOT edge THEN 'false_negative_relation' END,
    CASE WHEN pos AND edge AND NOT typed THEN 'wrong_relation_type' END, CASE WHEN elig AND typed AND NOT directed THEN 'wrong_direction' END, CASE WHEN pk = 'RELATED_TO' AND gk <> 'RELATED_TO' THEN 'overused_related_to' END], lambda x: x IS NOT NULL)) AS error_type FROM f)""")
def error_multi_emit(spark: SparkSession, d: str) -> DataFrame:
    return metrics.edge_errors(relation_facts(spark, d), "pair_id")


@query(f"""WITH {_FACTS} SELECT CASE WHEN strict THEN 'correct' WHEN NOT pos AND edge THEN 'false_positive' WHEN pos AND NOT edge THEN 'false_negative' WHEN NOT typed THEN 'wrong_type' WHEN elig AND NOT directed THEN 'wrong_direction' ELSE 'wrong_endpoints' END AS outcome, count(*) AS n FROM f GROUP BY 1""")
def failure_locus(spark: SparkSession, d: str) -> DataFrame:
    return relation_facts(spark, d).groupBy(metrics.strict_outcome().alias("outcome")).agg(F.count("*").alias("n"))


_LABELS = "(SELECT unnest(['REQUIRES', 'EXAMPLE_OF', 'USES', 'FORMALIZES', 'CONTRASTS_WITH', 'RELATED_TO', 'NO_RELATION']) AS l)"
_MATRIX = f"m AS (SELECT g.l AS gold, p.l AS predicted, (SELECT count(*) FROM f WHERE f.gk = g.l AND f.pk = p.l) AS n FROM {_LABELS} g, {_LABELS} p)"


@query(f"WITH {_FACTS}, {_MATRIX} SELECT gold, predicted, n FROM m")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(relation_facts(spark, d), "gold_type", "predicted_type")


_CLASSES = f"""c AS (SELECT l AS label, (SELECT sum(n) FROM m WHERE gold = l) AS support, (SELECT sum(n) FROM m WHERE predicted = l) AS n_predicted, (SELECT sum(n) FROM m WHERE gold = l AND predicted = l) AS tp FROM {_LABELS}),
    s AS (SELECT label, CAST(support AS BIGINT) AS support, CAST(n_predicted AS BIGINT) AS n_predicted, CAST(tp AS BIGINT) AS tp, tp / nullif(n_predicted, 0) AS p, tp / nullif(support, 0) AS r FROM c)"""
_F1 = "CASE WHEN support > 0 THEN coalesce(2 * p * r / nullif(p + r, 0), 0) END"


@query(f"WITH {_FACTS}, {_MATRIX}, {_CLASSES} SELECT label, support, n_predicted, tp, round(p, 6) AS precision, round(r, 6) AS recall, round({_F1}, 6) AS f1 FROM s")
def per_class_prf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_class(confusion_matrix(spark, d)))


@query(f"WITH {_FACTS}, {_MATRIX}, {_CLASSES} SELECT round(avg({_F1}), 6) AS macro_f1, count(*) FILTER (WHERE support > 0) AS n_classes FROM s")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.macro_f1(metrics.per_class(confusion_matrix(spark, d))))


@query(f"WITH {_FACTS}, {_MATRIX}, {_CLASSES} SELECT round(min(r), 6) AS min_recall, count(*) AS n_groups FROM s WHERE support >= 4")
def min_group_recall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.min_recall(metrics.per_class(confusion_matrix(spark, d)), 4))


_SELECTED = f"""s AS (SELECT p.source.lecture_id AS lecture_id, p.pair_id, CASE WHEN g.relation_type IN {_TYPES} THEN 'positive' WHEN g.relation_type = 'NO_RELATION' THEN 'negative' ELSE 'diagnostic' END AS label,
    coalesce(len(p.evidence_spans) > 0, false) AS sel FROM {REL} p JOIN {REL2} g USING (pair_id))"""
_CM = f"""count(*) AS n_pairs, {_N.format("label = 'positive' AND sel")} AS tp, {_N.format("label = 'negative' AND sel")} AS fp, {_N.format("label = 'positive' AND NOT sel")} AS fn, {_N.format("label = 'negative' AND NOT sel")} AS tn, {_N.format('sel')} AS workload,
    {_RATE.format("label = 'positive' AND sel", "label = 'positive'")} AS recall, {_RATE.format("label = 'positive' AND sel", "label <> 'diagnostic' AND sel")} AS precision, {_RATE.format("label <> 'diagnostic' AND sel", "label <> 'diagnostic'")} AS retention,
    round(1 - count(*) FILTER (WHERE label <> 'diagnostic' AND sel) / nullif(count(*) FILTER (WHERE label <> 'diagnostic'), 0), 6) AS reduction, {_RATE.format("label = 'positive' AND sel", 'sel')} AS "yield" """


def _selected(spark: SparkSession, d: str) -> DataFrame:
    g = relations(spark, d, "_copy").select("pair_id", F.col("relation_type").alias("g"))
    label = F.when(F.col("g").isin(*metrics.RELATIONS), "positive").when(F.col("g") == metrics.NONE, "negative").otherwise("diagnostic")
    r = relations(spark, d).select("pair_id", F.col("source.lecture_id").alias("lecture_id"), F.coalesce(F.size("evidence_spans") > 0, F.lit(False)).alias("sel"))
    return r.join(g, "pair_id").withColumn("label", label)


@query(f"WITH {_SELECTED} SELECT {_CM} FROM s")
def candidate_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.candidate_metrics(_selected(spark, d), F.col("label"), F.col("sel")))


@query(f"WITH {_SELECTED} SELECT lecture_id, {_CM} FROM s GROUP BY 1")
def candidate_metrics_by_lecture(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.candidate_metrics(_selected(spark, d), F.col("label"), F.col("sel"), ["lecture_id"]))


@query(f"WITH {_SELECTED} SELECT CASE WHEN label = 'positive' THEN CASE WHEN sel THEN 'true_positive' ELSE 'false_negative' END WHEN label = 'negative' THEN CASE WHEN sel THEN 'false_positive' ELSE 'true_negative' END WHEN sel THEN 'diagnostic_selected' ELSE 'diagnostic_unselected' END AS outcome, count(*) AS n FROM s GROUP BY 1")
def candidate_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d).groupBy(metrics.candidate_outcome(F.col("label"), F.col("sel")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"SELECT l AS kind, count(DISTINCT pair_id) AS n_distinct, count(pair_id) AS n_instances, CASE WHEN count(pair_id) > 0 THEN 'covered_with_' || count(pair_id) || '_primary_instances' ELSE 'no_primary_support' END AS label FROM {_LABELS} LEFT JOIN relation_predictions ON relation_type = l GROUP BY l")
def relation_coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coverage(table(spark, d, "relation_predictions"), "relation_type", "pair_id", metrics.LABELS)


_STRATA = "[CASE WHEN source.lecture_id = target.lecture_id THEN 'within_lecture' END, CASE WHEN source.lecture_id <> target.lecture_id THEN 'cross_lecture' END, CASE WHEN len(evidence_spans) > 1 THEN 'several_spans' END, CASE WHEN rationale IS NULL OR rationale = '' THEN 'no_rationale' END]"


@query(f"SELECT stratum, count(*) AS n, {_N.format('edge')} AS n_edges FROM (SELECT unnest(list_filter({_STRATA}, lambda x: x IS NOT NULL)) AS stratum, coalesce(relation_type IN {_TYPES}, false) AS edge FROM {REL}) GROUP BY 1")
def strata_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return metrics.strata(relations(spark, d), {
        "within_lecture": c("source.lecture_id") == c("target.lecture_id"), "cross_lecture": c("source.lecture_id") != c("target.lecture_id"),
        "several_spans": F.size("evidence_spans") > 1, "no_rationale": c("rationale").isNull() | (c("rationale") == ""),
    }, {"n_edges": c("relation_type").isin(*metrics.RELATIONS)})


def connection_facts(spark: SparkSession, d: str) -> DataFrame:
    edge = lambda df: df.select("canonical_pair_id", F.col("source_canonical_ko_id").alias("source"), F.col("target_canonical_ko_id").alias("target"), "relation_type", "evidence_ids")
    gold = edge(connections(spark, d, "_copy")).withColumn("symmetric", F.col("relation_type").isin(*metrics.SYMMETRIC))
    chosen = edge(connections(spark, d)).filter(F.size("evidence_ids") > 1)
    return metrics.edge_facts(chosen, gold, "canonical_pair_id")


_CFACTS = f"""u AS (SELECT g.canonical_pair_id, coalesce(g.relation_type IN {_TYPES}, false) AS pos, coalesce(p.relation_type IN {_TYPES}, false) AS edge,
        coalesce(p.relation_type = g.relation_type AND ((p.source_canonical_ko_id = g.source_canonical_ko_id AND p.target_canonical_ko_id = g.target_canonical_ko_id)
            OR (g.relation_type IN ('CONTRASTS_WITH', 'RELATED_TO', 'NO_RELATION') AND p.source_canonical_ko_id = g.target_canonical_ko_id AND p.target_canonical_ko_id = g.source_canonical_ko_id)), false) AS strict
        FROM {CON2} g LEFT JOIN (SELECT * FROM {CON} WHERE len(evidence_ids) > 1) p USING (canonical_pair_id))"""


@query(f"""WITH {_CFACTS}, n AS (SELECT count(*) AS n, {_N.format('pos')} AS n_positive, {_N.format('edge')} AS n_edges, {_N.format('pos AND strict')} AS n_hits, {_N.format('NOT pos AND NOT edge')} AS n_true_negatives FROM u)
    SELECT *, round((n_hits + n_true_negatives) / nullif(n, 0), 6) AS accuracy, round(n_hits / nullif(n_edges, 0), 6) AS precision, round(n_hits / nullif(n_positive, 0), 6) AS recall,
    round(2 * (n_hits / nullif(n_edges, 0)) * (n_hits / nullif(n_positive, 0)) / nullif(n_hits / nullif(n_edges, 0) + n_hits / nullif(n_positive, 0), 0), 6) AS f1 FROM n""")
def full_universe_metrics(spark: SparkSession, d: str) -> DataFrame:
    universe = connections(spark, d, "_copy").select("canonical_pair_id", F.coalesce(F.col("relation_type").isin(*metrics.RELATIONS), F.lit(False)).alias("positive"))
    return rounded(metrics.universe_metrics(universe, connection_facts(spark, d), "canonical_pair_id"))


@query(f"""WITH {_FACTS}, x AS (SELECT count(*) FILTER (WHERE strict) / nullif(count(*), 0) AS s, count(*) FILTER (WHERE elig AND directed) / nullif(count(*) FILTER (WHERE elig), 0) AS t, count(*) FILTER (WHERE pk = 'RELATED_TO') / nullif(count(*), 0) AS r FROM f)
    SELECT metric, round(value, 6) AS value, operator, threshold, coalesce(passed, false) AS passed FROM (
    SELECT 'strict_accuracy' AS metric, s AS value, '>=' AS operator, CAST(0.8 AS DOUBLE) AS threshold, s >= 0.8 AS passed FROM x UNION ALL SELECT 'direction_accuracy', t, '>=', 0.999, t >= 0.999 FROM x UNION ALL SELECT 'related_to_rate', r, '<=', 0.2, r <= 0.2 FROM x)""")
def gate_table(spark: SparkSession, d: str) -> DataFrame:
    one = metrics.edge_metrics(relation_facts(spark, d))
    return rounded(audit.gates(one, [("strict_accuracy", ">=", 0.8), ("direction_accuracy", ">=", 0.999), ("related_to_rate", "<=", 0.2)]))


_GATE = f"j AS (SELECT coalesce(g.relation_type IN {_TYPES}, false) AS g, coalesce(len(p.evidence_ids) > 1, false) AS p FROM {CON} p JOIN {CON2} g USING (canonical_pair_id))"


@query(f"""WITH {_GATE}, n AS (SELECT {_N.format('g AND p')} AS tp, {_N.format('NOT g AND p')} AS fp, {_N.format('g AND NOT p')} AS fn, {_N.format('NOT g AND NOT p')} AS tn, {_N.format('g IS NULL')} AS n_unlabelled FROM j)
    SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1, round(tn / nullif(tn + fp, 0), 6) AS negative_accuracy FROM n""")
def binary_gate_prf(spark: SparkSession, d: str) -> DataFrame:
    g = connections(spark, d, "_copy").select("canonical_pair_id", F.coalesce(F.col("relation_type").isin(*metrics.RELATIONS), F.lit(False)).alias("g"))
    p = connections(spark, d).select("canonical_pair_id", F.coalesce(F.size("evidence_ids") > 1, F.lit(False)).alias("p"))
    return rounded(metrics.binary_metrics(p.join(g, "canonical_pair_id"), F.col("g"), F.col("p")))


_PART = "(SELECT doc_id, coalesce(lang, '?') || source AS g, coalesce(lecture_id, '?') AS p FROM documents)"


def _partition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("lang", F.lit("?")), F.col("source")).alias("g"), F.coalesce("lecture_id", F.lit("?")).alias("p"))


@query(f"""WITH x AS {_PART}, n AS (SELECT {_N.format('a.g = b.g AND a.p = b.p')} AS tp, {_N.format('a.g <> b.g AND a.p = b.p')} AS fp, {_N.format('a.g = b.g AND a.p <> b.p')} AS fn FROM x a JOIN x b ON a.doc_id < b.doc_id AND (a.g = b.g OR a.p = b.p))
    SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 6) AS f1 FROM n""")
def pairwise_cluster_prf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.pairwise_clusters(_partition(spark, d), "g", "p"))


@query(f"""WITH x AS {_PART}, e AS (SELECT count(*) OVER (PARTITION BY g, p) AS b, count(*) OVER (PARTITION BY g) AS ng, count(*) OVER (PARTITION BY p) AS np FROM x),
    m AS (SELECT avg(b / np) AS pr, avg(b / ng) AS re FROM e) SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1 FROM m""")
def b_cubed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.b_cubed(_partition(spark, d), "g", "p"))


@query(f"""WITH x AS {_PART}, g AS (SELECT list_sort(list(doc_id)) AS m FROM x GROUP BY g), p AS (SELECT list_sort(list(doc_id)) AS m FROM x GROUP BY p), i AS (SELECT m FROM g INTERSECT SELECT m FROM p)
    SELECT (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM i) AS n_exact, round((SELECT count(*) FROM i WHERE len(m) = 1) / nullif((SELECT count(*) FROM p WHERE len(m) = 1), 0), 6) AS singleton_precision,
    round((SELECT count(*) FROM i WHERE len(m) = 1) / nullif((SELECT count(*) FROM g WHERE len(m) = 1), 0), 6) AS singleton_recall""")
def exact_cluster_match(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.exact_clusters(_partition(spark, d), "doc_id", "g", "p"))


@query(f"""WITH x AS {_PART}, c AS (SELECT p, count(*) AS n FROM x GROUP BY 1), k AS (SELECT p, g, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT count(*) AS n_clusters, {_N.format('n = 1')} AS n_singletons, {_N.format('n > 1')} AS n_multi, max(n) AS largest, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS n_same_pairs, CAST(sum(n * (n - 1) / 2) - (SELECT sum(n * (n - 1) / 2) FROM k) AS BIGINT) AS n_cross_group_pairs,
    CAST(sum(n) * (sum(n) - 1) / 2 AS BIGINT) AS n_pairs, CAST(sum(n) * (sum(n) - 1) / 2 - sum(n * (n - 1) / 2) AS BIGINT) AS n_distinct_pairs FROM c""")
def partition_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.partition_summary(_partition(spark, d), "p", "g")


@query("SELECT min(doc_id) AS first_doc, count(*) AS n_docs, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def cluster_first_seen(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5("text").alias("text_md5"))
    return t.groupBy("text_md5").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs")).filter("n_docs > 1")


_ENT = f"""k AS {KO}, g AS (SELECT lecture_id, predicted_ko_id AS gold_id, type, CASE type WHEN 'Concept' THEN 'required' WHEN 'Method' THEN 'optional' WHEN 'Formula' THEN 'excluded' END AS category FROM k),
    p AS (SELECT x.lecture_id, x.pair_id AS index, g.gold_id, g.category, g.type, x.exact, CASE WHEN g.gold_id IS NULL THEN false ELSE row_number() OVER (PARTITION BY x.lecture_id, g.gold_id ORDER BY x.pair_id) > 1 END AS dup
        FROM (SELECT source.lecture_id AS lecture_id, source.ko_id AS ko_id, pair_id, coalesce(len(evidence_spans) > 0, false) AS exact FROM {REL} WHERE source.ko_id IS NOT NULL AND source.lecture_id IS NOT NULL) x LEFT JOIN g ON g.lecture_id = x.lecture_id AND g.gold_id = x.ko_id),
    c AS (SELECT lecture_id, count(*) AS n_predictions, {_N.format("NOT dup AND category = 'required'")} AS tp, {_N.format("dup OR gold_id IS NULL OR category = 'excluded'")} AS fp, {_N.format("NOT dup AND category = 'required' AND type = 'Concept'")} AS typed, {_N.format('exact')} AS exact, {_N.format('dup')} AS n_duplicates,
        {_N.format("category = 'optional' AND NOT dup")} AS n_optional, {_N.format("category = 'excluded'")} AS n_excluded, {_N.format('gold_id IS NULL')} AS n_unsupported FROM p GROUP BY 1),
    t AS (SELECT lecture_id, {_N.format("category = 'required'")} AS n_required FROM g GROUP BY 1),
    j AS (SELECT lecture_id, coalesce(n_predictions, 0) AS n_predictions, coalesce(n_required, 0) AS n_required, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(typed, 0) AS typed, coalesce(exact, 0) AS exact, coalesce(n_duplicates, 0) AS n_duplicates, coalesce(n_optional, 0) AS n_optional, coalesce(n_excluded, 0) AS n_excluded, coalesce(n_unsupported, 0) AS n_unsupported FROM t FULL JOIN c USING (lecture_id)),
    s AS (SELECT lecture_id, CAST(sum(n_predictions) AS BIGINT) AS n_predictions, CAST(sum(n_required) AS BIGINT) AS n_required, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, sum(typed) AS typed, sum(exact) AS exact, CAST(sum(n_duplicates) AS BIGINT) AS n_duplicates, CAST(sum(n_optional) AS BIGINT) AS n_optional, CAST(sum(n_excluded) AS BIGINT) AS n_excluded, CAST(sum(n_unsupported) AS BIGINT) AS n_unsupported FROM j GROUP BY ROLLUP (lecture_id))"""


@query(f"""WITH {_ENT} SELECT lecture_id, n_predictions, n_required, tp, fp, n_required - tp AS fn, n_duplicates, n_optional, n_excluded, n_unsupported, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(n_required, 0), 6) AS recall,
    round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(n_required, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(n_required, 0), 0), 6) AS f1, round(typed / nullif(tp, 0), 6) AS type_accuracy, round(exact / nullif(n_predictions, 0), 6) AS exact_span_rate FROM s""")
def entity_prf_micro_rollup(spark: SparkSession, d: str) -> DataFrame:
    category = F.create_map(*map(F.lit, ("Concept", "required", "Method", "optional", "Formula", "excluded")))[F.col("type")]
    gold = objects(spark, d).select("lecture_id", F.col("predicted_ko_id").alias("gold_id"), "type", category.alias("category"))
    named = relations(spark, d).filter("source.ko_id IS NOT NULL AND source.lecture_id IS NOT NULL").select(
        F.col("source.lecture_id").alias("lecture_id"), F.col("source.ko_id").alias("ko_id"), F.col("pair_id").alias("index"), F.lit("Concept").alias("type"), F.coalesce(F.size("evidence_spans") > 0, F.lit(False)).alias("exact")
    )
    known = gold.select("lecture_id", F.col("gold_id").alias("ko_id"), "gold_id")
    return rounded(metrics.entity_metrics(named.join(known, ["lecture_id", "ko_id"], "left"), gold, "lecture_id"))


_CATEGORY = "CASE WHEN {0} = 'RELATED_TO' THEN 'ambiguous' WHEN {0} = 'NO_RELATION' THEN 'hard_negative' WHEN {0} IS NULL THEN 'schema_gap' ELSE 'positive' END"
_EVAL = f"""b AS (SELECT g.pair_id, {_CATEGORY.format('g.relation_type')} AS category, g.relation_type AS gk, p.relation_type AS pk, {_REF.format('p.source')} AS ps, {_REF.format('p.target')} AS pt, {_REF.format('g.source')} AS gs, {_REF.format('g.target')} AS gt,
        p.evidence_spans AS pe, g.evidence_spans AS ge, p.rationale AS why, g.source.lecture_id AS l1, g.target.lecture_id AS l2 FROM {REL2} g JOIN {REL} p USING (pair_id)),
    x AS (SELECT pair_id, l1, l2, unnest(pe) AS s FROM b), y AS (SELECT x.pair_id, coalesce(s.lecture_id = l1, false) OR coalesce(s.lecture_id = l2, false) AS inside, coalesce(s.span <> '' AND contains(text, s.span), false) AS held FROM x LEFT JOIN {LEC} l ON l.lecture_id = s.lecture_id),
    n AS (SELECT pair_id, count(*) AS n_spans, {_N.format('inside AND held')} AS n_exact, {_N.format('NOT inside')} AS n_outside, {_N.format('inside AND NOT held')} AS n_invalid FROM y GROUP BY 1),
    m AS (SELECT b.*, coalesce(n_spans, 0) AS n_spans, coalesce(n_exact, 0) AS n_exact, coalesce(n_outside, 0) AS n_outside, coalesce(n_invalid, 0) AS n_invalid, coalesce(pk IN {_TYPES}, false) AS edge,
        coalesce(pk = gk AND ((ps = gs AND pt = gt) OR (gk IN ('RELATED_TO', 'CONTRASTS_WITH', 'NO_RELATION') AND ps = gt AND pt = gs)), false) AS strict, coalesce(category = 'ambiguous' AND pk = 'USES' AND ps = gt AND pt = gs, false) AS other,
        category = 'positive' AND gk <> 'CONTRASTS_WITH' AND coalesce(pk IN {_TYPES}, false) AS elig FROM b LEFT JOIN n USING (pair_id)),
    e AS (SELECT pair_id, category, gk AS gold_type, pk AS predicted_type, category IN ('positive', 'hard_negative') AS "primary", category = 'positive' AS positive, edge AS predicted_edge, strict, strict OR other AS acceptable, coalesce(pk = gk, false) AS type_correct, elig AS direction_eligible,
        elig AND coalesce(ps = gs AND pt = gt, false) AS direction_correct, coalesce(trim(why) <> '', false) AS rationale_present, n_spans, n_exact, n_outside, n_invalid,
        CASE WHEN (strict OR other) AND edge THEN CASE WHEN n_spans > 0 AND n_spans = n_exact AND coalesce(list_sort(list_transform(pe, lambda s: [s.lecture_id, s.span])) = list_sort(list_transform(ge, lambda s: [s.lecture_id, s.span])), false) THEN 'auto_supported_by_gold_evidence' ELSE 'pending_adjudication' END END AS support FROM m)"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """The first system against the copy as gold: RELATED_TO is ambiguous and USES in reverse accepted for it, a null type a schema gap."""
    c = F.col
    ref = lambda s: M.ref_label(c(f"{s}.lecture_id"), c(f"{s}.ko_id")).alias(s)
    p = relations(spark, d).select("pair_id", ref("source"), ref("target"), "relation_type", "evidence_spans", "rationale")
    g = relations(spark, d, "_copy").select("pair_id", F.array("source.lecture_id", "target.lecture_id").alias("lectures"), ref("source"), ref("target"), "relation_type", "evidence_spans")
    kind = c("relation_type")
    category = F.when(kind == "RELATED_TO", "ambiguous").when(kind == metrics.NONE, "hard_negative").when(kind.isNull(), "schema_gap").otherwise("positive")
    other = F.struct(c("target").alias("source"), c("source").alias("target"), F.lit("USES").alias("relation_type"), F.lit(False).alias("symmetric"))
    g = g.withColumn("category", category).withColumn("symmetric", kind.isin(*metrics.SYMMETRIC)).withColumn("alternatives", F.when(kind == "RELATED_TO", F.array(other)))
    return evaluation.relation_facts(p, g, "pair_id", lectures(spark, d))


@query(f"WITH {_EVAL} SELECT * FROM e")
def relation_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d)


@query(f"""WITH {_EVAL} SELECT count(*) AS n_pairs, {_N.format('"primary"')} AS n_primary, {_N.format('positive')} AS n_positive, {_N.format("category = 'hard_negative'")} AS n_hard_negative, {_N.format("category = 'ambiguous'")} AS n_ambiguous, {_N.format("category = 'schema_gap'")} AS n_schema_gap,
    {_RATE.format('"primary" AND strict', '"primary"')} AS strict_accuracy, {_RATE.format('"primary" AND type_correct', '"primary"')} AS type_accuracy, {_RATE.format('direction_correct', 'direction_eligible')} AS direction_accuracy, {_RATE.format('direction_correct AND type_correct', 'direction_eligible AND type_correct')} AS conditioned_direction_accuracy,
    {_RATE.format('positive AND strict', 'positive')} AS positive_accuracy, {_RATE.format("category = 'hard_negative' AND predicted_type = 'NO_RELATION'", "category = 'hard_negative'")} AS no_relation_accuracy, {_RATE.format("category = 'ambiguous' AND acceptable", "category = 'ambiguous'")} AS ambiguous_acceptable_accuracy,
    {_RATE.format('"primary" AND predicted_type = ' + "'RELATED_TO'", '"primary"')} AS related_to_rate, {_N.format('"primary" AND predicted_type = ' + "'RELATED_TO'")} AS n_related_to_overused, {_N.format("category = 'hard_negative' AND predicted_edge")} AS n_unsupported_relations,
    round(sum(n_exact) / nullif(sum(n_spans), 0), 6) AS exact_evidence_rate, CAST(sum(n_spans) AS BIGINT) AS n_spans, CAST(sum(n_spans - n_exact) AS BIGINT) AS n_invalid_spans, CAST(sum(n_outside) AS BIGINT) AS n_outside_spans, {_N.format('predicted_edge AND n_spans = 0')} AS n_missing_evidence,
    {_N.format("predicted_type = 'NO_RELATION' AND n_spans > 0")} AS n_unexpected_evidence, {_N.format('NOT rationale_present')} AS n_missing_rationale, {_N.format("support = 'pending_adjudication'")} AS n_pending, CASE WHEN count(*) FILTER (WHERE support = 'pending_adjudication') > 0 THEN 'draft_pending_adjudication' ELSE 'final' END AS status FROM e""")
def relation_evaluation_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.relation_metrics(_evaluated(spark, d)))


_ERRORS_OF = {
    "missing_rationale": ("NOT rationale_present", "1"), "missing_evidence": ("predicted_edge AND n_spans = 0", "1"), "unexpected_evidence_for_no_relation": ("predicted_type = 'NO_RELATION' AND n_spans > 0", "1"),
    "evidence_lecture_outside_candidate": ("n_outside > 0", "n_outside"), "invalid_evidence_span": ("n_invalid > 0", "n_invalid"), "overused_related_to": ("\"primary\" AND predicted_type = 'RELATED_TO'", "1"),
    "false_positive_relation": ("category = 'hard_negative' AND predicted_edge", "1"), "false_negative_relation": (f"\"primary\" AND gold_type IN {_TYPES} AND predicted_type = 'NO_RELATION'", "1"), "wrong_relation_type": ('"primary" AND NOT type_correct', "1"),
    "wrong_direction": ('"primary" AND type_correct AND direction_eligible AND NOT direction_correct', "1"),
}


@query(f"WITH {_EVAL} " + " UNION ALL ".join(f"SELECT pair_id, '{k}' AS error_type, CAST({n} AS BIGINT) AS n FROM e WHERE {w}" for k, (w, n) in _ERRORS_OF.items()))
def relation_evaluation_errors(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.relation_errors(_evaluated(spark, d), "pair_id")


_ARM = """SELECT '{0}' AS arm, e.*, {1} AS selected FROM e JOIN """ + REL + """ r USING (pair_id)"""
_ARMS = f"""a AS ({_ARM.format('with_spans', 'coalesce(len(r.evidence_spans) > 0, false)')} UNION ALL {_ARM.format('with_rationale', "coalesce(r.rationale <> '', false)")}),
    o AS (SELECT *, CASE WHEN positive THEN selected AND strict ELSE NOT selected OR NOT predicted_edge END AS correct FROM a),
    l AS (SELECT *, CASE WHEN NOT "primary" THEN 'not_primary_scored' WHEN correct THEN 'correct' WHEN positive AND NOT selected THEN 'candidate_miss' WHEN NOT positive THEN 'false_positive' WHEN NOT predicted_edge THEN 'false_negative' WHEN NOT type_correct THEN 'wrong_type'
        WHEN direction_eligible AND NOT direction_correct THEN 'wrong_direction' ELSE 'wrong_endpoints' END AS locus FROM o)"""
_HIT, _MADE, _GOLD = "count(*) FILTER (WHERE positive AND selected AND strict)", "nullif(count(*) FILTER (WHERE \"primary\" AND selected AND predicted_edge), 0)", "nullif(count(*) FILTER (WHERE positive), 0)"


@query(f"""WITH {_EVAL}, {_ARMS} SELECT arm, {_N.format('"primary"')} AS n_primary, {_N.format('selected')} AS n_selected, {_RATE.format('"primary" AND correct', '"primary"')} AS strict_accuracy, round({_HIT} / {_MADE}, 6) AS edge_precision, round({_HIT} / {_GOLD}, 6) AS edge_recall,
    round(2 * ({_HIT} / {_MADE}) * ({_HIT} / {_GOLD}) / nullif({_HIT} / {_MADE} + {_HIT} / {_GOLD}, 0), 6) AS edge_f1,
    """ + ", ".join(f"count(*) FILTER (WHERE locus = '{x}') AS n_{x}" for x in ("candidate_miss", "false_positive", "false_negative", "wrong_type", "wrong_direction", "wrong_endpoints")) + " FROM l GROUP BY 1")
def pipeline_arms(spark: SparkSession, d: str) -> DataFrame:
    """Two candidate selections before the same relations, side by side."""
    facts, r = _evaluated(spark, d), relations(spark, d)
    arms = {"with_spans": r.filter(F.size("evidence_spans") > 0), "with_rationale": r.filter("rationale <> ''")}
    runs = [evaluation.pipeline_facts(facts, s, "pair_id").withColumn("arm", F.lit(n)) for n, s in arms.items()]
    return rounded(evaluation.pipeline_metrics(runs[0].unionByName(runs[1]), ["arm"]))


@query(f"SELECT a.relation_type AS before, b.relation_type AS after, count(*) AS n FROM {REL} a JOIN {REL2} b USING (pair_id) GROUP BY 1, 2")
def transitions(spark: SparkSession, d: str) -> DataFrame:
    b = relations(spark, d, "_copy").select("pair_id", F.col("relation_type").alias("b"))
    return metrics.transitions(relations(spark, d).join(b, "pair_id"), "relation_type", "b")


@query(f"SELECT canonical_pair_id, coalesce(len(evidence_ids) > 1, false) AS gate_passed, CASE WHEN coalesce(len(evidence_ids) > 1, false) THEN coalesce(relation_type, 'NO_RELATION') ELSE 'NO_RELATION' END AS relation_type FROM {CON}")
def two_stage_gate(spark: SparkSession, d: str) -> DataFrame:
    c = connections(spark, d).select("canonical_pair_id", "evidence_ids", F.col("relation_type").alias("typed"))
    return scoring.two_stage(c, F.size("evidence_ids") > 1, F.col("typed")).select("canonical_pair_id", "gate_passed", "relation_type")


@query(f"""WITH w AS (SELECT pair_id, coalesce(relation_type IN {_TYPES}, false) AS direct, source.ko_id AS s, target.ko_id AS t, relation_type AS k, coalesce(len(evidence_spans), -1) AS size, CAST(recorded_at AS VARCHAR) AS ts FROM relation_predictions),
    g AS (SELECT pair_id, {_N.format('direct')} AS n_direct, count(DISTINCT (s, t, k)) FILTER (WHERE direct) AS n FROM w GROUP BY 1)
    SELECT pair_id AS pair, n_direct, CASE WHEN n_direct = 0 THEN 'no_direct_edge' WHEN n = 1 THEN 'unique_direct_edge' ELSE 'conflicting_direct_edges' END AS outcome,
    CASE WHEN n = 1 THEN (SELECT s FROM w WHERE w.pair_id = g.pair_id AND direct LIMIT 1) END AS source_ko, CASE WHEN n = 1 THEN (SELECT t FROM w WHERE w.pair_id = g.pair_id AND direct LIMIT 1) END AS target_ko,
    CASE WHEN n = 1 THEN (SELECT k FROM w WHERE w.pair_id = g.pair_id AND direct LIMIT 1) END AS relation_type, CASE WHEN n = 1 THEN (SELECT ts FROM w WHERE w.pair_id = g.pair_id AND direct ORDER BY size, ts LIMIT 1) END AS "window" FROM g""")
def window_edge_aggregate(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relation_predictions").select(
        "pair_id", F.col("relation_type").isin(*metrics.RELATIONS).alias("direct"), F.col("source.ko_id").alias("source_ko"), F.col("target.ko_id").alias("target_ko"), "relation_type",
        F.coalesce(F.size("evidence_spans"), F.lit(-1)).alias("size"), F.col("recorded_at").cast("string").alias("at"),
    )
    return clusters.aggregate_edges(r, "pair_id", "direct", ["source_ko", "target_ko", "relation_type"], "size", "at")


@query(f"SELECT a.canonical_pair_id, coalesce(b.relation_type, 'NO_RELATION') AS relation_type, b.relation_type IS NOT NULL AS decided FROM {CON} a LEFT JOIN {CON2} b USING (canonical_pair_id)")
def gt_override_default(spark: SparkSession, d: str) -> DataFrame:
    base = connections(spark, d).select("canonical_pair_id")
    return matching.with_default(base, connections(spark, d, "_copy"), "canonical_pair_id", "relation_type", F.lit("NO_RELATION"))


_ALIGN = f"""al AS (SELECT lecture_id || '::' || predicted_ko_id AS ref, CASE WHEN bool_or(deleted_at IS NULL) THEN 'matched' ELSE 'deleted' END AS status, CASE WHEN bool_or(deleted_at IS NULL) THEN {NAME_KEY.format('min(name)')} END AS cp FROM knowledge_objects GROUP BY 1)"""
_RECOVERED = f"""r AS (SELECT pair_id, relation_type, {_REF.format('source')} AS a, {_REF.format('target')} AS b FROM {REL}), {_ALIGN},
    j AS (SELECT r.*, x.cp AS ca, y.cp AS cb, CASE WHEN x.cp IS NULL THEN coalesce(x.status, 'unaligned') END AS wa, CASE WHEN y.cp IS NULL THEN coalesce(y.status, 'unaligned') END AS wb FROM r LEFT JOIN al x ON x.ref = r.a LEFT JOIN al y ON y.ref = r.b),
    q AS (SELECT *, array_to_string(list_concat(list_sort(list_distinct(list_filter([wa, wb], lambda x: x IS NOT NULL))), CASE WHEN ca = cb THEN ['ends_merged'] ELSE [] END), ',') AS reasons FROM j)"""


def _recovered(spark: SparkSession, d: str) -> DataFrame:
    r = relations(spark, d).select("pair_id", "relation_type", M.ref_label(F.col("source.lecture_id"), F.col("source.ko_id")).alias("a"), M.ref_label(F.col("target.lecture_id"), F.col("target.ko_id")).alias("b"))
    k = table(spark, d, "knowledge_objects").groupBy(M.ref_label(F.col("lecture_id"), F.col("predicted_ko_id")).alias("ref")).agg(F.some(F.col("deleted_at").isNull()).alias("live"), F.min("name").alias("name"))
    al = k.select("ref", F.when(F.col("live"), "matched").otherwise("deleted").alias("status"), F.when(F.col("live"), X.name_key_native(F.col("name"))).alias("counterpart"))
    return matching.recoverable(r, al, "pair_id", ("a", "b"))


@query(f"WITH {_RECOVERED} SELECT pair_id, reasons, reasons = '' AS recoverable FROM q")
def recoverability(spark: SparkSession, d: str) -> DataFrame:
    return _recovered(spark, d).select("pair_id", F.array_join("reasons", ",").alias("reasons"), "recoverable")


@query(f"""WITH {_RECOVERED}, w AS (SELECT *, CASE WHEN split_part(a, '::', 1) = split_part(b, '::', 1) THEN 'within' ELSE 'cross' END AS scope, ca IS NOT NULL AS ra, cb IS NOT NULL AS rb FROM q WHERE a IS NOT NULL AND b IS NOT NULL),
    u AS (SELECT scope, ref, bool_or(ok) AS ok FROM (SELECT scope, a AS ref, ra AS ok FROM w UNION ALL SELECT scope, b, rb FROM w) GROUP BY 1, 2), v AS (SELECT scope, count(*) AS n_endpoints, {_N.format('ok')} AS n_recovered FROM u GROUP BY 1)
    SELECT scope, count(*) AS n_pairs, any_value(n_endpoints) AS n_endpoints, any_value(n_recovered) AS n_recovered, round(any_value(n_recovered) / any_value(n_endpoints), 6) AS unique_rate, round(({_N.format('ra')} + {_N.format('rb')}) / (2 * count(*)), 6) AS weighted_rate,
    {_N.format('ra AND rb')} AS n_both, {_N.format('ra <> rb')} AS n_one, {_N.format('NOT ra AND NOT rb')} AS n_none FROM w JOIN v USING (scope) GROUP BY 1""")
def endpoint_recovery(spark: SparkSession, d: str) -> DataFrame:
    r = _recovered(spark, d).filter("a IS NOT NULL AND b IS NOT NULL")
    scope = F.when(F.split_part(F.col("a"), F.lit("::"), F.lit(1)) == F.split_part(F.col("b"), F.lit("::"), F.lit(1)), "within").otherwise("cross")
    marked = r.select("a", "b", F.col("counterpart_0").isNotNull().alias("ra"), F.col("counterpart_1").isNotNull().alias("rb"), scope.alias("scope"))
    return rounded(evaluation.endpoint_recovery(marked, ("a", "b"), ("ra", "rb"), ["scope"]))


@query(f"""WITH {_RECOVERED}, {_FACTS}, z AS (SELECT q.reasons = '' AS rec, coalesce(f.strict, false) AS strict, q.relation_type FROM q LEFT JOIN f USING (pair_id))
    SELECT relation_type, count(*) AS n_pairs, {_N.format('rec')} AS n_recoverable, {_RATE.format('rec', 'true')} AS recoverable_rate, {_RATE.format('rec AND strict', 'rec')} AS conditional_accuracy, {_RATE.format('rec AND strict', 'true')} AS pipeline_accuracy FROM z GROUP BY 1""")
def recoverability_metrics(spark: SparkSession, d: str) -> DataFrame:
    facts = relation_facts(spark, d).select("pair_id", "strict")
    return rounded(metrics.recoverability(_recovered(spark, d).join(facts, "pair_id", "left"), ["relation_type"]))


@query(f"""WITH r AS (SELECT coalesce(evidence_ids, []) AS e, relation_type IS NOT NULL AS rf, source_canonical_ko_id IS NOT NULL AS df, rationale IS NOT NULL AS ef, CASE WHEN evidence_ids IS NOT NULL THEN len(evidence_ids) > 0 END AS xf FROM {CON}),
    q AS (SELECT *, len(list_filter(e, lambda x: x > 'evidence_035')) AS u, len(list_filter(e, lambda x: x > 'evidence_030' AND x <= 'evidence_035')) AS c, len(list_filter(e, lambda x: x > 'evidence_028' AND x <= 'evidence_030')) AS o, len(e) AS n FROM r),
    p AS (SELECT *, rf AND df AND ef AND coalesce(xf, true) AND u + c + o = 0 AS ok FROM q)
    SELECT count(*) AS n_reviews, CAST(sum(n) AS BIGINT) AS n_claims, CAST(sum(n - u - c - o) AS BIGINT) AS n_source_grounded, CAST(sum(u) AS BIGINT) AS n_unsupported, CAST(sum(c) AS BIGINT) AS n_contradicted, CAST(sum(o) AS BIGINT) AS n_unresolved,
    round(sum(u + c) / nullif(sum(n - o), 0), 6) AS unsupported_rate, {_RATE.format('rf', 'true')} AS relation_rate, {_RATE.format('df', 'true')} AS direction_rate, {_RATE.format('ef', 'true')} AS endpoint_rate, {_RATE.format('xf', 'xf IS NOT NULL')} AS evidence_rate,
    {_RATE.format('ok', 'true')} AS pass_rate, round(avg(n) FILTER (WHERE ok), 6) AS mean_clarity, CASE WHEN sum(o) > 0 THEN 'draft_pending_adjudication' ELSE 'final' END AS status FROM p""")
def explanation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Reviews derived by rule: the number of an evidence id gives its label, a missing field is unfaithful, clarity is the number of claims."""
    ids = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    label = lambda x: F.when(x > "evidence_035", "UNSUPPORTED").when(x > "evidence_030", "CONTRADICTED").when(x > "evidence_028", "UNRESOLVED").otherwise("SOURCE_GROUNDED")
    claims = F.transform(ids, lambda x: F.struct(x.alias("claim_id"), label(x).alias("support_label")))
    ok = lambda f, n: F.col(f).isNotNull().alias(n)
    evidence = F.when(F.col("evidence_ids").isNotNull(), F.size("evidence_ids") > 0).alias("evidence_faithful")
    reviews = connections(spark, d).select(
        claims.alias("claims"), F.struct(ok("relation_type", "relation_faithful"), ok("source_canonical_ko_id", "direction_faithful"), ok("rationale", "endpoint_faithful"), evidence).alias("faithfulness"), F.struct(F.size(claims).alias("clarity")).alias("learning_value_scores"),
    )
    return rounded(metrics.explanation_metrics(reviews))


def _checks() -> dict:
    c = F.col
    return {
        "pair_id_format": M.matches_whole(c("pair_id"), r"rel_dev_\d{8}"), "relation_type_known": c("relation_type").isin(*metrics.LABELS), "source_present": c("source.ko_id").isNotNull() & c("source.lecture_id").isNotNull(),
        "ends_differ": M.ref_label(c("source.lecture_id"), c("source.ko_id")) != M.ref_label(c("target.lecture_id"), c("target.ko_id")), "evidence_present": (F.size("evidence_spans") > 0) | (c("relation_type") == metrics.NONE),
        "rationale_present": F.trim("rationale") != "", "loaded_after_recorded": c("loaded_at") >= c("recorded_at"),
    }


_CHECKS = {
    "pair_id_format": "regexp_full_match(pair_id, 'rel_dev_\\d{8}')", "relation_type_known": f"relation_type IN {_TYPES} OR relation_type = 'NO_RELATION'", "source_present": "source.ko_id IS NOT NULL AND source.lecture_id IS NOT NULL",
    "ends_differ": f"{_REF.format('source')} <> {_REF.format('target')}", "evidence_present": "len(evidence_spans) > 0 OR relation_type = 'NO_RELATION'", "rationale_present": "trim(rationale) <> ''", "loaded_after_recorded": "loaded_at >= recorded_at",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS violation, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS n_rows FROM relation_predictions" for n, c in _CHECKS.items()))
def constraint_report(spark: SparkSession, d: str) -> DataFrame:
    return audit.violation_report(table(spark, d, "relation_predictions"), _checks())


@query(" UNION ALL ".join(f"SELECT pair_id AS key, '{n}' AS violation FROM relation_predictions WHERE NOT coalesce({c}, false)" for n, c in _CHECKS.items()))
def constraint_rows(spark: SparkSession, d: str) -> DataFrame:
    return audit.violations(table(spark, d, "relation_predictions"), "pair_id", _checks())


@query(f"""SELECT r.pair_id, CAST(i AS INT) AS "at", s.lecture_id, l.course_id FROM (SELECT pair_id, unnest(range(len(evidence_spans))) AS i, unnest(evidence_spans) AS s FROM {REL}) r LEFT JOIN {LEC} l ON l.lecture_id = s.lecture_id""")
def composite_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    return matching.composite(relations(spark, d), "evidence_spans", lectures(spark, d), ["lecture_id"], "pair_id", "course_id").select("pair_id", "at", "lecture_id", "course_id")


_IDD = "(SELECT * FROM identity_decisions QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY recorded_at DESC, loaded_at DESC) = 1)"


@query(f"""WITH i AS {_IDD}, e AS (SELECT candidate_id, printf('evidence_%03d', n + 1) AS id, s.span AS span FROM (SELECT candidate_id, unnest(range(len(evidence_spans))) AS n, unnest(evidence_spans) AS s FROM i)),
    x AS (SELECT candidate_id, unnest(range(len(evidence_ids))) AS n, unnest(evidence_ids) AS id FROM i)
    SELECT candidate_id, array_to_string(list(coalesce(span, '∅') ORDER BY n), '|') AS spans FROM x LEFT JOIN e USING (candidate_id, id) GROUP BY 1""")
def evidence_materialize(spark: SparkSession, d: str) -> DataFrame:
    from knotwork.plans.base import latest

    i = latest(table(spark, d, "identity_decisions"), "candidate_id")
    items = i.select("candidate_id", F.posexplode("evidence_spans").alias("n", "s")).select("candidate_id", M.sequence_id("evidence", F.col("n") + 1).alias("id"), "s.span")
    made = matching.materialized(i.withColumn("who", F.col("candidate_id")), "who", "evidence_ids", items, "id", "span", ["candidate_id"])
    return made.select(F.col("who").alias("candidate_id"), F.array_join("values", "|", "∅").alias("spans"))


_NAT = "(SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)"


@query(f"""SELECT p.a, p.b, r.decision FROM {_NAT} p LEFT JOIN (VALUES (5, 0, 'same'), (1, 2, 'distinct'), (24, 99, 'same')) r(x, y, decision) ON least(p.a, p.b) = least(r.x, r.y) AND greatest(p.a, p.b) = greatest(r.x, r.y)""")
def unordered_key_join(spark: SparkSession, d: str) -> DataFrame:
    from knotwork.operators.pairs import local_universe

    p = local_universe(table(spark, d, "nation"), "n_regionkey", "n_nationkey").select("a", "b")
    required = spark.createDataFrame([(5, 0, "same"), (1, 2, "distinct"), (24, 99, "same")], "x int, y int, decision string")
    return matching.unordered_join(p, required, ("a", "b"), ("x", "y"))


@query(f"""WITH r AS (SELECT pair_id, {_REF.format('source')} AS a, {_REF.format('target')} AS b FROM {REL}), e AS (SELECT pair_id, unnest([a, b]) AS ref FROM r), s AS (SELECT DISTINCT ref FROM e WHERE ref IS NOT NULL),
    n AS (SELECT ref, printf('ko_slot_%06d', row_number() OVER (ORDER BY ref)) AS slot FROM s), k AS (SELECT lecture_id || '::' || predicted_ko_id AS ref FROM {KO} WHERE type IS NULL)
    SELECT e.pair_id AS pair, array_to_string(list_sort(list_distinct(list(slot))), ',') AS flags FROM e JOIN n USING (ref) JOIN k USING (ref) GROUP BY 1""")
def slot_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Slots of objects without a type, given to every pair that refers to them."""
    r = relations(spark, d).select("pair_id", M.ref_label(F.col("source.lecture_id"), F.col("source.ko_id")).alias("a"), M.ref_label(F.col("target.lecture_id"), F.col("target.ko_id")).alias("b"))
    s = matching.slots(r, "pair_id", ["a", "b"]).withColumn("slot", F.concat(F.lit("ko_slot_"), F.lpad(F.regexp_extract("slot", r"\d+$", 0), 6, "0")))
    untyped = objects(spark, d).filter("type IS NULL").select(M.ref_label(F.col("lecture_id"), F.col("predicted_ko_id")).alias("ref"))
    return matching.fanned_out(s.join(untyped, "ref"), "slot").withColumn("flags", F.array_join("flags", ","))


@query("""SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(*) FILTER (WHERE n_chars BETWEEN 200 AND 5000) AS n_in_range, coalesce(count(*) BETWEEN 5 AND 100000, false) AS enough FROM documents GROUP BY 1, 2""")
def source_audit(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.count_if(M.within(F.col("n_chars"), 200, 5000)).alias("n_in_range"))
    return g.withColumn("enough", M.within(F.col("n"), 5, 100_000))


@query(f"""SELECT canonical_pair_id, CASE relation_type WHEN 'REQUIRES' THEN source_canonical_ko_id || ' requires ' || target_canonical_ko_id || '.' WHEN 'USES' THEN source_canonical_ko_id || ' uses ' || target_canonical_ko_id || '.' END AS text FROM {CON} WHERE source_canonical_ko_id IS NOT NULL AND target_canonical_ko_id IS NOT NULL""")
def template_render(spark: SparkSession, d: str) -> DataFrame:
    c = connections(spark, d).filter("source_canonical_ko_id IS NOT NULL AND target_canonical_ko_id IS NOT NULL")
    return scoring.rendered(c, {"REQUIRES": "{s} requires {t}.", "USES": "{s} uses {t}."}, "relation_type", {"s": "source_canonical_ko_id", "t": "target_canonical_ko_id"}).select("canonical_pair_id", "text")


@query("""SELECT DISTINCT error_id, regexp_replace(pair_id, '^rel_dev_', 'cand_dev_') AS candidate_id, CASE WHEN error_type LIKE 'missing%' THEN 'missing' WHEN error_type LIKE 'invalid%' THEN 'invalid' WHEN error_type LIKE 'duplicate%' OR error_type LIKE 'unknown%' THEN 'alignment' ELSE 'other' END AS category FROM relation_errors""")
def label_recode(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("error_type")
    e = table(spark, d, "relation_errors")
    return e.select("error_id", F.regexp_replace("pair_id", "^rel_dev_", "cand_dev_").alias("candidate_id"), M.first_true({"missing": t.startswith("missing"), "invalid": t.startswith("invalid"), "alignment": t.startswith("duplicate") | t.startswith("unknown")}, "other").alias("category")).distinct()


@query("SELECT DISTINCT pair_id FROM relation_predictions WHERE pair_id NOT IN (SELECT pair_id FROM relation_errors WHERE pair_id IS NOT NULL)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that no error row has touched yet."""
    return scoring.to_resume(table(spark, d, "relation_predictions").select("pair_id").distinct(), "pair_id", table(spark, d, "relation_errors"))


_A, _B = "(SELECT DISTINCT pair_id FROM relation_predictions)", "(SELECT DISTINCT pair_id FROM relation_predictions_copy)"


@query(f"""SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM {_A} UNION SELECT * FROM {_B}) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM {_A} INTERSECT SELECT * FROM {_B}) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM {_A} EXCEPT SELECT * FROM {_B})
    UNION ALL SELECT 'only_left', count(*) FROM (SELECT * FROM {_A} EXCEPT SELECT * FROM {_B}) UNION ALL SELECT 'only_right', count(*) FROM (SELECT * FROM {_B} EXCEPT SELECT * FROM {_A}) UNION ALL SELECT 'repeated', count(*) FROM (SELECT pair_id FROM relation_predictions GROUP BY 1 HAVING count(*) > 1)""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, f"relation_predictions{c}").select("pair_id") for c in ("", "_copy"))
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    same = audit.same_set(a, b)
    out = n("union", a.union(b).distinct()).unionByName(n("intersect", a.intersect(b))).unionByName(n("except", a.subtract(b)))
    for side in ("only_left", "only_right"):
        out = out.unionByName(same.select(F.lit(side).alias("op"), F.col(side).alias("n")))
    return out.unionByName(n("repeated", audit.repeated(a, ["pair_id"])))


@query("""WITH a AS (SELECT pair_id AS key, count(*) AS n FROM relation_predictions GROUP BY 1), b AS (SELECT pair_id AS key, count(*) AS n FROM relation_predictions_copy GROUP BY 1), j AS (SELECT coalesce(a.key, b.key) AS key, a.n AS x, b.n AS y FROM a FULL JOIN b ON a.key = b.key)
    SELECT key, 'missing' AS problem FROM j WHERE x IS NULL UNION ALL SELECT key, 'extra' FROM j WHERE y IS NULL UNION ALL SELECT key, 'repeated_left' FROM j WHERE x > 1 UNION ALL SELECT key, 'repeated_right' FROM j WHERE y > 1""")
def bijection_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.bijection(table(spark, d, "relation_predictions"), table(spark, d, "relation_predictions_copy"), "pair_id")


@query(f"""WITH k AS (SELECT lecture_id, predicted_ko_id, {NAME_KEY.format('name')} AS key, type FROM {KO}), a AS (SELECT * FROM k WHERE type = 'Concept'), b AS (SELECT * FROM k WHERE type = 'Method'),
    fa AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key = a.key AND b.lecture_id = a.lecture_id)), fb AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.key = b.key AND a.lecture_id = b.lecture_id))
    SELECT fa.key, fa.predicted_ko_id AS a, fa.lecture_id AS group_a, fb.predicted_ko_id AS b, fb.lecture_id AS group_b FROM fa JOIN fb ON fa.key = fb.key""")
def provenance_mismatch(spark: SparkSession, d: str) -> DataFrame:
    k = objects(spark, d).select("lecture_id", "predicted_ko_id", "type", X.name_key_native(F.col("name")).alias("key"))
    return matching.provenance_mismatches(k.filter("type = 'Concept'"), k.filter("type = 'Method'"), "key", "lecture_id", "predicted_ko_id")


@query(f"""WITH k AS (SELECT lecture_id, predicted_ko_id, {NAME_KEY.format('name')} AS key, type FROM {KO}), a AS (SELECT * FROM k WHERE type = 'Concept'), b AS (SELECT * FROM k WHERE type = 'Method'),
    fa AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key = a.key AND b.lecture_id = a.lecture_id)), fb AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.key = b.key AND a.lecture_id = b.lecture_id)),
    m AS (SELECT fa.key, fa.predicted_ko_id AS a, fa.lecture_id AS ga, fb.predicted_ko_id AS b, fb.lecture_id AS gb FROM fa JOIN fb ON fa.key = fb.key)
    SELECT key, 'left' AS side, a AS id, ga AS "group", count(*) AS n_links FROM m GROUP BY key, a, ga UNION ALL SELECT key, 'right', b, gb, count(*) FROM m GROUP BY key, b, gb""")
def provenance_mismatch_classes(spark: SparkSession, d: str) -> DataFrame:
    k = objects(spark, d).select("lecture_id", "predicted_ko_id", "type", X.name_key_native(F.col("name")).alias("key"))
    return matching.mismatch_classes(k.filter("type = 'Concept'"), k.filter("type = 'Method'"), "key", "lecture_id", "predicted_ko_id")


_SEL2 = _SELECTED.replace("coalesce(len(p.evidence_spans) > 0, false)", "coalesce(p.rationale <> '', false)").replace("s AS (", "s2 AS (", 1)


@query(f"""WITH {_SELECTED}, {_SEL2}, x AS (SELECT {_CM} FROM s), y AS (SELECT {_CM} FROM s2) SELECT metric, l AS left_value, r AS right_value, round(r - l, 5) AS delta FROM (
    SELECT 'recall' AS metric, x.recall AS l, y.recall AS r FROM x, y UNION ALL SELECT 'precision', x.precision, y.precision FROM x, y UNION ALL SELECT 'retention', x.retention, y.retention FROM x, y)""")
def pipeline_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Two selection rules on the same pairs, and how the metrics differ."""
    s = _selected(spark, d)
    other = relations(spark, d).select("pair_id", F.coalesce(F.col("rationale") != "", F.lit(False)).alias("sel2"))
    one = rounded(metrics.candidate_metrics(s, F.col("label"), F.col("sel")))
    two = rounded(metrics.candidate_metrics(s.join(other, "pair_id"), F.col("label"), F.col("sel2")))
    return metrics.deltas(one, two, ["recall", "precision", "retention"]).withColumn("delta", F.round("delta", 5))


@query("SELECT event_type, count(*) AS n_requests, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k FROM events GROUP BY 1")
def usage_sum(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n_requests"), F.sum("k").alias("total_k"))


@query("SELECT region.r_name, n.n_name, sha256('{\"n_name\":' || to_json(n.n_name) || ',\"n_nationkey\":' || n.n_nationkey || '}') AS row_sha256 FROM nation n JOIN region ON r_regionkey = n_regionkey")
def snapshot_hash(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    body = M.canonical_json({"n_nationkey": F.col("n_nationkey"), "n_name": F.col("n_name")})
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_name", "n_name", F.sha2(body, 256).alias("row_sha256"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS window_start, time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return events.windowed(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(f"""WITH a AS (SELECT lecture_id, predicted_ko_id, {NAME_KEY.format('name')} AS k FROM {KO}), r AS (SELECT DISTINCT source.lecture_id AS lecture_id, source.ko_id AS ko_id, replace(regexp_replace(source.ko_id, '_\\d+$', ''), '_', ' ') AS k FROM {REL} WHERE source.ko_id IS NOT NULL AND source.lecture_id IS NOT NULL),
    n AS (SELECT DISTINCT r.lecture_id, r.ko_id, (SELECT min(a.predicted_ko_id) FROM a WHERE a.lecture_id = r.lecture_id AND a.k = r.k) AS e, (SELECT min(a.predicted_ko_id) FROM a WHERE a.lecture_id = r.lecture_id AND replace(replace(a.k, 'ï', 'i'), 'ö', 'o') = r.k) AS s FROM r)
    SELECT lecture_id, ko_id AS pred_id, coalesce(e, s) AS gold_id, CASE WHEN e IS NOT NULL THEN 'exact' ELSE 'alias' END AS match_type FROM n WHERE coalesce(e, s) IS NOT NULL""")
def identity_match(spark: SparkSession, d: str) -> DataFrame:
    """References named by their slug, matched to objects by name, else by the name without marks."""
    k = objects(spark, d).withColumn("key", X.name_key_native(F.col("name")))
    gold = k.select("lecture_id", F.col("predicted_ko_id").alias("gold_id"), "key", F.array(F.translate("key", "ïö", "io")).alias("alias_keys"))
    r = relations(spark, d).filter("source.ko_id IS NOT NULL AND source.lecture_id IS NOT NULL").select(F.col("source.lecture_id").alias("lecture_id"), F.col("source.ko_id").alias("pred_id")).distinct()
    return matching.identity_matches(r.withColumn("key", F.replace(F.regexp_replace("pred_id", r"_\d+$", ""), F.lit("_"), F.lit(" "))), gold, "lecture_id")


@query(f"SELECT lecture_id, count(*) AS n_rows, count(DISTINCT pair_id) AS n_pairs FROM (SELECT source.lecture_id AS lecture_id, pair_id FROM relation_predictions SEMI JOIN {LEC} l ON source.lecture_id = l.lecture_id) GROUP BY 1")
def semi_join_rows(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relation_predictions").select(F.col("source.lecture_id").alias("lecture_id"), "pair_id")
    return r.join(lectures(spark, d).select("lecture_id"), "lecture_id", "left_semi").groupBy("lecture_id").agg(F.count("*").alias("n_rows"), F.countDistinct("pair_id").alias("n_pairs"))
