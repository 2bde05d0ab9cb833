"""Queries of validators, scans and of classification by a recorded or rule scorer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import measures as M
from knotwork.functions import text as X
from knotwork.operators import audit, metrics, pipelines, scoring, validate
from knotwork.plans.base import CON, KO, LEC, REL, connections, lectures, objects, query, relations
from knotwork.session import table

_TYPES = "('REQUIRES', 'EXAMPLE_OF', 'USES', 'FORMALIZES', 'CONTRASTS_WITH', 'RELATED_TO')"
_LABEL = "(CASE WHEN {0}.lecture_id IS NOT NULL AND {0}.ko_id IS NOT NULL THEN {0}.lecture_id || '::' || {0}.ko_id END)"


@query(f"""WITH k AS (SELECT lecture_id || '::' || predicted_ko_id AS ref, type FROM {KO}),
    r AS (SELECT pair_id, relation_type AS t, evidence_spans AS e, {_LABEL.format('source')} AS s, {_LABEL.format('target')} AS o FROM {REL}),
    j AS (SELECT r.*, k.type AS kind FROM r LEFT JOIN k ON k.ref = r.s),
    u AS (SELECT least(s, o) AS x, greatest(s, o) AS y, min(pair_id) AS key FROM r WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
    x AS (SELECT pair_id, unnest(e) AS v FROM r), y AS (SELECT DISTINCT pair_id FROM x LEFT JOIN {LEC} l ON l.lecture_id = v.lecture_id WHERE NOT coalesce(v.span <> '' AND contains(text, v.span), false))
    SELECT pair_id AS key, 'type_unknown' AS violation FROM j WHERE NOT coalesce(t IN {_TYPES} OR t = 'NO_RELATION', false) UNION ALL SELECT pair_id, 'ends_equal' FROM j WHERE NOT coalesce(s <> o, false)
    UNION ALL SELECT pair_id, 'formalizes_without_formula' FROM j WHERE NOT coalesce(t <> 'FORMALIZES' OR kind = 'Formula', false)
    UNION ALL SELECT pair_id, 'symmetric_type' FROM j WHERE t = 'RELATED_TO'
    UNION ALL SELECT pair_id, 'evidence_missing' FROM j WHERE NOT coalesce(t = 'NO_RELATION' OR len(e) > 0, false)
    UNION ALL SELECT pair_id, 'source_unknown' FROM r WHERE s IS NOT NULL AND s NOT IN (SELECT ref FROM k WHERE ref IS NOT NULL) UNION ALL SELECT pair_id, 'target_unknown' FROM r WHERE o IS NOT NULL AND o NOT IN (SELECT ref FROM k WHERE ref IS NOT NULL)
    UNION ALL SELECT key, 'unordered_pair_repeated' FROM u UNION ALL SELECT pair_id, 'evidence_not_exact' FROM y""")
def relation_check(spark: SparkSession, d: str) -> DataFrame:
    """The checks of gold relations on all predicted ones."""
    r = relations(spark, d).select("pair_id", "source", "target", "relation_type", F.lit(None).cast("string").alias("category"), F.coalesce(F.col("relation_type").isin(*metrics.SYMMETRIC), F.lit(False)).alias("symmetric"), "evidence_spans")
    k = objects(spark, d).select("lecture_id", F.col("predicted_ko_id").alias("obj_id"), F.col("type").alias("obj_type"))
    return validate.relations(r, k, lectures(spark, d))


@query(f"""WITH b AS (SELECT canonical_pair_id AS pair_id, source_canonical_ko_id AS a, target_canonical_ko_id AS b, relation_type AS t, rationale AS why, coalesce(len(evidence_ids), 0) AS n,
        CASE WHEN relation_type = 'RELATED_TO' THEN 'AMBIGUOUS' WHEN relation_type = 'NO_RELATION' THEN 'NO_IN_SCHEMA_RELATION' WHEN relation_type IS NOT NULL THEN 'IN_SCHEMA_RELATION' END AS label FROM {CON})
    SELECT pair_id AS key, 'label_missing' AS violation FROM b WHERE label IS NULL UNION ALL SELECT pair_id, 'payload_without_label' FROM b WHERE label IS NULL AND (n > 0 OR why IS NOT NULL)
    UNION ALL SELECT pair_id, 'relation_missing' FROM b WHERE label = 'IN_SCHEMA_RELATION' AND n = 0 UNION ALL SELECT pair_id, 'primary_not_one' FROM b WHERE label = 'IN_SCHEMA_RELATION' AND n = 0
    UNION ALL SELECT pair_id, 'negative_with_relations' FROM b WHERE label = 'NO_IN_SCHEMA_RELATION' AND n > 0 UNION ALL SELECT pair_id, 'negative_without_rationale' FROM b WHERE label = 'NO_IN_SCHEMA_RELATION' AND NOT coalesce(trim(why) <> '', false)
    UNION ALL SELECT pair_id, 'ambiguous_with_primary' FROM b WHERE label = 'AMBIGUOUS' AND n > 0 UNION ALL SELECT pair_id, 'ambiguous_incomplete' FROM b WHERE label = 'AMBIGUOUS'
    UNION ALL SELECT pair_id, 'ambiguous_not_adjudicated' FROM b WHERE label = 'AMBIGUOUS' UNION ALL SELECT pair_id, 'source_missing' FROM b WHERE label IS NOT NULL AND NOT coalesce(trim(why) <> '', false)
    UNION ALL SELECT pair_id, 'relation_type_unknown' FROM b WHERE n > 0 AND (t IS NULL OR t NOT IN {_TYPES}) UNION ALL SELECT pair_id, 'ends_not_of_pair' FROM b WHERE n > 0 AND NOT coalesce(a <> b, false)
    UNION ALL SELECT pair_id, 'formalizes_without_formula' FROM b WHERE n > 0 AND t = 'FORMALIZES' UNION ALL SELECT pair_id, 'evidence_not_exact' FROM b WHERE n > 0""")
def candidate_check(spark: SparkSession, d: str) -> DataFrame:
    """Annotations made of connections by rule: one primary relation where there is evidence, whose objects and texts are not to be had."""
    c = F.col
    t, n = c("relation_type"), F.coalesce(F.size("evidence_ids"), F.lit(0))
    relation = F.struct(c("source_canonical_ko_id").alias("source"), c("target_canonical_ko_id").alias("target"), t.alias("relation_type"), F.lit("primary").alias("role"), F.lit(False).alias("symmetric"), c("evidence_ids").alias("evidence_spans"))
    label = F.when(t == "RELATED_TO", "AMBIGUOUS").when(t == metrics.NONE, "NO_IN_SCHEMA_RELATION").when(t.isNotNull(), "IN_SCHEMA_RELATION")
    made = connections(spark, d).select(
        c("canonical_pair_id").alias("pair_id"), F.lit("none").alias("lecture_id"), c("source_canonical_ko_id").alias("ko_a"), c("target_canonical_ko_id").alias("ko_b"), label.alias("candidate_label"), F.lit("final").alias("annotation_status"),
        F.when(n > 0, F.array(relation)).alias("gold_relations"), F.lit(None).cast("struct<relation_description:string,schema_exclusion_rationale:string,evidence_spans:array<string>>").alias("out_of_schema"),
        F.lit(None).cast("struct<rationale:string,competing_interpretations:array<string>,adjudication_status:string>").alias("ambiguity"), F.when(label.isNull() | (label == "NO_IN_SCHEMA_RELATION"), c("rationale")).alias("negative_rationale"), c("rationale").alias("annotation_source"),
    )
    k = objects(spark, d).select("lecture_id", c("predicted_ko_id").alias("obj_id"), c("type").alias("obj_type"))
    return validate.candidates(made, k, lectures(spark, d))


@query("""WITH f AS (SELECT DISTINCT file_id, file_path, md5(content) AS h FROM raw_files WHERE content <> ''), p AS (SELECT file_path AS v, min(file_id) AS m FROM f GROUP BY 1 HAVING count(*) > 1), c AS (SELECT h AS v, min(file_id) AS m FROM f GROUP BY 1 HAVING count(*) > 1)
    SELECT CAST(file_id AS VARCHAR) AS key, 'path_repeated' AS violation FROM f JOIN p ON p.v = f.file_path WHERE file_id <> m UNION ALL SELECT CAST(file_id AS VARCHAR), 'content_repeated' FROM f JOIN c ON c.v = f.h WHERE file_id <> m""")
def file_check(spark: SparkSession, d: str) -> DataFrame:
    """Raw files that share a path or a content with an earlier one."""
    f = table(spark, d, "raw_files").filter("content <> ''").select(F.col("file_id").alias("file"), "file_path", F.md5("content").alias("h")).distinct()
    return validate.files_repeated(f, {"path_repeated": F.col("file_path"), "content_repeated": F.col("h")})


@query(f"""WITH c AS {CON}, x AS (SELECT canonical_pair_id, relation_type AS t, coalesce(evidence_ids, []) AS e FROM c)
    SELECT canonical_pair_id, CASE WHEN len(e) = 0 THEN NULL WHEN coalesce(t IN {_TYPES} OR t = 'NO_RELATION', false) THEN t END AS relation_type, CASE WHEN len(e) = 0 THEN 2 WHEN coalesce(t IN {_TYPES} OR t = 'NO_RELATION', false) THEN 1 ELSE 1 END AS attempts,
    CASE WHEN len(e) = 0 THEN 'transport: no evidence' WHEN NOT coalesce(t IN {_TYPES} OR t = 'NO_RELATION', false) THEN 'invalid_relation_type' END AS error FROM x""")
def rule_scorer_classification(spark: SparkSession, d: str) -> DataFrame:
    """One-stage classification of all connections by a rule scorer: it answers with the recorded type, and its way fails where there is no evidence."""
    r = connections(spark, d).select("canonical_pair_id", F.col("relation_type").alias("recorded"), F.coalesce(F.size("evidence_ids"), F.lit(0)).alias("n_items"))

    def scorer(body: str) -> str:
        seen = json.loads(json.loads(body)["messages"][1]["content"])
        if not seen["n_items"]:
            raise scoring.TransportError("no evidence")
        answer = json.dumps({"relation_type": seen["recorded"], "evidence_ids": [], "rationale": "recorded"})
        return json.dumps({"choices": [{"message": {"content": answer}}]})

    out = pipelines.classified(r, "canonical_pair_id", ["recorded", "n_items"], ["evidence_ids"], scorer, retries=1)
    return out.select("canonical_pair_id", "relation_type", "attempts", "error")


@query("""WITH r AS (SELECT run_id, body FROM run_metadata QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, loaded_at DESC, body DESC) = 1)
    SELECT run_id, json_extract_string(body, '$.request_parameters.model') AS model, TRY_CAST(json_extract_string(body, '$.request_parameters.temperature') AS DOUBLE) AS temperature FROM r WHERE json_valid(body)""")
def response_parse(spark: SparkSession, d: str) -> DataFrame:
    """Members of recorded JSON bodies parsed to types; what does not parse is null."""
    from knotwork.operators.nested import latest_delivery

    r = latest_delivery(table(spark, d, "run_metadata"), "run_id", "body", ["started_at", "loaded_at"])
    get = lambda m: F.get_json_object("body", f"$.request_parameters.{m}")
    return r.select(F.col("key").alias("run_id"), get("model").alias("model"), get("temperature").try_cast("double").alias("temperature"))


@query(f"SELECT canonical_pair_id, CAST(floor((row_number() OVER (ORDER BY canonical_pair_id) - 1) / 7) AS INT) AS batch FROM {CON}")
def request_batches(spark: SparkSession, d: str) -> DataFrame:
    return scoring.batches(connections(spark, d).select("canonical_pair_id"), "canonical_pair_id", 7)


@query(f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY canonical_pair_id) AS i FROM {CON} WHERE relation_type IN {_TYPES})
    SELECT printf('explanation_%06d', i) AS explanation_instance_id, canonical_pair_id, relation_type, rationale FROM n""")
def explanation_instances(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.explanation_benchmark(connections(spark, d), "canonical_pair_id", ["rationale"])[0]


@query(f"""WITH p AS {CON}, r AS (SELECT canonical_pair_id AS k, relation_type AS t, coalesce(evidence_ids, []) AS e FROM p), x AS (SELECT DISTINCT canonical_pair_id AS k FROM connection_predictions_copy)
    SELECT k AS key, 'missing' AS violation FROM x WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT k, 'extra' FROM r WHERE k NOT IN (SELECT k FROM x)
    UNION ALL SELECT k, 'type_unknown' FROM r JOIN x USING (k) WHERE NOT coalesce(t IN {_TYPES} OR t IN ('NO_RELATION', 'DIRECT'), false) UNION ALL SELECT k, 'evidence_not_allowed' FROM r JOIN x USING (k) WHERE len(list_filter(e, lambda i: i IS NULL OR i > 'evidence_035')) > 0
    UNION ALL SELECT k, 'evidence_repeated' FROM r JOIN x USING (k) WHERE len(list_distinct(e)) + CASE WHEN len(list_filter(e, lambda i: i IS NULL)) > 0 THEN 1 ELSE 0 END <> len(e) UNION ALL SELECT k, 'negative_with_evidence' FROM r JOIN x USING (k) WHERE NOT coalesce(t <> 'NO_RELATION' OR len(e) = 0, false)
    UNION ALL SELECT k, 'positive_without_evidence' FROM r JOIN x USING (k) WHERE NOT coalesce(t NOT IN {_TYPES} OR len(e) > 0, false)""")
def prediction_check(spark: SparkSession, d: str) -> DataFrame:
    """Predicted connections against the pairs of the copy, where evidence ids up to 035 may be cited."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(35)), lambda i: F.format_string("evidence_%03d", i))
    expected = table(spark, d, "connection_predictions_copy").select("canonical_pair_id").distinct().withColumn("allowed", ids)
    return validate.predictions(connections(spark, d).select("canonical_pair_id", "relation_type", "evidence_ids"), expected, "canonical_pair_id")


@query(f"""SELECT (SELECT count(*) FROM {REL}) AS n_rows, count(*) AS n_same FROM {REL} a JOIN {REL} b USING (pair_id)""")
def shuffle_invariance(spark: SparkSession, d: str) -> DataFrame:
    """The order and partitioning of rows change no fingerprint: the same rows three ways, how many are alike."""
    r = relations(spark, d)
    ways = [r, r.repartition(7, "relation_type"), r.orderBy(F.desc("pair_id"))]
    cols = ["pair_id", "relation_type", "rationale", "run_id", "recorded_at"]
    prints = [audit.content_hash(w, cols).select("n_rows", F.col("digest").alias(f"d{i}")) for i, w in enumerate(ways)]
    one = prints[0].join(prints[1], "n_rows").join(prints[2], "n_rows")
    return one.select("n_rows", F.when((F.col("d0") == F.col("d1")) & (F.col("d0") == F.col("d2")), F.col("n_rows")).otherwise(0).alias("n_same"))


@query(f"""SELECT lecture_id, len(text) AS n_chars, contains(text, chr(10) || chr(10)) AS has_blocks FROM {LEC} WHERE text IS NOT NULL""")
def lecture_scan(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return lectures(spark, d).filter("text IS NOT NULL").select("lecture_id", F.length("text").cast("long").alias("n_chars"), (F.size(X.blocks(t)) > 1).alias("has_blocks"))


@query(f"""WITH r AS (SELECT pair_id, {_LABEL.format('source')} AS s, {_LABEL.format('target')} AS t FROM {REL}) SELECT pair_id, 'pair_' || left(sha256('connection_pair_v0.1|' || least(s, t) || '|' || greatest(s, t)), 16) AS unordered_id FROM r WHERE s IS NOT NULL AND t IS NOT NULL
    UNION ALL SELECT pair_id, NULL FROM r WHERE s IS NULL OR t IS NULL""")
def unordered_ids(spark: SparkSession, d: str) -> DataFrame:
    """An id for each unordered pair of references; half a pair has none."""
    ref = lambda s: M.ref_label(F.col(f"{s}.lecture_id"), F.col(f"{s}.ko_id"))
    return relations(spark, d).select("pair_id", M.pair_id("pair_", ref("source"), ref("target")).alias("unordered_id"))
