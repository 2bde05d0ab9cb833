"""Queries of the general data problems: thin plans over the core operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import compact, diff, drift, nested, orphans
from knotwork.session import fresh_dir, table, wide_table

RELATION_FIELDS = ["source.lecture_id", "source.ko_id", "target.lecture_id", "target.ko_id", "relation_type", "evidence_spans", "rationale"]
CONNECTION_FIELDS = ["source_canonical_ko_id", "target_canonical_ko_id", "relation_type", "evidence_ids", "rationale"]
LATEST = ["recorded_at", "loaded_at"]


def p1_differences(spark: SparkSession, d: str) -> DataFrame:
    """Both pairs of copies, with both sides' values."""
    out = None
    for name, key, fields in (
        ("relation_predictions", "pair_id", RELATION_FIELDS),
        ("connection_predictions", "canonical_pair_id", CONNECTION_FIELDS),
    ):
        one = diff.diff_copies(table(spark, d, name), table(spark, d, f"{name}_copy"), key, fields, LATEST, {"table_name": name})
        out = one if out is None else out.unionByName(one)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_differences(spark, d).select("table_name", "record_id", "difference")


def _store(spark: SparkSession, d: str) -> compact.Store:
    """All raw files taken into a new store; well-sized is 16 MB here, as the largest test data are a few hundred MB.

    Segments have 64 KB at level 1 and 1 MB at level 2, level 3 is the run.
    """
    store = compact.Store(spark, fresh_dir(spark, "compact"), target_bytes=16 << 20, fan_in=16)
    store.add(wide_table(spark, d, "raw_files"))
    return store


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).base().filter("n_files > 1").select("feed", "record_id")


def p2_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Every record exactly once: its latest copy, by time then file id."""
    return _store(spark, d).base().select("feed", "record_id", "file_id", "modified_at", "record", "n_files")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """The same with a field out of the kept copy's text."""
    return p2_compacted(spark, d).withColumn("rationale", F.get_json_object("record", "$.rationale")).drop("record")


def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Files that hold no record, and why; none is left out unseen."""
    return compact.rejected(wide_table(spark, d, "raw_files"))


def p2_levels(spark: SparkSession, d: str) -> DataFrame:
    """What the merges took in and gave, per level and feed."""
    j = _store(spark, d).journal()
    return j.groupBy("level", "kind", "feed").agg(F.sum("n_inputs").alias("n_inputs"), F.sum("n_outputs").alias("n_outputs"), F.sum("n_records").alias("n_records"))


def p2_journal(spark: SparkSession, d: str) -> DataFrame:
    """The journal's balance per feed: files taken in, records given, and segments that no merge or several merges took in."""
    j = _store(spark, d).journal()
    sums = j.groupBy("feed").agg(
        F.sum(F.when(F.col("kind") == "files", F.col("n_inputs"))).alias("n_files"), F.max(F.when(F.col("output").startswith("run="), F.col("n_records"))).alias("n_records"),
        F.max("level").alias("n_levels"),
    )
    made = j.filter("output NOT LIKE 'run=%'").select("feed", "level", F.col("output").alias("segment"))
    used = j.filter("kind = 'segments' AND output NOT LIKE 'run=%'").select("feed", (F.col("level") - 1).alias("level"), F.explode("inputs").alias("segment"))
    used = used.groupBy("feed", "level", "segment").agg(F.count("*").alias("n_uses"))
    last = j.filter("output LIKE 'run=%'").select("feed", (F.col("level") - 1).alias("level"), F.col("n_inputs").alias("n_last"))
    each = made.join(used, ["feed", "level", "segment"], "full").join(last, ["feed", "level"], "left")
    by = each.groupBy("feed", "level").agg(F.max("n_last").alias("n_last"), F.count("*").alias("n"), F.count_if(F.col("n_last").isNull() & (F.coalesce("n_uses", F.lit(0)) != 1)).alias("bad"))
    off = by.groupBy("feed").agg(F.sum(F.col("bad") + F.when(F.col("n_last").isNotNull(), F.abs(F.col("n_last") - F.col("n"))).otherwise(0)).alias("n_unbalanced"))
    return sums.join(off, "feed").select("feed", "n_levels", "n_files", "n_records", "n_unbalanced")


def _drift(spark: SparkSession, d: str):
    files, contracts = wide_table(spark, d, "raw_files"), drift.contracts_from(table(spark, d, "schema_fields"))
    return files, contracts, *drift.infer(files, contracts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    _, contracts, union, evidence = _drift(spark, d)
    return drift.changes(union, contracts, evidence).select("batch_id", "field_path", "change").distinct()


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    """The report with feed, type found and number of records."""
    _, contracts, union, evidence = _drift(spark, d)
    return drift.changes(union, contracts, evidence)


def p3_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return drift.alternatives(_drift(spark, d)[2])


def p3_relation(spark: SparkSession, d: str) -> DataFrame:
    files, contracts, _, evidence = _drift(spark, d)
    return drift.unified(files, contracts["relation"], evidence["relation"])


def p3_connection(spark: SparkSession, d: str) -> DataFrame:
    files, contracts, _, evidence = _drift(spark, d)
    return drift.unified(files, contracts["connection"], evidence["connection"])


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    rel, err = table(spark, d, "relation_predictions"), table(spark, d, "relation_errors")
    parents = orphans.parent_keys(table(spark, d, "knowledge_objects"), "knowledge_objects", ["lecture_id", "predicted_ko_id"], "created_at", "deleted_at")
    child = lambda df, t, r, ref: orphans.child_keys(df, "knowledge_objects", [f"{ref}.lecture_id", f"{ref}.ko_id"], t, r, f"{ref}.ko_id", "recorded_at")
    return orphans.orphans([
        parents, child(rel, "relation_predictions", "pair_id", "source"), child(rel, "relation_predictions", "pair_id", "target"),
        child(err, "relation_errors", "error_id", "predicted_source"),
    ])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "record_id", "field_name").distinct()


def p4_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.by_period(_orphans(spark, d))


RUN_LISTS = ["results", "results.evidence_spans", "results.attempts", "results.attempts.errors"]
#: Flat tables of run_metadata: group -> output column -> path.
RUN_TABLES = {
    "": {
        "artifact_type": "artifact_type", "version": "version", "model": "request_parameters.model", "temperature": "request_parameters.temperature",
        "top_p": "request_parameters.top_p", "max_tokens": "request_parameters.max_tokens", "response_format": "request_parameters.response_format.type",
        "thinking": "request_parameters.thinking.type", "prompt_path": "inputs.prompt.path", "prompt_sha256": "inputs.prompt.sha256",
        "bundle_path": "inputs.candidate_bundle.path", "bundle_sha256": "inputs.candidate_bundle.sha256",
    },
    "results": {
        "pair_id": "results.pair_id", "source_lecture_id": "results.source.lecture_id", "source_ko_id": "results.source.ko_id",
        "target_lecture_id": "results.target.lecture_id", "target_ko_id": "results.target.ko_id", "relation_type": "results.relation_type",
    },
    "results.evidence_spans": {
        "lecture_id": "results.evidence_spans.lecture_id", "span": "results.evidence_spans.span",
        "offset_start": "results.evidence_spans.offsets.start", "offset_end": "results.evidence_spans.offsets.end",
    },
    "results.attempts": {
        "latency_ms": "results.attempts.latency_ms", "finish_reason": "results.attempts.finish_reason",
        "prompt_tokens": "results.attempts.usage.prompt_tokens", "completion_tokens": "results.attempts.usage.completion_tokens",
    },
    "results.attempts.errors": {"error_type": "results.attempts.errors.error_type", "message": "results.attempts.errors.message"},
}
CHILDREN = {"results": "result", "results.evidence_spans": "evidence_span", "results.attempts": "attempt", "results.attempts.errors": "attempt_error"}


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return nested.latest_delivery(table(spark, d, "run_metadata"), "run_id", "body", ["started_at", "loaded_at"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the flat tables of children; their fields are left unread."""
    rows = nested.flattened(_runs(spark, d), "key", "body", RUN_LISTS, list(CHILDREN), [])
    child = F.create_map(*(F.lit(x) for pair in CHILDREN.items() for x in pair))[F.col("group")]
    no = lambda i: F.coalesce(F.get("ordinals", F.lit(i)), F.lit(-1)).cast("long")
    return rows.select(F.col("key").alias("run_id"), child.alias("child"), no(0).alias("result_no"), no(1).alias("item_no"), no(2).alias("subitem_no"))


def _run_table(group: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = nested.flattened(_runs(spark, d), "key", "body", RUN_LISTS, [group])
        return nested.table_of(rows, group, RUN_TABLES[group], RUN_LISTS).drop("others").withColumnRenamed("key", "run_id")

    return query


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row of every group with all its fields, whatever lists and fields the records hold."""
    return nested.flattened(_runs(spark, d), "key", "body", RUN_LISTS).withColumnRenamed("key", "run_id")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each path found, its group and whether a table of RUN_TABLES has a column for it."""
    fields = p5_rows(spark, d).select("group", F.explode("fields").alias("path", "value"))
    known = F.array(*(F.lit(p) for t in RUN_TABLES.values() for p in t.values()))
    return fields.groupBy("group", "path").agg(F.count("*").alias("n_fields"), F.count("value").alias("n_values")).withColumn("has_column", F.array_contains(known, F.col("path")))


def p5_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose body gives no row, and why; none is dropped unseen."""
    return nested.rejected(_runs(spark, d), "key", "body").withColumnRenamed("key", "run_id")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct row of relation_predictions under a key made of its content, times as texts."""
    times = [F.col(c).cast("string").alias(c) for c in ("recorded_at", "loaded_at")]
    body = F.struct("pair_id", "source", "target", "relation_type", "evidence_spans", "rationale", "run_id", *times)
    key = F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256).alias("row_key")
    return table(spark, d, "relation_predictions").select(key, "*").dropDuplicates(["row_key"])


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    refs = [F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("source", "target") for f in ("lecture_id", "ko_id")]
    return _pairs(spark, d).select("row_key", "pair_id", *refs, "relation_type", "rationale", "run_id", "recorded_at", "loaded_at")


def p5_pair_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = _pairs(spark, d).select("row_key", F.posexplode("evidence_spans").alias("span_no", "s")).filter("s IS NOT NULL")
    return spans.select("row_key", "span_no", "s.lecture_id", "s.span")


QUERIES = {
    "p1_found": p1_found, "p1_differences": p1_differences,
    "p2_found": p2_found, "p2_compacted": p2_compacted, "p2_journal": p2_journal, "p2_levels": p2_levels, "p2_records": p2_records, "p2_rejects": p2_rejects,
    "p3_found": p3_found, "p3_changes": p3_changes, "p3_alternatives": p3_alternatives, "p3_relation": p3_relation, "p3_connection": p3_connection,
    "p4_found": p4_found, "p4_by_month": p4_by_month,
    "p5_found": p5_found, "p5_runs": _run_table(""), "p5_results": _run_table("results"), "p5_evidence_spans": _run_table("results.evidence_spans"),
    "p5_attempts": _run_table("results.attempts"), "p5_attempt_errors": _run_table("results.attempts.errors"),
    "p5_rows": p5_rows, "p5_paths": p5_paths, "p5_rejects": p5_rejects, "p5_pairs": p5_pairs, "p5_pair_spans": p5_pair_spans,
}
