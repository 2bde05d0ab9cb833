"""Whole pipelines: canonicalization, connection discovery, alignment, projection, gold materialization, comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import measures as M
from knotwork.functions import text as X
from knotwork.operators import clusters, matching, metrics, scoring
from knotwork.operators.audit import IntegrityError, require_empty
from knotwork.operators.pairs import identity_candidates, numbered
from knotwork.session import col


def canonicalize(mentions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Clusters of ``mention_id, type, name, position`` by type and normal name, or by alias key where ``aliases`` (``type, alias, key``) has one."""
    keyed = mentions.withColumn("own_", X.name_audit(F.col("name"))["key"])
    if aliases is None:
        keyed = keyed.withColumn("key_", F.col("own_"))
    else:
        a = aliases.select("type", X.name_key(F.col("alias")).alias("own_"), F.col("key").alias("to_")).groupBy("type", "own_").agg(F.min("to_").alias("to_"))
        keyed = keyed.join(a, ["type", "own_"], "left").withColumn("key_", F.coalesce("to_", "own_"))
    return clusters.group_clusters(keyed, "type", "key_", "mention_id", "name", "position")


def context_clusters(mentions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(clusters, contradictions)`` from mentions and decisions ``a, b, decision``.

    An UNRESOLVED decision stops the run before clustering; so does a decision on an unknown
    mention. Mentions without a SAME_OBJECT decision stay alone.
    """
    require_empty(decisions.filter("decision = 'UNRESOLVED' OR decision IS NULL").select("a", "b"), "decisions that need adjudication")
    known = mentions.select(F.col("mention_id").alias("m"))
    ends = decisions.select(F.explode(F.array("a", "b")).alias("m"))
    require_empty(ends.join(known, "m", "left_anti"), "decisions on unknown mentions")
    labels = clusters.components(decisions.filter("decision = 'SAME_OBJECT'"), "a", "b", mentions, "mention_id")
    bad = clusters.contradictions(labels, decisions.filter("decision = 'DISTINCT_OBJECT'"), "a", "b")
    joined = mentions.join(labels.withColumnRenamed("node", "mention_id"), "mention_id")
    return clusters.group_clusters(joined, "type", "component", "mention_id", "name", "position"), bad


def resolve_context(mentions: DataFrame, block: str, scorer: scoring.Scorer, spans: str | None = None, **options) -> DataFrame:
    """Identity candidates, each scored: ``block, a, b, reasons, decision, error``.

    The scorer sees both names and the reasons as JSON and answers ``{"decision": ...}``; anything
    else is UNRESOLVED.
    """
    found = identity_candidates(mentions, block, "mention_id", "type", "name", spans)
    names = mentions.select(F.col("mention_id").alias("m"), F.col("name").alias("n"))
    asked = found.join(names.toDF("a", "name_a"), "a").join(names.toDF("b", "name_b"), "b")
    asked = asked.withColumn("request", F.to_json(F.struct("name_a", "name_b", "reasons")))
    out = scoring.scored(asked, "request", scorer, **options)
    answer = F.get_json_object("response", "$.decision")
    decision = F.when(answer.isin("SAME_OBJECT", "DISTINCT_OBJECT"), answer).otherwise("UNRESOLVED")
    return out.select("block", "a", "b", "reasons", decision.alias("decision"), "error")


def classified(pairs: DataFrame, key: str, visible: Sequence[str], forbidden: Sequence[str], scorer: scoring.Scorer, kinds: Sequence[str] = metrics.LABELS, **options) -> DataFrame:
    """One-stage classification: request per pair, response parsed and checked; a faulty one is quarantined as ``error``."""
    asked = scoring.requests(pairs, key, visible, forbidden, "classify the pair", "scorer")
    out = scoring.scored(asked, "request", scorer, **options)
    body = scoring.response_content(F.col("response"), "relation_type string, evidence_ids array<string>, rationale string")
    kind = body["relation_type"]
    ok = F.coalesce(kind.isin(*kinds), F.lit(False))
    error = F.coalesce("error", F.when(~ok, F.lit("invalid_relation_type")))
    return out.select(F.col("key").alias(key), F.when(ok, kind).alias("relation_type"), F.when(ok, body["evidence_ids"]).alias("evidence_ids"), F.when(ok, body["rationale"]).alias("rationale"), "attempts", error.alias("error"))


def evidence_subset(df: DataFrame, key: str, evidence: str, ids: str) -> DataFrame:
    """``df`` with ``evidence`` cut to the items whose ``evidence_id`` is in the array ``ids``, in stored order, and ``subset_error``.

    An id that no item has, and an id cited twice, are errors; a null or empty ``ids`` gives no items.
    """
    cited = F.coalesce(col(ids), F.array().cast("array<string>"))
    kept = F.filter(F.coalesce(col(evidence), F.array()), lambda e: F.array_contains(cited, e["evidence_id"]))
    error = F.when(F.size(F.array_distinct(cited)) != F.size(cited), "evidence_id_repeated").when(F.size(kept) != F.size(cited), "evidence_id_unknown")
    return df.withColumn(evidence, kept).withColumn("subset_error", error)


def two_stage_classified(pairs: DataFrame, key: str, gate: scoring.Scorer, typer: scoring.Scorer, visible: Sequence[str], forbidden: Sequence[str] = (), evidence: str | None = None) -> DataFrame:
    """A gate over all pairs, a typer over those it lets pass, ``NO_RELATION`` for the rest; no pair is lost.

    With ``evidence``, an array column of structs with ``evidence_id``, the typer sees only the items that
    the gate cited; a pair whose citation does not hold goes to no typer and has the fault as its error.
    """
    gated = classified(pairs, key, visible, forbidden, gate, ("DIRECT", metrics.NONE)).select(key, F.col("relation_type").alias("gate"), F.col("evidence_ids").alias("gate_ids"), F.col("error").alias("gate_error"))
    direct = pairs.join(gated.filter("gate = 'DIRECT'").select(key, "gate_ids"), key)
    if evidence is None:
        direct = direct.withColumn("subset_error", F.lit(None).cast("string"))
    else:
        direct = evidence_subset(direct, key, evidence, "gate_ids")
    typed = classified(direct.filter("subset_error IS NULL"), key, visible, forbidden, typer)
    faults = direct.filter("subset_error IS NOT NULL").select(key, F.col("subset_error"))
    joined = gated.drop("gate_ids").join(typed, key, "left").join(faults, key, "left")
    return joined.withColumn("relation_type", F.coalesce("relation_type", F.lit(metrics.NONE))).withColumn("error", F.coalesce("error", "subset_error")).drop("subset_error")


def verified_windows(windows: DataFrame, pair: str, scorer: scoring.Scorer, visible: Sequence[str], pairs: DataFrame | None = None) -> DataFrame:
    """Each window scored, then one edge per pair if the direct windows agree on one."""
    asked = windows.withColumn("request", F.to_json(F.struct(*(col(c) for c in visible))))
    out = scoring.scored(asked, "request", scorer)
    body = F.from_json("response", "support_decision string, source string, target string, relation_type string")
    decided = out.select(pair, "window_id", F.size("evidence_ids").alias("size"), F.coalesce(body["support_decision"] == "DIRECT_IN_SCHEMA", F.lit(False)).alias("direct"), body["source"].alias("source"), body["target"].alias("target"), body["relation_type"].alias("relation_type"))
    return clusters.aggregate_edges(decided, pair, "direct", ["source", "target", "relation_type"], "size", "window_id", pairs)


def aligned(gold: DataFrame, predicted: DataFrame, group: str, reserved: DataFrame | None = None) -> DataFrame:
    """``group, gold_id, pred_id, status``: every object of both sides exactly once or in an ambiguous component.

    ``gold`` has ``group, gold_id, name, aliases``; ``predicted`` has ``group, pred_id, name``.
    Rows of ``reserved`` (``gold_id, pred_id`` under review) are taken out first. A component of one
    and one is ``matched``, another one ``ambiguous``; what is left is ``provenance_mismatch`` if the
    same name is left on the other side in another group, else ``unmatched``.
    """
    g = gold.withColumn("key", X.name_key(F.col("name")))
    p = predicted.withColumn("key", X.name_key(F.col("name")))
    if reserved is not None:
        g = g.join(reserved.select("gold_id").distinct(), "gold_id", "left_anti")
        p = p.join(reserved.select("pred_id").distinct(), "pred_id", "left_anti")
    by_alias = g.select(group, "gold_id", F.explode("aliases").alias("a")).select(group, "gold_id", X.name_key(F.col("a")).alias("key"))
    keys = g.select(group, "gold_id", "key").unionByName(by_alias).distinct()
    matches = keys.join(p.select(group, "pred_id", "key"), [group, "key"]).select("gold_id", "pred_id").distinct()
    parts = clusters.bipartite(matches, "gold_id", "pred_id")
    met = parts.select(F.col("left").alias("gold_id"), F.col("right").alias("pred_id"), "status")
    met = met.join(g.select(group, "gold_id"), "gold_id").select(group, "gold_id", "pred_id", "status")
    free_g = g.join(met.select("gold_id").distinct(), "gold_id", "left_anti")
    free_p = p.join(met.select("pred_id").distinct(), "pred_id", "left_anti")

    def left(one: DataFrame, other: DataFrame) -> DataFrame:
        elsewhere = other.groupBy("key").agg(F.min(group).alias("lo_"), F.max(group).alias("hi_"))
        j = one.join(elsewhere, "key", "left")
        away = F.coalesce((F.col("lo_") != F.col(group)) | (F.col("hi_") != F.col(group)), F.lit(False))
        return j.withColumn("status", F.when(away, "provenance_mismatch").otherwise("unmatched"))

    null = F.lit(None).cast("string")
    rows = met.unionByName(left(free_g, free_p).select(group, "gold_id", null.alias("pred_id"), "status")).unionByName(left(free_p, free_g).select(group, null.alias("gold_id"), "pred_id", "status"))
    return rows


def projected(pairs: DataFrame, alignment: DataFrame, key: str, ends: tuple[str, str], gold_objects: DataFrame, predicted_objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(manifest, input with gold objects, input with predicted objects)`` over recoverable pairs.

    Both inputs have the same pairs, order and neutral slot ids; they differ only in the objects'
    content. ``alignment`` has ``ref, status, counterpart``, the objects have ``ref, name``.
    """
    manifest = matching.recoverable(pairs, alignment, key, ends)
    kept = manifest.filter("recoverable")
    slot = matching.slots(kept, key, list(ends)).select("ref", "slot").distinct()
    side = lambda df, end: df.join(slot.select(F.col("ref").alias(end), F.col("slot").alias(f"{end}_slot")), end)
    slotted = side(side(kept, ends[0]), ends[1])

    def with_names(objects: DataFrame, refs: Sequence[str]) -> DataFrame:
        out = slotted
        for end, ref in zip(ends, refs, strict=True):
            out = out.join(objects.select(F.col("ref").alias(ref), F.col("name").alias(f"{end}_name")), ref, "left")
        return out.select(key, f"{ends[0]}_slot", f"{ends[1]}_slot", f"{ends[0]}_name", f"{ends[1]}_name")

    return manifest, with_names(gold_objects, ends), with_names(predicted_objects, ("counterpart_0", "counterpart_1"))


def check_projection(a: DataFrame, b: DataFrame, structure: Sequence[str]) -> None:
    """The two inputs must be equal in their structural columns."""
    x, y = (df.select(*map(col, structure)) for df in (a, b))
    require_empty(x.exceptAll(y).unionByName(y.exceptAll(x)), "inputs differ in structure")


def relation_gold(candidates: DataFrame) -> DataFrame:
    """Candidate labels to relation categories; ids are rewritten; an AMBIGUOUS label is an error."""
    require_empty(candidates.filter("candidate_label = 'AMBIGUOUS'").select("pair_id"), "ambiguous labels")
    label = F.col("candidate_label")
    category = M.first_true({"positive": label == "POSITIVE", "hard_negative": label == "NEGATIVE", "schema_gap": label == "SCHEMA_GAP", "diagnostic": label == "DIAGNOSTIC"})
    return candidates.withColumn("category", category).withColumn("pair_id", F.regexp_replace("pair_id", "^cand_", "rel_"))


def connection_gold(universe: DataFrame, decisions: DataFrame, key: str, ends: tuple[str, str]) -> DataFrame:
    """Explicit decisions (``x, y, relation_type``) over a reviewed-negative default; unknown or repeated ones are errors."""
    require_empty(decisions.filter("x IS NULL OR y IS NULL").select("x", "y"), "decisions on half a pair")
    x, y = M.ends(F.col("x"), F.col("y"))
    d = decisions.select(x.alias("x_"), y.alias("y_"), F.col("relation_type").alias("decided_type"))
    require_empty(d.groupBy("x_", "y_").count().filter("count > 1"), "pairs decided twice")
    u = universe.withColumns(dict(zip(("x_", "y_"), M.ends(*map(col, ends)), strict=True)))
    require_empty(d.join(u, ["x_", "y_"], "left_anti").select("x_", "y_"), "decisions on unknown pairs")
    j = u.join(d, ["x_", "y_"], "left").drop("x_", "y_")
    return j.withColumn("relation_type", F.coalesce("decided_type", F.lit(metrics.NONE))).withColumn("basis", F.when(F.col("decided_type").isNull(), "reviewed_negative").otherwise("explicit")).drop("decided_type")


def explanation_benchmark(edges: DataFrame, key: str, visible: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(instances, blind annotation rows)`` of the eligible positives, numbered in key order; the annotation side shows no relation."""
    eligible = edges.filter(F.col("relation_type").isin(*metrics.RELATIONS))
    n = numbered(eligible, [key]).withColumn("explanation_instance_id", M.sequence_id("explanation", F.col("no"), 6))
    instances = n.select("explanation_instance_id", *dict.fromkeys([key, "relation_type", *visible]))
    blind = n.select(M.short_hash(F.lit("blind"), "explanation_instance_id").alias("blind_review_id"), "explanation_instance_id", *visible)
    return instances, blind


def compared(runs: Mapping[str, DataFrame], required: Mapping[str, Column]) -> DataFrame:
    """One-row metric tables of several methods under their names, with whether all conditions hold; an empty table is an error."""
    out = None
    for name, df in runs.items():
        if df.isEmpty():
            raise IntegrityError(f"no metrics for {name}")
        row = df.withColumn("method", F.lit(name)).withColumn("failed", M.all_true({k: ~F.coalesce(c, F.lit(False)) for k, c in required.items()}))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("accepted", F.size("failed") == 0)


def matched_execution(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields in which the run metadata of two arms (one row each) differ."""
    j = a.select(*(col(f).cast("string").alias(f"a_{i}") for i, f in enumerate(fields))).crossJoin(b.select(*(col(f).cast("string").alias(f"b_{i}") for i, f in enumerate(fields))))  # one row each
    rows = [F.when(~F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}")), F.struct(F.lit(f).alias("field"), F.col(f"a_{i}").alias("left_value"), F.col(f"b_{i}").alias("right_value"))) for i, f in enumerate(fields)]
    return j.select(M.multi(rows).alias("x")).select("x.*")
