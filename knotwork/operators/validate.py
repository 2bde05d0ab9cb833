"""Validators: each gives ``key, violation`` rows; none is silently repaired."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import measures as M
from knotwork.functions import text as X
from knotwork.operators.audit import bijection, missing_parents, violations
from knotwork.operators.metrics import LABELS, NONE, RELATIONS
from knotwork.session import col


def _tagged(df: DataFrame, violation: str) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.lit(violation).alias("violation"))


def objects(df: DataFrame) -> DataFrame:
    """Gold objects ``lecture_id, obj_id, name, obj_type, category, aliases``: fields, ids and name keys that clash inside a lecture."""
    key = M.ref_label(F.col("lecture_id"), F.col("obj_id")).alias("key")
    fields = violations(df.withColumn("key", key), "key", {
        "name_missing": F.trim("name") != "", "type_unknown": F.col("obj_type").isin("Concept", "Method", "Formula"), "category_unknown": F.col("category").isin("required", "optional", "excluded"),
    })
    repeated = _tagged(df.groupBy(key).count().filter("count > 1"), "id_repeated")
    names = df.select("lecture_id", key, F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("lecture_id", "key", X.name_key(F.col("n")).alias("n")).distinct()
    owners = names.groupBy("lecture_id", "n").agg(F.min("key").alias("key"), F.max("key").alias("other")).filter("key <> other")
    return fields.unionByName(repeated).unionByName(_tagged(owners, "name_or_alias_clash"))


def files_repeated(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Files that share what must be their own (an id, a path, a content): every file but the first of each value. ``df`` has ``file``."""
    out = None
    for violation, value in columns.items():
        first = df.groupBy(value.alias("v_")).agg(F.min("file").alias("first_"), F.count("*").alias("n_")).filter("n_ > 1 AND v_ IS NOT NULL")
        rows = df.select(F.col("file").alias("key"), value.alias("v_")).join(first, "v_").filter("key <> first_")
        out = _tagged(rows, violation) if out is None else out.unionByName(_tagged(rows, violation))
    return out


def contiguous(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Ids ``prefix_N`` must be numbered from 1 without gaps: those whose number is over the count of distinct ids, and those of another form."""
    n = df.agg(F.countDistinct(col(key)).alias("n_"))  # one row
    number = F.regexp_extract(col(key), rf"\A{prefix}_0*(\d+)\z", 1).try_cast("long")
    rows = df.select(col(key).alias("key"), number.alias("i_")).distinct().crossJoin(F.broadcast(n))
    return _tagged(rows.filter("i_ IS NULL"), "id_form").unionByName(_tagged(rows.filter("i_ > n_ OR i_ < 1"), "id_not_contiguous"))


def relations(df: DataFrame, objects_: DataFrame, texts: DataFrame) -> DataFrame:
    """Gold relations ``pair_id, source, target, relation_type, category, symmetric, evidence_spans`` against objects and texts."""
    s, t = M.ref_label(F.col("source.lecture_id"), F.col("source.ko_id")), M.ref_label(F.col("target.lecture_id"), F.col("target.ko_id"))
    flat = df.withColumn("s_", s).withColumn("t_", t)
    kinds = objects_.select(M.ref_label(F.col("lecture_id"), F.col("obj_id")).alias("s_"), F.col("obj_type").alias("kind_"))
    none = F.col("relation_type") == NONE
    fields = violations(flat.join(kinds, "s_", "left"), "pair_id", {
        "type_unknown": F.col("relation_type").isin(*LABELS), "ends_equal": F.col("s_") != F.col("t_"),
        "category_disagrees": F.when(F.col("category") == "hard_negative", none).when(F.col("category") == "positive", ~none).otherwise(F.lit(True)),
        "formalizes_without_formula": (F.col("relation_type") != "FORMALIZES") | (F.col("kind_") == "Formula"),
        "symmetric_type": (~F.col("symmetric")) | (F.col("relation_type") == "CONTRASTS_WITH"),
        "evidence_missing": none | (F.size("evidence_spans") > 0),
    })
    known = kinds.select(F.col("s_").alias("ref"))
    lost = [_tagged(missing_parents(flat, known, c, "ref", "pair_id"), v) for c, v in (("s_", "source_unknown"), ("t_", "target_unknown"))]
    low, high = M.ends(F.col("s_"), F.col("t_"))
    twice = flat.groupBy(F.concat(low, F.lit("|"), high).alias("u_")).agg(F.min("pair_id").alias("key"), F.count("*").alias("n")).filter("n > 1 AND u_ IS NOT NULL")
    spans = flat.select("pair_id", F.explode("evidence_spans").alias("e")).select("pair_id", "e.lecture_id", "e.span").join(texts, "lecture_id", "left")
    inexact = spans.filter(~X.exact_span(F.col("text"), F.col("span"))).select(F.col("pair_id").alias("key")).distinct()
    out = fields.select(F.col("key").cast("string").alias("key"), "violation")
    for more in (*lost, _tagged(twice, "unordered_pair_repeated"), _tagged(inexact, "evidence_not_exact")):
        out = out.unionByName(more)
    return out


# Labels of candidate pairs.
CANDIDATE_LABELS = ("IN_SCHEMA_RELATION", "NO_IN_SCHEMA_RELATION", "OUT_OF_SCHEMA_RELATION", "AMBIGUOUS")


def candidates(df: DataFrame, objects_: DataFrame, texts: DataFrame, final: bool = True) -> DataFrame:
    """Annotations of candidate pairs: label and payload must agree.

    ``df`` has ``pair_id, lecture_id, ko_a, ko_b, candidate_label, annotation_status, gold_relations,
    out_of_schema, ambiguity, negative_rationale, annotation_source``, with ``gold_relations`` an array of
    ``struct<source, target, relation_type, role, symmetric, evidence_spans array<string>>``,
    ``out_of_schema`` a ``struct<relation_description, schema_exclusion_rationale, evidence_spans>`` and
    ``ambiguity`` a ``struct<rationale, competing_interpretations, adjudication_status>``. Objects have
    ``lecture_id, obj_id, obj_type``, texts ``lecture_id, text``.
    """
    c = F.col
    label = F.coalesce("candidate_label", F.lit(""))
    golds = F.coalesce("gold_relations", F.array())
    n_gold, n_primary = F.size("gold_relations"), F.size(F.filter("gold_relations", lambda r: r["role"] == "primary"))
    some, filled = F.coalesce(n_gold > 0, F.lit(False)), lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    out, amb, why = c("out_of_schema"), c("ambiguity"), c("negative_rationale")
    is_ = lambda x: label == x
    unless = lambda x, ok: ~is_(x) | F.coalesce(ok, F.lit(False))
    edges = F.transform("gold_relations", lambda r: F.struct(r["source"], r["target"], r["relation_type"], r["role"]))
    known = F.array("ko_a", "ko_b")
    status, settled = c("annotation_status"), F.coalesce(amb["adjudication_status"] == "adjudicated_final", F.lit(False))
    checks: dict[str, Column] = {
        "label_unknown": c("candidate_label").isNull() | label.isin(*CANDIDATE_LABELS), "status_unknown": status.isin("draft", "pending_review", "final"),
        "status_not_final": F.lit(not final) | (status == "final"), "label_missing": c("candidate_label").isNotNull() | ~status.isin("final", "pending_review"),
        "payload_without_label": c("candidate_label").isNotNull() | (~some & out.isNull() & amb.isNull() & why.isNull()),
        "relation_missing": unless("IN_SCHEMA_RELATION", some), "primary_not_one": unless("IN_SCHEMA_RELATION", n_primary == 1),
        "positive_with_other_payload": unless("IN_SCHEMA_RELATION", out.isNull() & amb.isNull() & why.isNull()),
        "negative_with_relations": unless("NO_IN_SCHEMA_RELATION", ~some), "negative_with_other_payload": unless("NO_IN_SCHEMA_RELATION", out.isNull() & amb.isNull()), "negative_without_rationale": unless("NO_IN_SCHEMA_RELATION", filled(why)),
        "gap_with_other_payload": unless("OUT_OF_SCHEMA_RELATION", ~some & amb.isNull() & why.isNull()),
        "gap_incomplete": unless("OUT_OF_SCHEMA_RELATION", filled(out["relation_description"]) & filled(out["schema_exclusion_rationale"]) & (F.size(out["evidence_spans"]) > 0)),
        "ambiguous_with_other_payload": unless("AMBIGUOUS", out.isNull() & why.isNull()), "ambiguous_with_primary": unless("AMBIGUOUS", F.coalesce(n_primary, F.lit(0)) == 0),
        "ambiguous_incomplete": unless("AMBIGUOUS", filled(amb["rationale"]) & (F.size(F.filter(amb["competing_interpretations"], filled)) == F.size(amb["competing_interpretations"])) & (F.size(amb["competing_interpretations"]) >= 2)),
        "ambiguous_not_adjudicated": unless("AMBIGUOUS", (status != "final") | (settled & (c("annotation_source") == "adjudicated"))),
        "source_missing": c("candidate_label").isNull() | filled(c("annotation_source")),
        "relation_repeated": F.coalesce(F.size(F.array_distinct(edges)) == n_gold, F.lit(True)),
        "relation_type_unknown": F.forall(golds, lambda r: F.coalesce(r["relation_type"].isin(*RELATIONS), F.lit(False))),
        "ends_not_of_pair": F.forall(golds, lambda r: F.coalesce(F.array_contains(known, r["source"]) & F.array_contains(known, r["target"]) & (r["source"] != r["target"]), F.lit(False))),
        "symmetric_type": F.forall(golds, lambda r: ~F.coalesce(r["symmetric"], F.lit(False)) | F.coalesce(r["relation_type"] == "CONTRASTS_WITH", F.lit(False))),
    }
    fields = violations(df, "pair_id", checks).select(c("key").cast("string").alias("key"), "violation")
    each = df.select("pair_id", "lecture_id", F.explode("gold_relations").alias("r"))
    kinds = objects_.select("lecture_id", c("obj_id").alias("source"), "obj_type")
    formal = each.select("pair_id", "lecture_id", "r.source", "r.relation_type").filter("relation_type = 'FORMALIZES'").join(kinds, ["lecture_id", "source"], "left").filter("obj_type IS NULL OR obj_type <> 'Formula'")
    spans = each.select("pair_id", "lecture_id", F.explode_outer("r.evidence_spans").alias("span")).unionByName(df.filter("out_of_schema IS NOT NULL").select("pair_id", "lecture_id", F.explode("out_of_schema.evidence_spans").alias("span")))
    inexact = spans.join(texts.select("lecture_id", "text"), "lecture_id", "left").filter(~X.exact_span(c("text"), c("span")))
    key = c("pair_id").cast("string").alias("key")
    return fields.unionByName(_tagged(formal.select(key).distinct(), "formalizes_without_formula")).unionByName(_tagged(inexact.select(key).distinct(), "evidence_not_exact"))


def connections(gold: DataFrame, universe: DataFrame, catalog: DataFrame, places: DataFrame) -> DataFrame:
    """Audit of connection gold: its pairs are the universe's, its evidence stands in the catalog, negatives that share a block were reviewed.

    ``gold`` has ``pair_id, a, b, category, origin, primary, evidence`` (an array of ``struct<evidence_id,
    lecture_id, block_index, span>``), ``universe`` ``pair_id``, ``catalog`` the regenerated ``pair_id,
    evidence_id, lecture_id, block_index, span``, and ``places`` the blocks in which an object's spans
    stand: ``object, lecture_id, block_index``.
    """
    c = F.col
    audit = bijection(universe, gold, "pair_id")
    names = {"missing": "pair_not_in_universe", "extra": "pair_without_gold", "repeated_left": "universe_repeated", "repeated_right": "pair_repeated", "null_key": "pair_null"}
    mapped = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[c("problem")]
    out = audit.select(c("key").cast("string").alias("key"), mapped.alias("violation"))
    cols = ["pair_id", "evidence_id", "lecture_id", "block_index", "span"]
    cited = gold.select("pair_id", F.explode("evidence").alias("e")).select("pair_id", "e.*").select(*cols)
    stale = cited.join(catalog.select(*cols).distinct(), cols, "left_anti").select(c("pair_id").alias("key")).distinct()
    bare = gold.select("pair_id").join(catalog.select("pair_id").distinct(), "pair_id", "left_anti").select(c("pair_id").alias("key")).distinct()
    negative = gold.filter("category = 'NO_IN_SCHEMA_CONNECTION'")
    at = lambda end: negative.select("pair_id", "origin", c(end).alias("object")).join(places, "object").select("pair_id", "origin", "lecture_id", "block_index").distinct()
    shared = at("a").join(at("b").drop("origin"), ["pair_id", "lecture_id", "block_index"])
    unreviewed = shared.filter("origin IS NULL OR origin <> 'explicit_reviewed_decision'").select(c("pair_id").alias("key")).distinct()
    odd = gold.filter("primary AND (category IS NULL OR category NOT IN ('IN_SCHEMA_CONNECTION', 'NO_IN_SCHEMA_CONNECTION'))").select(c("pair_id").alias("key"))
    for rows, violation in ((stale, "evidence_not_in_catalog"), (bare, "pair_without_catalog"), (unreviewed, "shared_block_negative_unreviewed"), (odd, "primary_of_other_category")):
        out = out.unionByName(_tagged(rows, violation))
    return out


def partition(clusters: DataFrame, mentions: DataFrame) -> DataFrame:
    """Clusters ``canonical_id, canonical_type, mention_ids`` must hold every mention ``mention_id, type`` exactly once, of one type."""
    each = clusters.select("canonical_id", "canonical_type", F.explode("mention_ids").alias("mention_id"))
    audit = bijection(each, mentions, "mention_id")
    names = {"missing": "mention_in_no_cluster", "extra": "mention_unknown", "repeated_left": "mention_in_two_places", "repeated_right": "mention_repeated", "null_key": "mention_null"}
    mapped = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("problem")]
    cross = each.join(mentions.select("mention_id", "type"), "mention_id").filter("NOT type <=> canonical_type").select(F.col("canonical_id").alias("key")).distinct()
    return audit.select(F.col("key").cast("string").alias("key"), mapped.alias("violation")).unionByName(_tagged(cross, "cluster_of_two_types"))


def selection(selected: DataFrame, universe: DataFrame, key: str, ends: tuple[str, str], unchanged: Sequence[str] = ()) -> DataFrame:
    """Selected pairs must be of the universe, once each, with different ends and unchanged fields."""
    unknown = _tagged(selected.select(col(key).alias(key)).join(universe.select(key), key, "left_anti").withColumnRenamed(key, "key"), "pair_unknown")
    twice = _tagged(selected.groupBy(col(key).alias("key")).count().filter("count > 1"), "pair_repeated")
    loops = _tagged(selected.filter(col(ends[0]) == col(ends[1])).select(col(key).alias("key")), "self_pair")
    j = selected.alias("s").join(universe.alias("u"), key)
    differs = F.lit(False)
    for c in (*ends, *unchanged):
        differs = differs | ~F.col(f"s.{c}").eqNullSafe(F.col(f"u.{c}"))
    return unknown.unionByName(twice).unionByName(loops).unionByName(_tagged(j.filter(differs).select(F.col(key).alias("key")), "field_changed"))


def predictions(df: DataFrame, expected: DataFrame, key: str, positives_need_evidence: bool = True) -> DataFrame:
    """Predictions ``key, relation_type, evidence_ids`` against the expected ``key, allowed`` (evidence ids a pair may cite)."""
    aligned = bijection(df, expected, key).filter("problem <> 'repeated_right'")
    j = df.join(expected.select(key, "allowed"), key)
    ids = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    positive = F.col("relation_type").isin(*RELATIONS)
    checks: dict[str, Column] = {
        "type_unknown": F.col("relation_type").isin(*LABELS, "DIRECT"), "evidence_not_allowed": F.size(F.array_except(ids, F.coalesce("allowed", F.array().cast("array<string>")))) == 0,
        "evidence_repeated": F.size(F.array_distinct(ids)) == F.size(ids), "negative_with_evidence": (F.col("relation_type") != NONE) | (F.size(ids) == 0),
    }
    if positives_need_evidence:
        checks["positive_without_evidence"] = ~positive | (F.size(ids) > 0)
    rows = violations(j, key, checks)
    return aligned.select(F.col("key").cast("string").alias("key"), F.col("problem").alias("violation")).unionByName(rows.select(F.col("key").cast("string").alias("key"), "violation"))


def alignment(rows: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every object of both sides must be accounted for, and matched ones once."""
    sides = []
    for side, objects_ in (("gold_id", gold), ("pred_id", predicted)):
        seen = rows.filter(F.col(side).isNotNull())
        lost = objects_.select(col(side).alias(side)).join(seen.select(side), side, "left_anti").withColumnRenamed(side, "key")
        twice = seen.filter("status = 'matched'").groupBy(F.col(side).alias("key")).count().filter("count > 1")
        sides += [_tagged(lost, f"{side}_not_accounted"), _tagged(twice, f"{side}_matched_twice")]
    out = sides[0]
    for more in sides[1:]:
        out = out.unionByName(more)
    return out


#: What the labels of a failed review must be, by kind of unfaithfulness.
FAILURES = {"relation_faithful": "RELATION_DISTORTION", "direction_faithful": "DIRECTION_REVERSAL", "endpoint_faithful": "ENDPOINT_DRIFT"}


def reviews(df: DataFrame, key: str = "explanation_instance_id") -> DataFrame:
    """Explanation reviews: claims present and labelled once each, failure labels that agree with faithfulness, scores from 1 to 5 only on faithful ones."""
    labels = F.coalesce("failure_labels", F.array().cast("array<string>"))
    ids = F.transform("claims", lambda c: c["claim_id"])
    faithful = F.lit(True)
    checks: dict[str, Column] = {
        "claims_missing": F.size("claims") > 0, "claim_repeated": F.size(F.array_distinct(ids)) == F.size(ids), "claim_text_empty": F.forall("claims", lambda c: F.trim(c["claim_text"]) != ""),
        "failure_label_repeated": F.size(F.array_distinct(labels)) == F.size(labels),
    }
    for field, label in FAILURES.items():
        ok = F.col(f"faithfulness.{field}")
        faithful = faithful & F.coalesce(ok, F.lit(False))
        checks[f"{field}_unset"] = ok.isNotNull()
        checks[f"{label.lower()}_label"] = F.array_contains(labels, label) == ~ok
    s = F.col("learning_value_scores")
    checks["scores_of_unfaithful"] = faithful | s.isNull()
    checks["score_out_of_range"] = s.isNull() | (s["clarity"].between(1, 5) & s["specificity"].between(1, 5))
    return violations(df, key, checks)


def rule_config(rules: Mapping) -> list[str]:
    """Faults of a rule configuration: order, thresholds, pair ids."""
    faults = []
    # The order of the rules.
    order = ["source_proximity", "lexical_overlap", "symbol_overlap", "explicit_reference", "type_compatibility"]
    if list(rules.get("reason_order", [])) != order:
        faults.append("reason_order")
    if rules.get("type_compatibility", {}).get("enabled"):
        faults.append("type_compatibility must be disabled")
    distance = rules.get("source_proximity", {}).get("max_distance")
    if not isinstance(distance, int) or not 0 <= distance <= 5:
        faults.append("max_distance")
    for rule, name in (("lexical_overlap", "min_words"), ("symbol_overlap", "min_symbols")):
        n = rules.get(rule, {}).get(name)
        if not isinstance(n, int) or not 1 <= n <= 5:
            faults.append(name)
    if "pair_id" in str(rules):
        faults.append("pair ids in rules")
    return faults
