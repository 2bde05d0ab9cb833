"""Queries of the text problems; where SQL is possible its text, else tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import encode, look, pack, spans
from knotwork.session import table, wide_table

MIN_SHARED = 160


def _spans(spark: SparkSession, d: str) -> DataFrame:
    relations = look.spans_of(wide_table(spark, d, "relation_predictions"), "relation_predictions", "pair_id")
    return relations.unionByName(look.spans_of(wide_table(spark, d, "identity_decisions"), "identity_decisions", "candidate_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return look.disguised(_spans(spark, d), table(spark, d, "lectures"))


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every span with its consistent form."""
    return look.normalized(_spans(spark, d), "span")


def p6_lectures(spark: SparkSession, d: str) -> DataFrame:
    """Every lecture text in its consistent form."""
    return look.normalized(wide_table(spark, d, "lectures").select("lecture_id", "text"), "text")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(wide_table(spark, d, "documents"), "doc_id", "text")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    counted = encode.token_counts(wide_table(spark, d, "documents"), "doc_id", "text")
    return pack.packed(counted, table(spark, d, "context_windows"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per window the containers, their tokens and the least number of containers that any packing needs."""
    placed = p8_pack(spark, d).groupBy("window_name").agg(F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    caps = table(spark, d, "context_windows").select("window_name", "capacity")
    least = F.ceil(F.col("n_tokens") / F.col("capacity"))
    return placed.join(F.broadcast(caps), "window_name").withColumn("at_least", least).withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = spans.shared_spans(wide_table(spark, d, "documents"), "doc_id", "text", MIN_SHARED)
    return found.select(F.col("id").alias("doc_id"), "span_start", "span_end")


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """For every document how many of its characters are shared."""
    shared = p9_found(spark, d).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    every = table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    return every.join(shared, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


QUERIES = {
    "p6_found": p6_found, "p6_spans": p6_spans, "p6_lectures": p6_lectures,
    "p7_ids": p7_ids, "p8_pack": p8_pack, "p8_fill": p8_fill, "p9_found": p9_found, "p9_shared": p9_shared,
}
ORACLE: dict[str, str] = {}
