"""The registry of queries and the base tables they share, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.text import STOP_WORDS
from knotwork.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def latest(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the latest recorded, then loaded; ``max`` combines map-side."""
    rest = [c for c in df.columns if c not in (key, "recorded_at", "loaded_at")]
    return df.groupBy(key).agg(F.max(F.struct("recorded_at", "loaded_at", *rest)).alias("r")).select(key, "r.*")


def latest_sql(name: str, key: str) -> str:
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY recorded_at DESC, loaded_at DESC) = 1)"


def relations(spark: SparkSession, d: str, copy: str = "") -> DataFrame:
    return latest(table(spark, d, f"relation_predictions{copy}"), "pair_id")


def connections(spark: SparkSession, d: str, copy: str = "") -> DataFrame:
    return latest(table(spark, d, f"connection_predictions{copy}"), "canonical_pair_id")


REL, REL2 = latest_sql("relation_predictions", "pair_id"), latest_sql("relation_predictions_copy", "pair_id")
CON, CON2 = latest_sql("connection_predictions", "canonical_pair_id"), latest_sql("connection_predictions_copy", "canonical_pair_id")


def objects(spark: SparkSession, d: str) -> DataFrame:
    """One row per knowledge object: name, type, its distinct spans in order."""
    k = table(spark, d, "knowledge_objects")
    one = k.groupBy("lecture_id", "predicted_ko_id").agg(F.min("name").alias("name"), F.min("type").alias("type"), F.collect_set("source_spans").alias("s"))
    spans = F.array_sort(F.array_distinct(F.filter(F.flatten("s"), lambda x: x.isNotNull())))
    return one.select("lecture_id", "predicted_ko_id", "name", "type", spans.alias("spans"))


KO = """(SELECT lecture_id, predicted_ko_id, min(name) AS name, min(type) AS type,
    coalesce(list_sort(list_distinct(list_filter(flatten(list(source_spans) FILTER (source_spans IS NOT NULL)), lambda x: x IS NOT NULL))), []) AS spans
    FROM knowledge_objects GROUP BY 1, 2)"""


def lectures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lectures").groupBy("lecture_id").agg(F.max("text").alias("text"), F.max("course_id").alias("course_id"), F.max("lang").alias("lang"))


LEC = "(SELECT lecture_id, max(text) AS text, max(course_id) AS course_id, max(lang) AS lang FROM lectures GROUP BY 1)"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
BLOCK_LIST = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '')"
BLOCKS = f"""(SELECT lecture_id, unnest(range(len(b))) AS block_index, unnest(b) AS span
    FROM (SELECT lecture_id, {BLOCK_LIST} AS b FROM {LEC}))"""
NAME_KEY = "replace(lower(trim(regexp_replace(translate({0}, '‘’‛`´‐‑‒–—―', '''''''''''------'), '\\s+', ' ', 'g'))), 'ß', 'ss')"
WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
STOPS = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"
TOKENS = f"list_distinct(list_filter({WORDS}, lambda x: NOT list_contains({STOPS}, x)))"
