"""Scans and sinks: JSON artifacts, lecture texts, bundles with markers, manifests, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.functions import text as X
from knotwork.operators.audit import IntegrityError, require_empty, stale


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_json(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON by an explicit schema; a malformed file is an error, not a null row. Adds the file's path."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def read_lectures(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """``path, lecture_id, text, body, sha256`` of each file: one row per file, whatever its size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    text = F.decode("content", "UTF-8")
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.select("path", name.alias("lecture_id"), text.alias("text"), X.lecture_body(text).alias("body"), F.sha2("content", 256).alias("sha256"))


def exploded_predictions(df: DataFrame) -> DataFrame:
    """Nested predictions ``lecture_id, knowledge_objects, source_file`` to one row per object with provenance.

    The enclosing lecture id counts, else the object's own; an object with another one is marked
    ``provenance_conflict``.
    """
    each = df.select("lecture_id", "source_file", F.posexplode("knowledge_objects").alias("i", "o"))
    own = F.col("o.lecture_id") if "lecture_id" in df.schema["knowledge_objects"].dataType.elementType.names else F.lit(None).cast("string")
    lecture = F.coalesce(F.col("lecture_id"), own)
    return each.select(
        lecture.alias("lecture_id"), F.col("o.id").alias("predicted_ko_id"), F.col("o.name").alias("name"), F.col("o.type").alias("type"), F.array("o.source_span").alias("source_spans"),
        F.struct(F.col("o.id").alias("source_prediction_id"), F.col("source_file").alias("source_file"), F.col("i").alias("source_object_index")).alias("provenance"),
        F.coalesce(F.col("lecture_id") != own, F.lit(False)).alias("provenance_conflict"),
    )


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def write_bundle(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> str:
    """Tables under ``path``, then a manifest with the hash of every file, then the marker that makes the bundle complete.

    Refuses a path that holds a complete bundle; what an interrupted run left is written over.
    """
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, f"{path}/manifest/_SUCCESS"):
        raise FileExistsError(path)
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")
    hashes = [file_hashes(spark, f"{path}/{name}").withColumn("table", F.lit(name)) for name in tables]
    manifest = hashes[0]
    for h in hashes[1:]:
        manifest = manifest.unionByName(h)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return path


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a complete bundle; a missing marker or a changed, missing file is an error."""
    if not exists(spark, f"{path}/manifest/_SUCCESS"):
        raise IntegrityError(f"{path} is not complete")
    manifest = spark.read.parquet(f"{path}/manifest")
    names = [r["table"] for r in manifest.select("table").distinct().collect()]  # as many as tables
    current = None
    for n in names:
        h = file_hashes(spark, f"{path}/{n}")
        current = h if current is None else current.unionByName(h)
    require_empty(stale(manifest, current), "files changed since the bundle was made")
    return manifest


def read_bundle(spark: SparkSession, path: str, name: str) -> DataFrame:
    verify_bundle(spark, path)
    return spark.read.parquet(f"{path}/{name}")


def copy_table(spark: SparkSession, source: str, destination: str, fmt: str = "parquet") -> None:
    """A snapshot copy; refuses to write over anything."""
    spark.read.format(fmt).load(source).write.mode("errorifexists").format(fmt).save(destination)


def markdown(metrics: DataFrame, title: str) -> str:
    """A metrics table of at most 1,000 rows as Markdown."""
    rows = metrics.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a summary has at most 1,000 rows")
    show = lambda v: "–" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(metrics.columns) + " |", "|" + " --- |" * len(metrics.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"


def guarded(spark: SparkSession, path: str, make) -> str:
    """Run ``make`` (a function that writes to ``path``); on an error remove its output and leave an ``invalid`` status."""
    fs, p = _fs(spark, path)
    try:
        make(path)
        return "final"
    except Exception as e:
        fs.delete(p, True)
        message = f"{type(e).__name__}: {e}"[:2000]
        spark.createDataFrame([("invalid", message)], "status string, message string").write.mode("overwrite").json(f"{path}/status")
        return "invalid"
