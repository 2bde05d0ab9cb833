"""Integrity: bijections, set algebra with verdicts, constraint reports, gates, manifests."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.session import col


class IntegrityError(ValueError):
    """A constraint that must hold does not."""


def bijection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, problem`` for keys that are missing, extra, null or repeated on either side."""
    a = left.groupBy(col(key).alias("key")).agg(F.count("*").alias("n_left"))
    b = right.groupBy(col(key).alias("key")).agg(F.count("*").alias("n_right"))
    both = a.join(b, a["key"].eqNullSafe(b["key"]), "full").select(F.coalesce(a["key"], b["key"]).alias("key"), "n_left", "n_right")
    problems = F.array_compact(F.array(
        F.when(F.col("key").isNull(), F.lit("null_key")), F.when(F.col("n_left").isNull(), F.lit("missing")), F.when(F.col("n_right").isNull(), F.lit("extra")),
        F.when(F.col("n_left") > 1, F.lit("repeated_left")), F.when(F.col("n_right") > 1, F.lit("repeated_right")),
    ))
    return both.select("key", F.explode(problems).alias("problem"))


def require_empty(problems: DataFrame, what: str, shown: int = 5) -> None:
    """Raise with a few examples if there is a row."""
    rows = problems.take(shown)
    if rows:
        raise IntegrityError(f"{what}: {[tuple(r) for r in rows]}")


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same rows as sets, and how many are on one side only."""
    tagged = a.distinct().withColumn("side_", F.lit(1)).unionByName(b.distinct().withColumn("side_", F.lit(-1)))
    net = tagged.groupBy(*[f"`{c}`" for c in a.columns]).agg(F.sum("side_").alias("net_"))
    only = net.agg(F.count_if(F.col("net_") > 0).alias("only_left"), F.count_if(F.col("net_") < 0).alias("only_right"))
    return only.select(((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"), "only_left", "only_right")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*map(col, keys)).agg(F.count("*").alias("n")).filter("n > 1")


def violations(df: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """``key, violation``: a row for every check that fails; a check that is null counts as failed."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items())))
    return df.select(col(key).alias("key"), F.explode(failed).alias("violation"))


def violation_report(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``violation, n_rows`` for every check, zero included, in one pass."""
    n = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("violation"), F.col(name).alias("n_rows")) for name in checks))
    return n.select(F.explode(pairs).alias("x")).select("x.*")


def split_valid(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined ones with the names of the checks they failed."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items())))
    marked = df.withColumn("failed_checks", failed)
    return marked.filter(F.size("failed_checks") == 0).drop("failed_checks"), marked.filter(F.size("failed_checks") > 0)


def missing_parents(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, row: str) -> DataFrame:
    """Rows whose non-null key no parent has."""
    keys = parent.select(col(parent_key).alias("k_")).distinct()
    return child.select(col(row).alias("key"), col(child_key).alias("k_")).filter("k_ IS NOT NULL").join(keys, "k_", "left_anti").select("key", F.col("k_").alias("missing"))


def field_names(kind: T.DataType, path: str = "") -> set[str]:
    """All field names at any depth of a schema."""
    if isinstance(kind, T.StructType):
        return {n for f in kind.fields for n in {f.name} | field_names(f.dataType)}
    if isinstance(kind, T.ArrayType):
        return field_names(kind.elementType)
    return field_names(kind.keyType) | field_names(kind.valueType) if isinstance(kind, T.MapType) else set()


def require_no_leak(df: DataFrame, forbidden: Collection[str]) -> DataFrame:
    """The table, unless its schema holds a forbidden name at any depth; no job runs."""
    leaked = field_names(df.schema) & set(forbidden)
    if leaked:
        raise IntegrityError(f"fields that must not be visible: {sorted(leaked)}")
    return df


def require_keys(df: DataFrame, expected: Collection[str]) -> DataFrame:
    """The table, unless its columns are not exactly the expected ones."""
    if set(df.columns) != set(expected):
        raise IntegrityError(f"missing {sorted(set(expected) - set(df.columns))}, unknown {sorted(set(df.columns) - set(expected))}")
    return df


#: Comparison operators of gates.
OPERATORS = {">=": lambda v, t: v >= t, "<=": lambda v, t: v <= t, "==": lambda v, t: v == t, ">": lambda v, t: v > t, "<": lambda v, t: v < t}


def gates(metrics: DataFrame, thresholds: Sequence[tuple[str, str, float]]) -> DataFrame:
    """``metric, value, operator, threshold, passed`` of a one-row metrics table; null fails."""
    rows = F.array(*(
        F.struct(F.lit(m).alias("metric"), col(m).cast("double").alias("value"), F.lit(op).alias("operator"), F.lit(float(t)).alias("threshold"), F.coalesce(OPERATORS[op](col(m), F.lit(t)), F.lit(False)).alias("passed"))
        for m, op, t in thresholds
    ))
    return metrics.select(F.explode(rows).alias("g")).select("g.*")


def all_passed(gate_table: DataFrame) -> DataFrame:
    return gate_table.agg(F.coalesce(F.every("passed"), F.lit(True)).alias("passed"), F.count_if(~F.col("passed")).alias("n_failed"))


def content_hash(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """``*groups, n_rows, digest``: an order-free fingerprint of the rows, for snapshots.

    Each row's SHA-256 gives two 60-bit numbers, which are summed as decimals; sums combine
    map-side, so no task sees a whole group. Equal rows in equal numbers give equal digests.
    """
    row = F.sha2(F.to_json(F.struct(*map(col, columns)), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(20,0)"))
    digest = F.concat_ws("-", part(1).cast("string"), part(16).cast("string"))
    return df.groupBy(*map(col, groups)).agg(F.count("*").alias("n_rows"), digest.alias("digest"))


def stale(bindings: DataFrame, current: DataFrame) -> DataFrame:
    """Bindings ``path, sha256`` that no current file meets."""
    return bindings.select("path", "sha256").join(current.select("path", "sha256"), ["path", "sha256"], "left_anti")
