"""Ratios, hashes and small expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n/d, null where d is 0 or either is null."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def ratio_struct(n: Column, d: Column) -> Column:
    return F.struct(n.cast("long").alias("numerator"), d.cast("long").alias("denominator"), ratio(n, d).alias("value"))


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean, null where undefined."""
    return F.try_divide(2 * p * r, p + r)


def first_true(cases: Mapping[str, Column], otherwise: str | None = None) -> Column:
    """The name of the first condition that holds."""
    names = iter(cases.items())
    name, condition = next(names)
    out = F.when(condition, F.lit(name))
    for name, condition in names:
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def all_true(cases: Mapping[str, Column]) -> Column:
    """The names of all conditions that hold, in the given order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in cases.items())))


def unordered(a: Column, b: Column) -> Column:
    """One key for both orders of two ends."""
    return F.array_sort(F.array(a, b))


def same_edge(source: Column, target: Column, kind: Column, gold_source: Column, gold_target: Column, gold_kind: Column, symmetric: Column) -> Column:
    """Equal type and equal ends, in either order where ``symmetric``; false where anything is null."""
    directed = (source == gold_source) & (target == gold_target)
    reverse = (source == gold_target) & (target == gold_source)
    return F.coalesce((kind == gold_kind) & (directed | (symmetric & reverse)), F.lit(False))


def short_hash(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def ends(a: Column, b: Column) -> tuple[Column, Column]:
    """Both ends in order, null where either is null: a pair of which one end is unknown is no pair."""
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, F.least(a, b)), F.when(known, F.greatest(a, b))


def pair_id(prefix: str, a: Column, b: Column, salt: str = "connection_pair_v0.1") -> Column:
    """A stable id of an unordered pair, null where either end is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit(prefix), short_hash(F.lit(salt), F.least(a, b), F.greatest(a, b))))


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """JSON with sorted keys, no spaces, nulls kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def cluster_id(kind: Column, key: Column, members: Column, prefix: str = "ko_cluster_") -> Column:
    body = canonical_json({"identity_key": key, "mention_ids": F.array_sort(members), "type": kind})
    return F.concat(F.lit(prefix), F.substring(F.sha2(body, 256), 1, 16))


def sequence_id(prefix: str, number: Column, width: int = 3) -> Column:
    return F.format_string(f"{prefix}_%0{width}d", number)


def evidence_set(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(spans))


def evidence_multiset(spans: Column) -> Column:
    return F.array_sort(spans)


def ref_label(lecture: Column, ko: Column) -> Column:
    """A composite reference as one text, null where a part is null."""
    return F.concat(lecture, F.lit("::"), ko)


def matches_whole(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def within(x: Column, low: float, high: float) -> Column:
    return F.coalesce(x.between(low, high), F.lit(False))


def min_distance(a: Column, b: Column) -> Column:
    """Least difference of two arrays of positions; null where either is empty."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y)))))


def multi(rows: Sequence[Column]) -> Column:
    """Explode of the rows that are not null."""
    return F.explode(F.array_compact(F.array(*rows)))
