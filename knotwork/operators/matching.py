"""Joins of predictions, references and evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import measures as M
from knotwork.session import SOURCE_BYTES, col, estimated_bytes, small


def identity_matches(predicted: DataFrame, gold: DataFrame, group: str) -> DataFrame:
    """``pred_id, gold_id, match_type``: equal name key inside a group first, else an alias key.

    ``predicted`` has ``group, pred_id, key``; ``gold`` has ``group, gold_id, key, alias_keys``. Of
    several gold objects of one kind the least id counts.
    """
    p = predicted.select(col(group).alias("g"), "pred_id", "key").filter("key IS NOT NULL")
    by_name = gold.select(col(group).alias("g"), "gold_id", "key", F.lit(0).alias("how"))
    by_alias = gold.select(col(group).alias("g"), "gold_id", F.explode("alias_keys").alias("key"), F.lit(1).alias("how"))
    met = p.join(by_name.unionByName(by_alias), ["g", "key"])
    best = met.groupBy("g", "pred_id").agg(F.min(F.struct("how", "gold_id")).alias("m"))
    return best.select(F.col("g").alias(group), "pred_id", "m.gold_id", F.when(F.col("m.how") == 0, "exact").otherwise("alias").alias("match_type"))


def provenance_mismatches(left: DataFrame, right: DataFrame, key: str, group: str, id_: str) -> DataFrame:
    """Rows of both sides with one key in different groups, each unmatched in its own group: all pairs of a key, by definition.

    :func:`mismatch_classes` has the same links without making the pairs of a common key.
    """
    a = left.select(col(key).alias("key"), col(group).alias("g"), col(id_).alias("a"))
    b = right.select(col(key).alias("key"), col(group).alias("g"), col(id_).alias("b"))
    free_a = a.join(b.select("key", "g").distinct(), ["key", "g"], "left_anti")
    free_b = b.join(a.select("key", "g").distinct(), ["key", "g"], "left_anti").withColumnRenamed("g", "group_b")
    return free_a.withColumnRenamed("g", "group_a").join(free_b, "key").select("key", "a", "group_a", "b", "group_b")


def mismatch_classes(left: DataFrame, right: DataFrame, key: str, group: str, id_: str) -> DataFrame:
    """``key, side, id, group, n_links``: the rows that :func:`provenance_mismatches` would pair, each once with how many rows it meets.

    Rows of one key are one class, each linked to all of the other side; linear in the rows.
    """
    rows = lambda df, s: df.select(col(key).alias("key"), col(group).alias("g"), col(id_).alias("id"), F.lit(s).alias("side")).filter("key IS NOT NULL AND g IS NOT NULL")
    both = rows(left, "left").unionByName(rows(right, "right"))
    inside = both.groupBy("key", "g").agg(F.count_if(F.col("side") == "left").alias("nl"), F.count_if(F.col("side") == "right").alias("nr"))
    free = inside.filter("nl = 0 OR nr = 0")
    sums = free.groupBy("key").agg(F.sum("nl").alias("left_"), F.sum("nr").alias("right_")).filter("left_ > 0 AND right_ > 0")
    met = both.join(free.select("key", "g"), ["key", "g"]).join(sums, "key")
    return met.select("key", "side", "id", F.col("g").alias("group"), F.when(F.col("side") == "left", F.col("right_")).otherwise(F.col("left_")).alias("n_links"))


def members(pairs: DataFrame, ids: Sequence[str], lists: Sequence[str], rows: DataFrame, key: str) -> DataFrame:
    """Rows of every group in the union of a pair's lists."""
    union = F.array_distinct(F.flatten(F.array(*(F.coalesce(col(x), F.array()) for x in lists))))
    return pairs.select(*map(col, ids), F.explode(union).alias(key)).join(rows, key)


#: Partitions over which the needles of one group spread where no side is small enough to broadcast.
SALTS = 16


def contained(needles: DataFrame, texts: DataFrame, group: str, needle: str, text: str) -> DataFrame:
    """Rows of both whose text holds the needle, inside a group.

    A side is broadcast only if its source is small; else needles are spread by a salt and the texts,
    which a group has few of, are sent to each, so that a hot group is many tasks.
    """
    if min(estimated_bytes(texts), estimated_bytes(needles)) <= SOURCE_BYTES:
        met = small(texts).join(small(needles), group)
    else:
        spread = needles.withColumn("salt_", F.pmod(F.xxhash64(col(needle)), F.lit(SALTS)).cast("int"))
        every = texts.withColumn("salt_", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = every.join(spread, [group, "salt_"]).drop("salt_")
    return met.filter((col(needle) != "") & F.contains(col(text), col(needle)))


def with_default(df: DataFrame, decided: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Explicit decision, else the default; ``decided`` tells which."""
    one = decided.select(col(key).alias(key), col(value).alias("d_")).filter("d_ IS NOT NULL").groupBy(key).agg(F.min("d_").alias("d_"))
    joined = df.join(one, key, "left")
    return joined.withColumn(value, F.coalesce("d_", default)).withColumn("decided", F.col("d_").isNotNull()).drop("d_")


def materialized(df: DataFrame, key: str, ids: str, items: DataFrame, item_key: str, value: str, scope: Sequence[str] = ()) -> DataFrame:
    """``key, values``: the ids of an array replaced by their items' values, in order; unknown ids give null.

    ``scope`` are further columns on both sides in which an id is unique. An empty or null array gives none.
    """
    each = df.select(col(key).alias("key_"), *map(col, scope), F.posexplode(col(ids)).alias("at_", "id_"))
    joined = each.join(items.select(*map(col, scope), col(item_key).alias("id_"), col(value).alias("v_")), [*scope, "id_"], "left")
    lists = joined.groupBy("key_").agg(F.array_sort(F.collect_list(F.struct("at_", "v_"))).alias("l_"))
    return lists.select(F.col("key_").alias(key), F.transform("l_", lambda x: x["v_"]).alias("values"))


def composite(df: DataFrame, refs: str, items: DataFrame, on: Sequence[str], key: str, value: str) -> DataFrame:
    """Array of composite references looked up one by one: ``key, at, *on, value``; unknown ones give null."""
    each = df.select(col(key).alias("key_"), F.posexplode(col(refs)).alias("at", "r_")).select("key_", "at", *(F.col(f"r_.{c}").alias(c) for c in on))
    return each.join(items.select(*map(col, on), col(value)), list(on), "left").withColumnRenamed("key_", key)


def unordered_join(a: DataFrame, b: DataFrame, left: tuple[str, str], right: tuple[str, str], how: str = "left") -> DataFrame:
    """Join on both ends in either order; a row of which one end is null meets nothing."""
    keyed = lambda df, pair: df.withColumns(dict(zip(("x_", "y_"), M.ends(*map(col, pair)), strict=True)))
    ka, kb = keyed(a, left), keyed(b, right).drop(*right)
    return ka.join(kb, ["x_", "y_"], how).drop("x_", "y_")


def recoverable(pairs: DataFrame, alignment: DataFrame, key: str, ends: tuple[str, str]) -> DataFrame:
    """Whether both ends of a pair have a counterpart, and why not.

    ``alignment`` has ``ref, status, counterpart``; an end without a row is ``unaligned``.
    """
    side = lambda n: alignment.select(F.col("ref").alias(ends[n]), F.col("status").alias(f"s{n}_"), F.col("counterpart").alias(f"counterpart_{n}"))
    joined = pairs.join(side(0), ends[0], "left").join(side(1), ends[1], "left")
    why = lambda n: F.when(F.col(f"counterpart_{n}").isNull(), F.coalesce(f"s{n}_", F.lit("unaligned")))
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.array(why(0), why(1)))))
    both = F.concat(reasons, F.when(F.col("counterpart_0") == F.col("counterpart_1"), F.array(F.lit("ends_merged"))).otherwise(F.array().cast("array<string>")))
    return joined.withColumn("reasons", both).withColumn("recoverable", F.size("reasons") == 0).drop("s0_", "s1_")


def slots(pairs: DataFrame, key: str, ends: Sequence[str]) -> DataFrame:
    """``ref, slot, pair``: each referenced end numbered in order, a row per pair that refers to it; a hot end is many rows, not one."""
    from knotwork.operators.pairs import numbered

    refs = pairs.select(col(key).alias("pair"), F.explode(F.array(*map(col, ends))).alias("ref")).filter("ref IS NOT NULL").distinct()
    slot = numbered(refs.select("ref").distinct(), ["ref"]).select("ref", M.sequence_id("ko_slot", F.col("no")).alias("slot"))
    return refs.join(slot, "ref").select("ref", "slot", "pair")


def fanned_out(slot_flags: DataFrame, flag: str) -> DataFrame:
    """A slot's flag given to every pair that refers to it: ``pair, flags``; a pair has two ends, so its flags are few."""
    each = slot_flags.filter(col(flag).isNotNull()).select("pair", col(flag).alias("f_"))
    return each.groupBy("pair").agg(F.array_sort(F.collect_set("f_")).alias("flags"))


def first_hits(hits: DataFrame, group: Sequence[str], order: str, out: str = "duplicate") -> DataFrame:
    """Marks every hit on a target after the first, in order; ``order`` is unique in a group, so the first is a minimum that combines map-side."""
    first = hits.groupBy(*(col(g).alias(f"g{i}_") for i, g in enumerate(group))).agg(F.min(col(order)).alias("first_"))
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & F.col(f"g{i}_").eqNullSafe(col(g))
    return hits.join(first, on, "left").withColumn(out, ~col(order).eqNullSafe(F.col("first_"))).drop("first_", *(f"g{i}_" for i in range(len(group))))
