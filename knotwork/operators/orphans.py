"""References to records that do not exist at the time of the reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import col


def parent_keys(df: DataFrame, parent: str, key: Sequence[str], created: str | None = None, deleted: str | None = None) -> DataFrame:
    """Long form of a parent table: one opening and, where deleted, one closing event per life.

    A life that ends when or before it begins holds at no time and gives no event; one without a
    creation time holds at no time. Without ``created`` a row holds always.
    """
    start = col(created) if created else F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    end = col(deleted) if deleted else F.lit(None).cast("timestamp_ntz")
    lives = df.select(_key(key).alias("k"), start.cast("timestamp_ntz").alias("s"), end.cast("timestamp_ntz").alias("e"))
    lives = lives.filter("s IS NOT NULL AND (e IS NULL OR e > s)").distinct()
    event = F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d"))))
    events = lives.select("k", event.alias("x")).select(F.lit(parent).alias("parent"), "k", "x.t", "x.d").filter("t IS NOT NULL")
    null = F.lit(None).cast("string")
    return events.select("parent", "k", "t", "d", null.alias("table_name"), null.alias("record_id"), null.alias("field_name"))


def child_keys(df: DataFrame, parent: str, key: Sequence[str], table_name: str, record_id: str, field_name: str, at: str) -> DataFrame:
    """Long form of one reference column; the last part of the key decides whether there is a reference."""
    return df.filter(col(key[-1]).isNotNull()).select(
        F.lit(parent).alias("parent"),
        _key(key).alias("k"),
        col(at).cast("timestamp_ntz").alias("t"),
        F.lit(0).alias("d"),
        F.lit(table_name).alias("table_name"),
        col(record_id).cast("string").alias("record_id"),
        F.lit(field_name).alias("field_name"),
    )


def _key(parts: Sequence[str]) -> Column:
    return F.struct(*(col(p).alias(f"p{i}") for i, p in enumerate(parts)))


def orphans(keys: Sequence[DataFrame], slot: str = "hour") -> DataFrame:
    """Child rows of the long-form ``keys`` whose key has no parent alive at their time.

    Rows are grouped by parent table, key and a slot of time. The net number of opening events in
    earlier slots is the parent flag a slot starts with; inside the slot a running sum adds the
    events up to the row's own time (a parent created at that very time holds, one deleted then
    does not). Rows with the flag at zero are orphans.

    Defined cases: a null in any part of the key but the last matches no parent (nor does a null
    time), so the row is an orphan; a null last part is no reference; repeated rows give repeated
    orphans; an empty parent table makes every reference an orphan.

    The slots split a hot key by time: no task sorts more of a key than one slot of it, and the
    sums per slot combine map-side. Per key the carry window holds one row per slot of the
    calendar.
    """
    events = keys[0]
    for more in keys[1:]:
        events = events.unionByName(more)
    events = events.withColumn("slot", F.date_trunc(slot, "t").cast("timestamp_ntz"))
    whole = F.forall(F.array(*[F.col(f"k.{n}").isNotNull() for n in events.schema["k"].dataType.names]), lambda x: x) & F.col("t").isNotNull()
    children = events.filter("d = 0")
    lost = children.filter(~whole)
    sound = events.filter(whole)
    slots = sound.groupBy("parent", "k", "slot").agg(F.sum("d").alias("net"))
    before = Window.partitionBy("parent", "k").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("parent", "k", "slot", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("carry"))
    upto = Window.partitionBy("parent", "k", "slot").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    alive = (
        sound.join(carried, ["parent", "k", "slot"])
        .withColumn("alive", F.col("carry") + F.sum("d").over(upto))
        .filter("d = 0 AND alive <= 0")
    )
    cols = ["table_name", "record_id", "field_name", "t"]
    return alive.select(*cols).unionByName(lost.select(*cols))


def by_period(found: DataFrame, period: str = "month") -> DataFrame:
    """Orphan counts per referring table, field and period of the reference."""
    when = F.date_trunc(period, "t").cast("timestamp_ntz").alias("period")
    return found.groupBy("table_name", "field_name", when).agg(F.count("*").alias("n_references"), F.countDistinct("record_id").alias("n_records"))
