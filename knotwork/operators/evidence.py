"""Evidence blocks, catalogs and minimal windows that cover both ends of a pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import text as X
from knotwork.functions.measures import sequence_id
from knotwork.session import col


def block_rows(lectures: DataFrame, key: str, text: str, blocks=X.blocks) -> DataFrame:
    """``key, block_index, span``: the blocks of each text with their position; a repeated key counts once."""
    one = lectures.select(col(key).alias(key), col(text).alias("t_")).filter("t_ IS NOT NULL").groupBy(key).agg(F.max("t_").alias("t_"))
    return one.select(key, F.posexplode(blocks(F.col("t_"))).alias("block_index", "span"))


def catalog(pair_lectures: DataFrame, blocks: DataFrame, pair: str, lecture: str) -> DataFrame:
    """Evidence ids restart per pair, in order of lecture and block."""
    rows = pair_lectures.select(col(pair).alias(pair), col(lecture).alias(lecture)).distinct().join(blocks, lecture)
    number = F.row_number().over(Window.partitionBy(pair).orderBy(lecture, "block_index"))
    return rows.withColumn("evidence_id", sequence_id("evidence", number))


def minimal_windows(covered: DataFrame, pair: str, group: str, index: str, a: str, b: str, most: int = 3) -> DataFrame:
    """``pair, group, start, end``: runs of at most ``most`` consecutive blocks that show both ends, and hold no smaller such run.

    ``covered`` has one row per block with two booleans. A gap in the indices ends a run. Ranges are
    found by frames over the block index; a window that strictly holds another is dropped by
    looking at the shorter windows that begin no earlier and end no later, in the same row set.
    """
    one = covered.groupBy(col(pair).alias("p"), col(group).alias("g"), col(index).alias("i")).agg(F.max(F.coalesce(col(a), F.lit(False))).alias("a"), F.max(F.coalesce(col(b), F.lit(False))).alias("b"))

    def ends_at(k: int) -> Column:
        w = Window.partitionBy("p", "g").orderBy("i").rangeBetween(0, k - 1)
        return (F.count("*").over(w) == k) & F.max("a").over(w) & F.max("b").over(w)

    shown = one.select("p", "g", "i", *(ends_at(k).alias(f"k{k}") for k in range(1, most + 1)))
    # least run length from each start; a run is minimal if no later start within it ends as early
    least = reduce(lambda acc, k: F.when(F.col(f"k{k}"), F.lit(k)).otherwise(acc), range(most, 0, -1), F.lit(None).cast("int"))
    starts = shown.select("p", "g", "i", least.alias("k")).filter("k IS NOT NULL").withColumn("e", F.col("i") + F.col("k") - 1)
    later = Window.partitionBy("p", "g").orderBy("i").rangeBetween(1, most)
    kept = starts.withColumn("next", F.min("e").over(later)).filter("next IS NULL OR next > e")
    return kept.select(F.col("p").alias(pair), F.col("g").alias(group), F.col("i").alias("start"), F.col("e").alias("end"))


def window_ids(windows: DataFrame, catalog_: DataFrame, pair: str, group: str) -> DataFrame:
    """Windows with their evidence ids and a stable id made of pair, lecture and evidence ids."""
    c = catalog_.select(col(pair).alias(pair), col(group).alias(group), "block_index", "evidence_id")
    rows = windows.join(c, [pair, group]).filter("block_index BETWEEN start AND end")
    g = rows.groupBy(pair, group, "start", "end").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))
    body = F.to_json(F.array(F.col(pair), F.col(group), F.array_join("evidence_ids", ",")))
    return g.withColumn("window_id", F.concat(F.lit("window_"), F.substring(F.sha2(body, 256), 1, 16)))
