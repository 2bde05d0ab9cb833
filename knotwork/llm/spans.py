"""Long exact spans shared between records, found by content-defined chunks.

The windows of ``length`` characters that begin at each position of a text are cut into chunks of
consecutive windows. The cut is made by content: a gear rolling hash over ``context`` characters
is taken at every place inside the window, and windows that have their least hash at the same
place, the anchor, form one chunk. An insertion or another neighbourhood moves no cut more than a
window away. Chunks vary in length and are deduplicated by digest:

* a chunk whose digest occurs in several records is shared with all its windows;
* a chunk whose anchor occurs in no other record shares no window, as equal windows have equal
  anchors;
* what remains are the ends of shared spans and chance: there the windows themselves are hashed
  and deduplicated.

A character is shared if it lies in a shared window, so the result is exact, up to the collision
of 128 bits (anchor and digest, or anchor and window, each 64).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import BROADCAST_BYTES, discard, written

CHUNKS = "anchor long, digest long, id long, lo int, n int"
#: Code points that a worker holds at a time; longer texts are taken in overlapping slices.
SLICE = 500_000
#: Distinct chunks of one anchor that are compared inside a task; more go through a shuffle by window.
TOGETHER = 64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gear(random: np.ndarray, context: int) -> np.ndarray:
    """The rolling hash h[i] = sum of random[i-j] << j over the last ``context`` (a power of two, at most 64) places, by doubling."""
    h, width = random, 1
    while width < context:
        moved = h.copy()
        moved[width:] += h[:-width] << np.uint64(width)
        h, width = moved, 2 * width
    return h


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value among ``width`` from each place on, the last of equal ones."""
    value, place, have = h, np.arange(len(h)), 1

    def joined(value: np.ndarray, place: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(value) - by
        later = value[by:] <= value[:n]
        return np.where(later, value[by:], value[:n]), np.where(later, place[by:], place[:n])

    while 2 * have <= width:
        value, place = joined(value, place, have)
        have *= 2
    return joined(value, place, width - have)[1] if width > have else place


class Prefix:
    """Hashes of substrings: sums of random[j] * base**j modulo 2**64, moved to place 0."""

    def __init__(self, most: int):
        with np.errstate(over="ignore"):
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(most, _BASE, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(most, pow(_BASE, -1, 1 << 64), np.uint64))])

    def over(self, random: np.ndarray) -> np.ndarray:
        return np.concatenate([[np.uint64(0)], np.cumsum(random * self.up[: len(random)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def chunk_rows(pieces: list[tuple[int, int, str]], length: int, context: int, prefix: Prefix) -> tuple[np.ndarray, ...]:
    """Chunks of some texts or slices ``(id, offset, text)``, all at once: anchor, digest, id, first window, windows."""
    random = mix(code_points("".join(t for _, _, t in pieces)).astype(np.uint64))
    sizes = np.array([len(t) for _, _, t in pieces])
    ends = np.repeat(np.cumsum(sizes), sizes)
    h = gear(random, context)
    place = least(h[context - 1 :], length - context + 1) + context - 1
    starts = np.flatnonzero(np.arange(len(place)) + length <= ends[: len(place)])
    anchor = place[starts]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    lo, n, anchor = starts[new], np.diff(np.append(new, len(starts))), anchor[new]
    text = prefix.of(prefix.over(random), lo, lo + n - 1 + length)
    digest = mix(text ^ mix((anchor - lo).astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64)))
    which = np.repeat(np.arange(len(pieces)), sizes)[lo]
    begins = np.cumsum(sizes) - sizes
    ids = np.array([i for i, _, _ in pieces])[which]
    offset = np.array([o for _, o, _ in pieces])[which]
    return mix(h[anchor]).view(np.int64), digest.view(np.int64), ids, (lo - begins[which] + offset).astype(np.int32), n.astype(np.int32)


def chunks(df: DataFrame, key: str, text: str, length: int, context: int) -> DataFrame:
    """The content-defined chunks of all texts; texts under ``length`` characters have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = Prefix(2 * SLICE + length)
        held: list[tuple[int, int, str]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            with np.errstate(over="ignore"):
                made = chunk_rows(held, length, context, prefix)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["anchor", "digest", "id", "lo", "n"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                t = t.as_py()
                if t is None or len(t) < length:
                    continue
                for offset in range(0, len(t) - length + 1, SLICE):
                    piece = t[offset : offset + SLICE + length - 1]
                    held.append((i.as_py(), offset, piece))
                    size += len(piece)
                    if size >= SLICE:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long"), text).mapInArrow(run, CHUNKS)


def window_hashes(df: DataFrame, text: str, length: int) -> DataFrame:
    """``anchor, digest, first, last, hashes``: the hash of each window of the chunks in the array column ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = Prefix(4 * length)
        for b in batches:
            for t, wanted in zip(b.column(0), b.column(1), strict=True):
                t, wanted = t.as_py(), wanted.as_py()
                hashes = []
                with np.errstate(over="ignore"):
                    for w in wanted:
                        piece = t[w["lo"] : w["lo"] + w["n"] - 1 + length] if t is not None else ""
                        random = mix(code_points(piece).astype(np.uint64))
                        at = np.arange(max(0, len(piece) - length + 1))
                        hashes.append(mix(prefix.of(prefix.over(random), at, at + length)).view(np.int64))
                cols = [pa.array([w[c] for w in wanted], pa.int64()) for c in ("anchor", "digest", "first", "last")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(hashes, pa.list_(pa.int64()))], ["anchor", "digest", "first", "last", "hashes"])

    return df.select(text, "wanted").mapInArrow(run, "anchor long, digest long, first long, last long, hashes array<long>")


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true flags as (first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def compared_together(df: DataFrame) -> DataFrame:
    """Shared windows of anchors with few distinct chunks, which are compared inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for anchor, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sizes = [len(m["hashes"]) for m in members]
                value, back = np.unique(np.concatenate([np.array(m["hashes"], np.int64) for m in members]), return_inverse=True)
                first, last = np.full(len(value), np.iinfo(np.int64).max), np.full(len(value), np.iinfo(np.int64).min)
                np.minimum.at(first, back, np.repeat([m["first"] for m in members], sizes))
                np.maximum.at(last, back, np.repeat([m["last"] for m in members], sizes))
                flags = np.split((first < last)[back], np.cumsum(sizes)[:-1])
                out += [(anchor, m["digest"], a, z) for m, f in zip(members, flags, strict=True) for a, z in ranges(f)]
            cols = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["anchor", "digest", "a", "z"])

    return df.mapInArrow(run, "anchor long, digest long, a int, z int")


def shared_spans(df: DataFrame, key: str, text: str, length: int = 160, context: int = 64, together: int = TOGETHER) -> DataFrame:
    """``id, span_start, span_end``: the maximal runs of shared characters of each record.

    A character (code point) is shared if it lies in a run of at least ``length`` characters that
    occurs verbatim in a record with another key. Null and short texts share nothing; repeats inside
    one record, or of a row under one key, are not shared by themselves; rows with a null key are
    left out. ``key`` is a long, and rows of one key hold one text; other columns are not read.

    Nothing is compared pair by pair across tasks: anchors, digests and windows are grouped with
    partial aggregates of first and last key, so a chunk in a third of all records costs one row
    per task. A join's smaller side is broadcast only if its rows were counted and fit.
    """
    if length < context or context not in (2, 4, 8, 16, 32, 64):
        raise ValueError("context must be a power of two up to 64, at most length")
    every = written(chunks(df, key, text, length, context), "chunks")
    met = every.groupBy("anchor").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y").select("anchor")
    met, counted = _counted(met, "anchors", 8)
    common = written(every.join(met if not counted else F.broadcast(met), "anchor"), "common")
    discard(every)
    discard(met)
    kinds = common.groupBy("anchor", "digest").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.min(F.struct("id", "lo", "n")).alias("at")
    )
    alone = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    kinds = written(kinds.join(alone, "anchor"), "kinds")
    whole = kinds.filter("first < last").select("anchor", "digest", F.lit(0).alias("a"), (F.col("at.n") - 1).alias("z"))
    unsure = kinds.filter("kinds > 1")
    wanted = unsure.select(F.col("at.id").alias("id_"), F.struct("anchor", "digest", "first", "last", F.col("at.lo").alias("lo"), F.col("at.n").alias("n"), "kinds").alias("w"))
    wanted, counted = _counted(wanted.groupBy("id_").agg(F.collect_list("w").alias("wanted")), "wanted", 8 + 4 * 52)
    texts = df.select(F.col(key).cast("long").alias("id_"), F.col(text).alias("text_"))
    if not counted and wanted.count() * 8 <= BROADCAST_BYTES:
        texts = texts.join(F.broadcast(wanted.select("id_")), "id_", "left_semi")  # only the texts that are needed move
    texts = texts.join(wanted if not counted else F.broadcast(wanted), "id_")
    hashed = written(window_hashes(texts.dropDuplicates(["id_"]) if not counted else texts, "text_", length), "windows")
    discard(wanted)
    sizes = hashed.groupBy("anchor").agg(F.count("*").alias("kinds"))
    hashed = hashed.dropDuplicates(["anchor", "digest"]).join(sizes, "anchor")
    member = F.struct("digest", "first", "last", "hashes")
    few = hashed.filter(F.col("kinds") <= together).groupBy("anchor").agg(F.collect_list(member).alias("members"))
    many = hashed.filter(F.col("kinds") > together).select("anchor", "digest", "first", "last", F.posexplode("hashes").alias("at", "window"))
    again = many.groupBy("anchor", "window").agg(F.min("first").alias("x"), F.max("last").alias("y")).filter("x < y").select("anchor", "window")
    singly = many.join(again, ["anchor", "window"]).select("anchor", "digest", F.col("at").alias("a"), F.col("at").alias("z"))
    parts = compared_together(few).unionByName(singly)
    found = common.join(whole.unionByName(parts), ["anchor", "digest"])
    spans = found.select("id", (F.col("lo") + F.col("a")).alias("s"), (F.col("lo") + F.col("z") + length).alias("e"))
    return islands(spans)


def _counted(df: DataFrame, name: str, row_bytes: int) -> tuple[DataFrame, bool]:
    """The table, written, and whether its rows were counted to fit a broadcast."""
    df = written(df, name)
    return df, df.count() * row_bytes <= BROADCAST_BYTES


def islands(spans: DataFrame) -> DataFrame:
    """Overlapping and touching intervals of each record, joined. A record's own intervals bound the sort."""
    before = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new: Column = F.coalesce((F.col("s") > F.max("e").over(before)).cast("int"), F.lit(1))
    numbered = spans.distinct().withColumn("new", new).withColumn("island", F.sum("new").over(upto))
    joined = numbered.groupBy("id", "island").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end"))
    return joined.select("id", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))
