"""Many tiny files into few: size-tiered incremental compaction with a transaction journal.

A store is a folder of generations. A generation that takes files in merges them level by level:
level 1 merges the tiny files that a task reads into segments of like-sized files, without a shuffle;
each level above merges about ``fan_in`` segments of one size class; the last merge gives each record
to one file of the target size, and makes a run. Runs are merged in turn once ``fan_in`` of one size
class exist, so taking in a small amount writes a small amount, and a record is written again only as
often as its size class grows. Every merge has a journal entry with its inputs and outputs. The
journal is written last: it commits the generation, and what was cut off before is written again.
Files in the journal are never taken again.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.records import CONTRACTS, Contract, record_texts, reject_of
from knotwork.session import exists, listed, remove

#: Segments of the first level are at least about this large.
SMALLEST = 1 << 16
#: A segment is closed at so many inputs, so that files without content close it too.
MOST_INPUTS = 10_000
RECORD = "feed string, record_id string, modified_at timestamp_ntz, file_id long, n_files long, record string, n_bytes long"
SEGMENT = f"kind string, segment_id string, segment_bytes long, {RECORD}, inputs array<string>, n_records long"
JOURNAL = "level int, kind string, output string, feed string, inputs array<string>, n_inputs long, n_outputs long, n_records long, n_bytes long"
_TYPES = pa.schema([
    ("kind", pa.string()), ("segment_id", pa.string()), ("segment_bytes", pa.int64()), ("feed", pa.string()), ("record_id", pa.string()),
    ("modified_at", pa.timestamp("us")), ("file_id", pa.int64()), ("n_files", pa.int64()), ("record", pa.string()), ("n_bytes", pa.int64()),
    ("inputs", pa.list_(pa.string())), ("n_records", pa.int64()),
])
_RECORD = [f.split()[0] for f in RECORD.split(", ")]


def tier(n_bytes: int, fan_in: int) -> int:
    """The size class of a file: files of a class differ in size by less than the fan-in."""
    return int(math.log(max(n_bytes, 1), fan_in))


def merge_tiny(files: DataFrame, goal_bytes: int, fan_in: int, contracts: Mapping[str, Contract] = CONTRACTS) -> DataFrame:
    """Level 1: each task merges the tiny files it reads into segments of about ``goal_bytes``, without a shuffle.

    Files of one feed and size class share an open segment, in which a record is kept once: the text
    of its latest copy, byte for byte, with the number of files that held it. Rows of kind ``record``
    are records, rows of kind ``txn`` journal entries. Files are parsed strictly; those that hold no
    records are inputs of a segment too, so that the journal accounts for every file.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # (feed, tier) -> [bytes, input ids, {record_id: [order, n_files, text]}]

        def close(which: tuple) -> pa.RecordBatch:
            _, inputs, records = held.pop(which)
            name = "seg_" + hashlib.sha256(json.dumps([which[0], sorted(inputs)]).encode()).hexdigest()[:24]
            sizes = {r: len(text.encode("utf-8", "replace")) for r, (_, _, text) in records.items()}
            total = sum(sizes.values())
            rows = [("record", name, total, which[0], r, o[0], o[1], n, text, sizes[r], None, None) for r, (o, n, text) in records.items()]
            rows.append(("txn", name, total, which[0], None, None, None, None, None, total, [str(i) for i in sorted(inputs)], len(records)))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _TYPES.types, strict=True)], schema=_TYPES)

        for b in batches:
            for feed, file_id, modified, n_bytes, content in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                size = n_bytes or len(content or "")
                which = (feed, tier(size, fan_in))
                at = held.setdefault(which, [0, [], {}])
                at[0] += size
                at[1].append(file_id)
                order, counted = (modified, file_id), set()
                for rid, text in record_texts(content, contracts.get(feed)):
                    old = at[2].setdefault(rid, [None, 0, None])
                    old[1] += rid not in counted
                    counted.add(rid)
                    if old[0] is None or _before(old[0], order):
                        old[0], old[2] = order, text
                if at[0] >= goal_bytes or len(at[1]) >= MOST_INPUTS:
                    yield close(which)
        for which in sorted(held, key=str):
            yield close(which)

    cols = ["feed", "file_id", F.col("modified_at").cast("timestamp_ntz").alias("modified_at"), "n_bytes", "content"]
    return files.select(*cols).mapInArrow(merge, SEGMENT)


def _before(a: tuple, b: tuple) -> bool:
    """Order of copies: null times first, then time, then file id; equal ones keep the first."""
    return (a[0] is not None, a[0] or b[0], a[1]) < (b[0] is not None, b[0] or a[0], b[1])


def latest_copies(records: DataFrame, by: list[str]) -> DataFrame:
    """One row per key: its latest copy, and how many files held it."""
    last = F.max(F.struct("modified_at", "file_id", "record", "n_bytes")).alias("l")
    whole = records.groupBy(*by).agg(last, F.sum("n_files").alias("n_files"))
    return whole.select(*by, "l.modified_at", "l.file_id", "n_files", "l.record", "l.n_bytes")


def placements(entries: DataFrame, goal_bytes: int, fan_in: int) -> DataFrame:
    """``feed, tier, groups, share``: into how many segments of about the goal each size class is merged.

    As many rows as feeds and size classes: the logarithm of the sizes.
    """
    by = entries.groupBy("feed", _tier(fan_in)).agg(F.sum("n_bytes").alias("b"))
    by = by.withColumn("groups", F.greatest(F.lit(1), F.ceil(F.col("b") / F.lit(goal_bytes))).cast("long"))
    return by.select("feed", "tier", "groups", F.ceil(F.col("b") / F.col("groups")).cast("long").alias("share"))


def _tier(fan_in: int, size: str = "n_bytes"):
    return F.floor(F.log(float(fan_in), F.greatest(F.col(size), F.lit(1)).cast("double"))).alias("tier")


def merge_segments(level: DataFrame, entries: DataFrame, goal_bytes: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """Level k to k+1, ``(records, entries)``: segments of one size class merge in groups of about ``fan_in``.

    A segment's group is a hash of its name among as many as the class needs, so records find theirs
    without a join on segments; they move once, by group and record, and a record that several
    segments of a group hold leaves it once. ``entries`` have ``segment_id, feed, n_bytes``, those
    returned name their input segments.
    """
    groups = F.broadcast(placements(entries, goal_bytes, fan_in))
    into = F.concat_ws("_", F.lit("seg"), "feed", F.col("tier").cast("string"), F.pmod(F.xxhash64("segment_id"), F.col("groups")).cast("string")).alias("into")
    records = level.withColumn("tier", _tier(fan_in, "segment_bytes")).join(groups, ["feed", "tier"]).select(into, "share", *_RECORD)
    merged = latest_copies(records, ["into", "share", "feed", "record_id"]).withColumnsRenamed({"into": "segment_id", "share": "segment_bytes"})
    placed = entries.withColumn("tier", _tier(fan_in)).join(groups, ["feed", "tier"]).select(into, "feed", "segment_id", "share")
    made = placed.groupBy("into", "feed", "share").agg(F.collect_list("segment_id").alias("inputs"), F.count("*").alias("n_inputs"))
    return merged, made.withColumnsRenamed({"into": "segment_id", "share": "n_bytes"})


def once(files: DataFrame) -> DataFrame:
    """Each file once. Only ids are shuffled to see whether any repeats; contents move only if one does.

    A file without an id gets one from its path and content.
    """
    named = files.withColumn("file_id", F.coalesce("file_id", -F.abs(F.xxhash64("file_path", "content"))))
    if named.groupBy("file_id").count().filter("count > 1").isEmpty():
        return named
    row = F.max(F.struct("modified_at", "feed", "n_bytes", "content", "file_path"))
    return named.groupBy("file_id").agg(row.alias("r")).select("file_id", "r.*")


def rejected(files: DataFrame, contracts: Mapping[str, Contract] = CONTRACTS) -> DataFrame:
    """``file_id, feed, reason`` of the files that hold no record: ``unknown_feed``, ``empty`` (or null), ``not_json`` or ``no_record``."""
    known = dict(contracts)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, f, r) for i, f, c in zip(*(b.column(n).to_pylist() for n in range(3)), strict=True) if (r := reject_of(c, known.get(f)))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], ["file_id", "feed", "reason"])

    return files.select("file_id", "feed", "content").mapInArrow(check, "file_id long, feed string, reason string")


class Store:
    """A compacted store in ``path``; :meth:`add` takes files in, each at most once."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 16, contracts: Mapping[str, Contract] = CONTRACTS):
        self.spark, self.path, self.target, self.fan_in, self.contracts = spark, path.rstrip("/"), target_bytes, fan_in, contracts

    def _generations(self) -> list[int]:
        """Complete generations: those whose journal is there."""
        names = listed(self.spark, self.path)
        return sorted(int(n.removeprefix("gen=")) for n in names if n.startswith("gen=") and exists(self.spark, f"{self.path}/{n}/journal/_SUCCESS"))

    def _read(self, gen: int, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/gen={gen}/{part}")

    def journal(self) -> DataFrame:
        """Every merge: generation, level, kind (what was merged: ``files``, ``segments`` or ``runs``), outputs, inputs and counts."""
        gens = self._generations()
        each = [self._read(g, "journal", JOURNAL).withColumn("generation", F.lit(g)) for g in gens]
        return reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], f"{JOURNAL}, generation int")

    def taken(self) -> DataFrame:
        """The ids of all files that some merge has as inputs."""
        return self.journal().filter("kind = 'files'").select(F.explode(F.col("inputs").cast("array<bigint>")).alias("file_id")).distinct()

    def runs(self) -> dict[int, tuple[int, int]]:
        """Generation -> bytes and files of each run that no later run has taken in. As many rows as generations reach the driver."""
        last = self.journal().filter("n_outputs IS NOT NULL AND kind <> 'files' AND output LIKE 'run=%'")
        rows = last.groupBy("generation").agg(F.sum("n_bytes").alias("b"), F.max("n_outputs").alias("f"), F.flatten(F.collect_set(F.when(F.col("kind") == "runs", F.col("inputs")))).alias("i")).collect()
        dead = {i for r in rows for i in r.i}
        return {r.generation: (r.b, r.f) for r in rows if f"run={r.generation}" not in dead}

    def base(self) -> DataFrame:
        """The records: each identifier once per feed, its latest copy, the number of files that held it."""
        live = [self._read(g, "run", RECORD) for g in self.runs()]
        if not live:
            return self.spark.createDataFrame([], RECORD)
        return live[0] if len(live) == 1 else latest_copies(reduce(DataFrame.unionByName, live), ["feed", "record_id"]).select(*_RECORD)

    def add(self, files: DataFrame) -> int:
        """Take in the files that no merge has yet; returns the number of the newest generation.

        A file delivered twice (same file_id) counts once. Adding the same files again changes
        nothing. Only the new files' records are written, and older runs where a size class is full.
        """
        gens = self._generations()
        fresh = files
        if gens:
            fresh = files.join(self.taken(), "file_id", "left_anti")
            if fresh.isEmpty():
                return gens[-1]
        gen = gens[-1] + 1 if gens else 0
        at = f"{self.path}/gen={gen}"
        goal = self.target
        while goal // self.fan_in >= SMALLEST:
            goal //= self.fan_in
        self._write(merge_tiny(once(fresh), goal, self.fan_in, self.contracts), f"{at}/level=1")
        held = self._read(gen, "level=1", SEGMENT)
        entries = held.filter("kind = 'txn'").select("segment_id", "feed", "n_bytes", "inputs", F.size("inputs").cast("long").alias("n_inputs"), "n_records")
        journal = [self._entries(entries, 1, "files")]
        held, level = held.filter("kind = 'record'"), 1
        while goal * self.fan_in < self.target and entries.count() > 1:
            goal *= self.fan_in
            level += 1
            merged, made = merge_segments(held, entries, goal, self.fan_in)
            self._write(merged, f"{at}/level={level}")
            held = self._read(gen, f"level={level}", f"segment_id string, segment_bytes long, {RECORD}")
            entries = made.join(held.groupBy("segment_id").agg(F.count("*").alias("n_records")), "segment_id", "left").fillna(0, ["n_records"])
            self._write(entries, f"{at}/entries={level}")
            entries = self.spark.read.schema(entries.schema).parquet(f"{at}/entries={level}")
            journal.append(self._entries(entries, level, "segments"))
        inputs = entries.groupBy("feed").agg(F.count("*").alias("n_inputs"))
        size = entries.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        self._run(gen, held, size, level + 1, "segments", F.array(F.lit(f"level={level}")), inputs, journal)
        for part in listed(self.spark, at):
            if part.startswith(("level=", "entries=")):
                remove(self.spark, f"{at}/{part}")
        return self._merge_runs(gen)

    def _run(self, gen: int, records: DataFrame, size: int, level: int, kind: str, inputs, n_inputs: DataFrame, journal: list[DataFrame]) -> None:
        """The last merge: each record to one file of about the target size; then the journal, which commits."""
        at, shards = f"{self.path}/gen={gen}", max(1, math.ceil(size / self.target))
        whole = latest_copies(records.select(*_RECORD).repartition(shards, "feed", "record_id"), ["feed", "record_id"])
        self._write(whole.select(*_RECORD), f"{at}/run")
        counts = self._read(gen, "run", RECORD).groupBy("feed").agg(F.count("*").alias("n_records"), F.sum("n_bytes").alias("n_bytes"))
        last = n_inputs.join(counts, "feed", "left").select(
            F.lit(level).alias("level"), F.lit(kind).alias("kind"), F.lit(f"run={gen}").alias("output"), "feed", inputs.alias("inputs"), "n_inputs", F.lit(shards).cast("long").alias("n_outputs"),
            F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"),
        )
        self._write(reduce(DataFrame.unionByName, [*journal, last]), f"{at}/journal")

    def _merge_runs(self, gen: int, least: int | None = None) -> int:
        """Merge the runs of each size class that has ``fan_in`` of them, until none has; the merged runs' records are deleted."""
        while True:
            by: dict[int, list[int]] = {}
            for g, (size, _) in self.runs().items():
                by.setdefault(0 if least else tier(size // max(1, self.target // self.fan_in), self.fan_in), []).append(g)
            full = next((sorted(gs) for _, gs in sorted(by.items()) if len(gs) >= (least or self.fan_in)), None)
            if full is None:
                return gen
            sizes, gen = self.runs(), gen + 1
            records = reduce(DataFrame.unionByName, [self._read(g, "run", RECORD) for g in full])
            feeds = self.journal().filter(F.col("generation").isin(full) & F.col("output").startswith("run=")).groupBy("feed").agg(F.countDistinct("output").alias("n_inputs"))
            level = 1 + self.journal().filter(F.col("generation").isin(full)).agg(F.max("level")).first()[0]
            self._run(gen, records, sum(sizes[g][0] for g in full), level, "runs", F.array(*(F.lit(f"run={g}") for g in full)), feeds, [])
            for g in full:
                remove(self.spark, f"{self.path}/gen={g}/run")

    def compact(self) -> int:
        """Merge all runs into one, so that each record stands in one file once."""
        gens = self._generations()
        return self._merge_runs(gens[-1], least=2) if len(self.runs()) > 1 else (gens[-1] if gens else -1)

    def _entries(self, entries: DataFrame, level: int, kind: str) -> DataFrame:
        one = F.lit(1).cast("long").alias("n_outputs")
        return entries.select(F.lit(level).alias("level"), F.lit(kind).alias("kind"), F.col("segment_id").alias("output"), "feed", "inputs", "n_inputs", one, "n_records", "n_bytes")

    @staticmethod
    def _write(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
