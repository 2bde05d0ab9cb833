"""Filling containers of fixed capacity with items, by linear grouping and best fit.

Lengths are whole numbers up to the capacity, so the whole problem is a table of counts by length
whose size the capacity bounds, whatever the number of documents. The driver plans on that table:

1. lengths over ``capacity * large`` are cut into groups of equal cardinality and rounded up to the
   longest of their group;
2. configurations of the few rounded sizes are optimised: the linear program of the cutting-stock
   problem by column generation, whole uses first, then sizes best fit;
3. the actual documents take the places of their rounded size, longest first; the smallest place
   of a configuration stays open, as its space and what the rounding left are filled best together;
4. the open space, and new containers, take the documents that are left by best fit, longest first.

A plan row says: of length l the items ranked from r on, so many, go to the containers from c on,
q to each. Items are ranked within their length in parallel and look their row up; no document
reaches the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import written

#: Share of the capacity over which a length is large, and the number of groups.
LARGE, GROUPS = 0.25, 16
#: The driver plans at most so many windows, and as many lengths as their capacities together.
MOST_WINDOWS, MOST_LENGTHS = 100, 1 << 21
#: Items of one length are ranked in at least so many parts, and in more where a part would have more than so many items.
RANKED, PART = 64, 500_000


def linear_groups(sizes: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """Group numbers of ascending sizes, of about equal cardinality; a size is in one group."""
    before = np.cumsum(counts) - counts
    number = (before + counts / 2) * groups // max(1, counts.sum())
    return np.unique(number, return_inverse=True)[1]


def best_column(capacity: int, sizes: list[int], value: np.ndarray) -> tuple[float, dict[int, int]]:
    """The unbounded knapsack: the configuration of greatest value and its uses per size."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = [i for i in range(len(sizes)) if value[i] > 1e-9]
    for i in order:
        s, v = sizes[i], value[i]
        for start in range(s, capacity + 1, s):  # blocks of s places: none depends on another of its block
            end = min(start + s, capacity + 1)
            with_i = best[start - s : end - s] + v
            better = with_i > best[start:end] + 1e-12
            best[start:end][better] = with_i[better]
            last[start:end][better] = i
    at, uses = int(best.argmax()), {}
    total = best[at]
    while last[at] >= 0:
        i = int(last[at])
        uses[i] = uses.get(i, 0) + 1
        at -= sizes[i]
    return float(total), uses


def configurations(capacity: int, sizes: list[int], counts: list[int], rounds: int = 400) -> list[tuple[dict[int, int], int]]:
    """Whole uses of configurations from the linear program, by revised simplex with column generation.

    What the rounding down leaves over is less than one container per size; it goes to the
    remaining counts and is packed by best fit.
    """
    k = len(sizes)
    basis = [{i: capacity // sizes[i]} for i in range(k)]
    matrix = np.diag([float(capacity // s) for s in sizes])
    demand = np.array(counts, float)
    level = np.linalg.solve(matrix, demand)
    for _ in range(rounds):
        value = np.linalg.solve(matrix.T, np.ones(k))
        total, uses = best_column(capacity, sizes, value)
        if total <= 1 + 1e-7:
            break
        column = np.zeros(k)
        for i, n in uses.items():
            column[i] = n
        step = np.linalg.solve(matrix, column)
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        matrix[:, out], basis[out] = column, uses
        level = np.maximum(np.linalg.solve(matrix, demand), 0)
    left, made = list(counts), []
    for uses, x in sorted(zip(basis, level, strict=True), key=lambda b: -b[1]):
        n = min(int(x + 1e-6), *(left[i] // m for i, m in uses.items()))
        if n > 0:
            made.append((uses, n))
            for i, m in uses.items():
                left[i] -= m * n
    return made


class Plan:
    """Plan rows and open containers, kept as runs of containers with equal space left."""

    def __init__(self, capacity: int, lengths: np.ndarray, counts: np.ndarray):
        self.capacity, self.next = capacity, 0
        self.left = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        self.rank = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, items, first container, items each
        self.open: dict[int, list[tuple[int, int]]] = {}  # space -> [(first container, how many)]
        self.spaces: list[int] = []

    def give(self, space: int, first: int, many: int) -> None:
        if many and space:
            if space not in self.open:
                insort(self.spaces, space)
                self.open[space] = []
            self.open[space].append((first, many))

    def take(self, space: int) -> tuple[int, int]:
        run = self.open[space].pop()
        if not self.open[space]:
            del self.open[space]
            self.spaces.pop(bisect_left(self.spaces, space))
        return run

    def place(self, length: int, first: int, many: int, each: int) -> None:
        n = many * each
        self.rows.append((length, self.rank[length], n, first, each))
        self.rank[length] += n
        self.left[length] -= n

    def new(self, many: int) -> int:
        self.next += many
        return self.next - many

    def use(self, uses: list[tuple[list[int], int]], many: int) -> None:
        """``many`` new containers of one configuration: per size its actual lengths, longest first, and places each."""
        runs = [(self.new(many), many, self.capacity)]
        for lengths, each in uses:
            for _ in range(each):
                after = []
                for first, n, space in runs:
                    while n:
                        length = next((x for x in lengths if self.left[x]), 0)
                        if not length:
                            after.append((first, n, space))
                            break
                        m = min(n, self.left[length])
                        self.place(length, first, m, 1)
                        after.append((first, m, space - length))
                        first, n = first + m, n - m
                runs = after
        for first, n, space in runs:
            self.give(space, first, n)

    def best_fit(self) -> None:
        """All lengths that are left, longest first, each to the least space that holds it, as often as it fits."""
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                at = bisect_left(self.spaces, length)
                if at == len(self.spaces):
                    each = min(self.capacity // length, self.left[length])
                    many = self.left[length] // each
                    self.give(self.capacity, self.new(many), many)
                    continue
                space = self.spaces[at]
                first, many = self.take(space)
                each = min(space // length, self.left[length])
                n = min(many, self.left[length] // each)
                self.place(length, first, n, each)
                self.give(space - length * each, first, n)
                self.give(space, first + n, many - n)


def plan(capacity: int, lengths: np.ndarray, counts: np.ndarray, large: float = LARGE, groups: int = GROUPS) -> Plan:
    """The packing of ``counts`` items of each of the ``lengths`` (1 to capacity)."""
    made = Plan(capacity, lengths, counts)
    order = np.argsort(lengths)
    big = order[lengths[order] > capacity * large]
    if len(big):
        number = linear_groups(lengths[big], counts[big], groups)
        members = [lengths[big][number == g][::-1].tolist() for g in range(number.max() + 1)]
        sizes = [m[0] for m in members]
        amounts = [int(sum(made.left[x] for x in m)) for m in members]
        for uses, many in configurations(capacity, sizes, amounts):
            places = sorted(uses.items(), reverse=True)
            if sum(uses.values()) > 1:
                places[-1] = (places[-1][0], places[-1][1] - 1)
            made.use([(members[i], n) for i, n in places if n], many)
    made.best_fit()
    return made


def packed(counted: DataFrame, windows: DataFrame, key: str = "doc_id", tokens: str = "n_tokens", large: float = LARGE, groups: int = GROUPS) -> DataFrame:
    """``window_name, container, <key>, first_token, n_tokens``: every placed piece of every document.

    ``counted`` has the size of each document, ``windows`` the name and capacity of each window (at
    most ``MOST_WINDOWS`` windows and ``MOST_LENGTHS`` tokens of capacity in all; more are an error). A document over the capacity is split into full
    pieces, each alone in a container, and its rest, which is packed like any other document; no
    other is split. Every token is placed once, documents without tokens (null or 0) nowhere.
    Rows of one key are items of their own. Containers are numbered from 0 per window: first the
    planned ones, then the full pieces. Without documents there are no rows; a null or
    non-positive capacity is an error.
    """
    caps = windows.select("window_name", "capacity").distinct().limit(MOST_WINDOWS + 1).collect()
    if len(caps) > MOST_WINDOWS or any(not r.capacity or r.capacity < 1 for r in caps) or sum(r.capacity for r in caps) > MOST_LENGTHS:
        raise ValueError("too many windows, too large capacities or none")
    if len({r.window_name for r in caps}) < len(caps):
        raise ValueError("a window with two capacities")
    caps = sorted(caps, key=lambda r: r.window_name or "")
    items = written(counted.filter(F.col(tokens) > 0).select(F.col(key).alias("key_"), F.col(tokens).cast("long").alias("size")), "sizes")
    window = F.explode(F.array(*(F.struct(F.lit(i).alias("w"), F.lit(r.capacity).cast("long").alias("cap")) for i, r in enumerate(caps)))) if caps else None
    names = F.array(*(F.lit(r.window_name) for r in caps)) if caps else F.array(F.lit(""))
    cols = [names[F.col("w")].alias("window_name"), "container", F.col("key_").alias(key), "first_token", "n_tokens"]
    if not caps:
        null = F.lit(0).cast("long")
        return items.limit(0).select(F.lit(0).alias("w"), null.alias("container"), "key_", null.alias("first_token"), null.alias("n_tokens")).select(*cols)

    each = items.select("key_", "size", window.alias("x")).select("key_", "size", "x.w", "x.cap")
    rest = F.when(F.col("size") <= F.col("cap"), F.col("size")).otherwise(F.pmod("size", "cap"))
    split = each.select("key_", "w", (F.col("size") - rest).alias("first_token"), rest.alias("n")).filter("n > 0")
    table = split.groupBy("w", "n").agg(F.count("*").alias("c")).collect()  # at most the sum of the capacities
    made = []
    for i, r in enumerate(caps):
        own = sorted((t.n, t.c) for t in table if t.w == i)
        made.append(plan(r.capacity, np.array([t[0] for t in own], np.int64), np.array([t[1] for t in own], np.int64), large, groups))
    looked_up = [_lookup(m) for m in made]
    kind = items.schema["key_"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 3, 4))
            container = np.empty(len(b), np.int64)
            for i, (starts, first, base, each_) in enumerate(looked_up):
                mine = np.flatnonzero(w == i)
                if len(mine):
                    at = np.searchsorted(starts, (length[mine] << 44) + rank[mine], side="right") - 1
                    container[mine] = base[at] + (rank[mine] - first[at]) // each_[at]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(container), b.column(0), b.column(2), b.column(3)], ["w", "container", "key_", "first_token", "n_tokens"])

    parts_ = max(RANKED, -(-sum(t.c for t in table) // PART))
    placed = _ranked(split, ["w", "n"], parts_).select("key_", "w", "first_token", "n", "rank")
    parts = placed.mapInArrow(look_up, f"w int, container long, key_ {kind}, first_token long, n_tokens long")
    full = each.filter("size > cap").select("key_", "w", "cap", F.floor(F.col("size") / F.col("cap")).alias("pieces"))  # ranked by document, split into pieces afterwards
    planned = F.array(*(F.lit(m.next).cast("long") for m in made))
    ranked = _ranked(full, ["w"], parts_, "pieces").select("key_", "w", "cap", "rank", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    alone = ranked.select(
        "w", (planned[F.col("w")] + F.col("rank") + F.col("piece")).alias("container"), "key_", (F.col("piece") * F.col("cap")).cast("long").alias("first_token"), F.col("cap").alias("n_tokens")
    )
    return parts.unionByName(alone).select(*cols)


def _lookup(made: Plan) -> tuple[np.ndarray, ...]:
    """The plan's rows as sorted arrays: start (length and rank in one number), first rank, first container, items each."""
    rows = sorted(made.rows)
    first, base, each = (np.array([r[i] for r in rows], np.int64) for i in (1, 3, 4))
    return np.array([(r[0] << 44) + r[1] for r in rows], np.int64), first, base, each


def _ranked(items: DataFrame, by: list[str], parts: int, weight: str | None = None) -> DataFrame:
    """``rank`` from 0 within equal values of ``by``, an item taking ``weight`` ranks: sums per value and part, then positions inside the parts."""
    amount = F.col(weight) if weight else F.lit(1)
    parted = items.withColumn("part", F.pmod(F.xxhash64(*items.columns), F.lit(parts)))
    sums = parted.groupBy(*by, "part").agg(F.sum(amount).alias("n_"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "part", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy(*by, "part").orderBy(*items.columns)
    inside = F.coalesce(F.sum(amount).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(order) - 1
    return parted.withColumn("inside", inside).join(sums, [*by, "part"]).withColumn("rank", F.col("before") + F.col("inside")).drop("part", "inside", "before")
