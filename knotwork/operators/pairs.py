"""Candidate pairs: universes, strata, lexical ranking, rule filter, identity reasons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import measures as M
from knotwork.functions import text as X
from knotwork.session import SOURCE_BYTES, col, estimated_bytes, small, written


def numbered(df: DataFrame, order: Sequence[str], out: str = "no", within: Sequence[str] = ()) -> DataFrame:
    """Sequence numbers from 1 over a total order.

    Without ``within`` the rows are range-partitioned by the order, written, and counted per
    partition, so that no task sorts them all; only the counts, as many as partitions, are gathered.
    The table is written because the partition bounds are sampled and must not be drawn twice.
    """
    if within:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*map(col, within)).orderBy(*map(col, order))).cast("long"))
    spread = df.repartitionByRange(*map(col, order)).sortWithinPartitions(*map(col, order))
    at = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    held = written(spread.withColumn("part_", F.spark_partition_id()).withColumn("at_", at), "numbered")
    counts = held.groupBy("part_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part_", before.alias("before_"))
    return held.join(F.broadcast(starts), "part_").withColumn(out, F.col("before_") + F.col("at_") + 1).drop("part_", "at_", "before_")


def local_universe(df: DataFrame, group: str, key: str) -> DataFrame:
    """``group, a, b``: all unordered pairs of keys inside a group, a before b.

    This is the operator's definition: n(n-1)/2 rows per group, so the group must be a block of
    bounded size. Repeated rows count once; null groups and keys have no pairs.
    """
    one = df.select(col(group).alias("group"), col(key).alias("a")).dropna().distinct()
    return one.join(one.withColumnRenamed("a", "b"), "group").filter("a < b")


def universe_counts(df: DataFrame, group: str, key: str) -> DataFrame:
    """The same universe's size per group without making it."""
    n = df.select(col(group).alias("group"), col(key).alias("k")).dropna().distinct().groupBy("group").agg(F.count("*").alias("n_objects"))
    return n.withColumn("n_pairs", (F.col("n_objects") * (F.col("n_objects") - 1) / 2).cast("long"))


SCOPES = {"course": ("same_course_cross_lecture", "cross_course"), "topic": ("same_topic_cross_lecture", "cross_topic")}


def scoped_universe(objects: DataFrame, key: str, lecture: str, places: DataFrame) -> DataFrame:
    """``a, b, pair_id, stratum`` and four scope flags: the cross-lecture universe of all objects.

    ``objects`` has a row per object and lecture, ``places`` one per ``lecture`` with ``course`` and
    ``topic``; a null course or topic, or that of an unknown lecture, equals another null. A flag holds
    if some combination of two different lectures has it; it is found from each object's courses (or
    topics), those in which it has several lectures, and those in which it has one, not from the
    combinations. The universe is quadratic in the objects by definition.
    """
    own = objects.select(col(key).alias("k"), col(lecture).alias("lecture")).dropna().distinct().join(places.select("lecture", *(F.col(c).cast("string") for c in SCOPES)), "lecture", "left")
    o = own.groupBy("k").agg(F.collect_list("lecture").alias("l"))
    for c in SCOPES:
        by = own.groupBy("k", F.coalesce(c, F.lit("")).alias("c")).agg(F.count("*").alias("n"), F.min("lecture").alias("one"))
        parts = by.groupBy("k").agg(F.collect_list("c").alias(f"{c}_all"), F.collect_list(F.when(F.col("n") > 1, F.col("c"))).alias(f"{c}_many"), F.collect_list(F.when(F.col("n") == 1, F.col("c"))).alias(f"{c}_solo"), F.collect_list(F.when(F.col("n") == 1, F.col("one"))).alias(f"{c}_at"))
        o = o.join(parts, "k")
    o = written(o, "objects")
    side = lambda s: o.select(*(F.col(x).alias(f"{x}_{s}") for x in o.columns))
    spread = o.sparkSession.sparkContext.defaultParallelism * 4
    pairs = side("a").repartition(spread, "k_a").crossJoin(F.broadcast(side("b")) if estimated_bytes(o) <= SOURCE_BYTES else side("b")).filter("k_a < k_b")
    one_same = (F.size("l_a") == 1) & (F.size("l_b") == 1) & (F.col("l_a")[0] == F.col("l_b")[0])
    flags = []
    for c, (same, cross) in SCOPES.items():
        x = lambda n, s, c=c: F.col(f"{c}_{n}_{s}")
        alone = F.size(F.array_intersect(x("solo", "a"), x("solo", "b"))) > F.size(F.array_intersect(x("at", "a"), x("at", "b")))
        flags.append((F.arrays_overlap(x("many", "a"), x("all", "b")) | F.arrays_overlap(x("all", "a"), x("many", "b")) | alone).alias(same))
        flags.append((~((F.size(x("all", "a")) == 1) & (F.size(x("all", "b")) == 1) & (x("all", "a")[0] == x("all", "b")[0]))).alias(cross))
    stratum = F.when(F.arrays_overlap("l_a", "l_b"), "overlapping_provenance").otherwise("disjoint_provenance")
    return pairs.filter(~one_same).select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), M.pair_id("pair_", F.col("k_a").cast("string"), F.col("k_b").cast("string")).alias("pair_id"), stratum.alias("stratum"), *flags)


def idf(objects: DataFrame, key: str, tokens: str) -> DataFrame:
    """``token, df, idf`` with idf = ln((N+1)/(df+1)) + 1 over the objects."""
    n = objects.agg(F.count("*").alias("n"))  # one row
    each = objects.select(col(key).alias("k"), F.explode(F.array_distinct(col(tokens))).alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("df"))
    return counts.crossJoin(F.broadcast(n)).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weighted_jaccard(objects: DataFrame, block: Sequence[str], key: str, tokens: str, weights: DataFrame) -> DataFrame:
    """``*block, a, b, n_shared, weighted_jaccard`` of the pairs of a block that share a token.

    An inverted index per block: only pairs that meet at a token are made, each with the summed
    weight of the shared tokens; the union's weight is the two totals less the shared one. Pairs
    without a shared token have 0 and are not made. Rounded to 12 digits, so that ranks do not
    depend on the order of summing. The index is written once, as both sides of the join read it.
    """
    taken = {"a", "b", "n_shared", "weighted_jaccard"} & set(block)
    if taken:
        raise ValueError(f"block columns under names of the result: {sorted(taken)}")
    bs = [f"block_{i}" for i in range(len(block))]
    posted = objects.select(*(col(c).alias(n) for c, n in zip(block, bs, strict=True)), col(key).alias("a"), F.explode(F.array_distinct(col(tokens))).alias("token"))
    posted = posted.join(weights.select("token", "idf"), "token")
    posted = written(posted.withColumn("wa", F.sum("idf").over(Window.partitionBy(*bs, "a"))), "posted")
    other = posted.select(*bs, "token", F.col("a").alias("b"), F.col("wa").alias("wb"))
    met = posted.join(other, [*bs, "token"]).filter("a < b")
    shared = met.groupBy(*bs, "a", "b").agg(F.count("*").alias("n_shared"), F.sum("idf").alias("ws"), F.first("wa").alias("wa"), F.first("wb").alias("wb"))
    score = F.round(F.try_divide(F.col("ws"), F.col("wa") + F.col("wb") - F.col("ws")), 12)
    return shared.select(*(F.col(n).alias(c) for c, n in zip(block, bs, strict=True)), "a", "b", "n_shared", score.alias("weighted_jaccard"))


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Ranks from 1 inside each group over a total order, without a task that sees a whole group.

    The rows are numbered over group and order together; a group's first number, a partial minimum,
    is taken off. Nulls in ``by`` are one group.
    """
    held = numbered(df, [*by, *order], "no_")
    first = held.groupBy(*(col(c).alias(f"g{i}_") for i, c in enumerate(by))).agg(F.min("no_").alias("first_"))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(f"g{i}_").eqNullSafe(col(c))
    return held.join(first, on).withColumn(out, F.col("no_") - F.col("first_") + 1).drop("no_", "first_", *(f"g{i}_" for i in range(len(by))))


def ranked(df: DataFrame, score: str, ids: Sequence[str], within: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Rank by score, highest first, ids break ties; no task sorts a whole group."""
    signed = df.withColumn("neg_", -F.col(score))
    made = rank_within(signed, list(within), ["neg_", *ids], out) if within else numbered(signed, ["neg_", *ids], out)
    return made.drop("neg_")


def top_fraction(df: DataFrame, sizes: DataFrame, fraction: float, within: Sequence[str], rank: str = "rank") -> DataFrame:
    """The first max(1, floor(n * fraction)) ranks of each group, where ``sizes`` has ``*within, n_pairs``."""
    keep = F.greatest(F.lit(1), F.floor(F.col("n_pairs") * F.lit(fraction)))
    return df.join(sizes.select(*within, keep.alias("keep_")), list(within)).filter(F.col(rank) <= F.col("keep_")).drop("keep_")


METHODS = ("all_pairs", "overlap_bridge", "lexical_only", "hybrid_provenance_lexical")
#: Partitions over which the objects of one lecture spread, and objects per block of a running sum.
PARTS, BLOCK = 16, 1 << 16


def sharing(objects: DataFrame, key: str, lectures: str) -> DataFrame:
    """``a, b``: the eligible pairs that share a lecture, a before b.

    Two objects of one and the same lecture only are no pair, so one of each pair has several lectures:
    only those look their lectures up in the index. The objects of a large lecture are spread by salt.
    """
    at = objects.select(col(key).alias("k"), F.size(col(lectures)).alias("m"), F.explode(col(lectures)).alias("l"))
    many = at.filter("m > 1").select("l", F.col("k").alias("x"), F.explode(F.array(*map(F.lit, range(PARTS)))).alias("salt"))
    every = at.select("l", F.col("k").alias("y"), F.pmod(F.hash("k"), F.lit(PARTS)).alias("salt"))
    return many.join(every, ["l", "salt"]).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def connection_candidates(objects: DataFrame, key: str, lectures: str, tokens: str, method: str, fraction: float = 0.8, kind: str | None = None, bonus: float = 0.03, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """``(pairs, tail)``: the selection of a method from the cross-lecture universe of all objects.

    ``all_pairs`` keeps every pair, ``overlap_bridge`` those that share a lecture; ``lexical_only``
    and ``hybrid_provenance_lexical`` keep the first max(1, floor(n * fraction)) of all n eligible
    pairs by weighted overlap, plus ``bonus`` where ``kind`` differs, the latter plus 1 where a
    lecture is shared; ties in the order of the ids. No pair is lost and none is made in vain:
    ``pairs`` (``a, b, stratum, score, rank``) has the kept pairs that share a token (for the hybrid
    also those that share a lecture), which two inverted indexes give; all others have one of two
    scores, and ``tail`` (``score, n_pairs, n_kept, last_a, last_b``) says for each how many there are and
    how many are kept: all, none, or those up to the pair ``last_a, last_b`` in id order. ``rank`` is
    that among all eligible pairs for pairs that score more than the tail, else null. Null keys and
    objects without a lecture are left out, repeated keys count once.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    c, spark = F.col, objects.sparkSession
    own = objects.select(col(key).alias("k"), F.array_compact(F.array_distinct(col(lectures))).alias("l"), col(tokens).alias("t"), (F.coalesce(col(kind), F.lit("")) if kind and bonus else F.lit("")).alias("kind"))
    o = written(numbered(own.dropna(subset=["k"]).filter(F.size("l") > 0).dropDuplicates(["k"]), ["k"], "n"), "objects")
    total = eligible_pairs(o, "l").first()[0]
    tails = "score double, n_pairs long, n_kept long, last_a string, last_b string"
    name = lambda s: small(o.select(c("n").alias(s), c("k").alias(f"k{s}")))
    if method == "all_pairs":
        return o.limit(0).select(c("k").alias("a"), c("k").alias("b"), F.lit("").alias("stratum"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("rank")), spark.createDataFrame([(1.0, total, total, None, None)], tails)
    shared = sharing(o, "n", "l").withColumn("shared", F.lit(True))
    if method == "overlap_bridge":
        kept = numbered(shared, ["a", "b"], "rank").join(name("a"), "a").join(name("b"), "b")
        return kept.select(c("ka").alias("a"), c("kb").alias("b"), F.lit("overlapping_provenance").alias("stratum"), F.lit(1.0).alias("score"), "rank"), spark.createDataFrame([], tails)
    hybrid = method == METHODS[3]
    scored = weighted_jaccard(o, [], "n", "t", idf(o, "n", "t")).select("a", "b", "weighted_jaccard")
    met = scored.join(shared, ["a", "b"], "full" if hybrid else "left")
    side = lambda s: small(o.select(c("n").alias(s), c("l").alias(f"l{s}"), c("kind").alias(f"kind_{s}")))
    one_same = (F.size("la") == 1) & (F.size("lb") == 1) & (c("la")[0] == c("lb")[0])
    met = met.join(side("a"), "a").join(side("b"), "b").filter(~one_same).withColumn("differ", c("kind_a") != c("kind_b"))
    score = F.coalesce("weighted_jaccard", F.lit(0.0)) + F.when(c("differ"), F.lit(bonus)).otherwise(0.0) + (F.when(c("shared"), 1.0).otherwise(0.0) if hybrid else F.lit(0.0))
    found = ranked(met.select("a", "b", F.coalesce("shared", F.lit(False)).alias("shared"), "differ", F.round(score, digits).alias("score")), "score", ["a", "b"])
    later = _later(o, found, bonus)
    n_differ, n_same = later.agg(F.coalesce(F.sum("differ"), F.lit(0)), F.coalesce(F.sum("same"), F.lit(0))).first()
    above, ties = found.agg(F.count_if(c("score") > bonus), F.count_if(c("score") == bonus)).first()
    between = found.count() - above - ties
    keep = max(1, math.floor(total * fraction)) if total else 0
    # in order: scores above the bonus, the bonus (tail of differing kinds and ties), scores below it, 0
    at_bonus, below = above + ties + n_differ, above + ties + n_differ + between
    tie = c("score") == bonus
    if keep <= above or at_bonus < keep <= below:
        position = keep if keep <= above else keep - n_differ
        cut = found.filter(c("rank") == position).select("score", "a", "b").first() or (float("inf"), -1, -1)
        kept_differ, kept_same, last = (0 if keep <= above else n_differ), 0, {}
    elif keep <= at_bonus:
        a, b = _nth(o, found.filter(tie), later.withColumn("c", c("differ") + c("ties")), found, keep - above, True)
        cut, kept_same = (bonus, a, b), 0
        kept_differ = keep - above - found.filter(tie & ((c("a") < a) | ((c("a") == a) & (c("b") <= b)))).count()
        last = {bonus: (a, b)}
    else:
        kept_differ, kept_same = n_differ, keep - below
        a, b = _nth(o, None, later.withColumn("c", c("same")), found, kept_same, False) if kept_same < n_same else (-1, -1)
        cut, last = (-1.0, -1, -1), {0.0: (a, b)} if a >= 0 else {}
    inside = (c("score") > cut[0]) | ((c("score") == cut[0]) & ((c("a") < cut[1]) | ((c("a") == cut[1]) & (c("b") <= cut[2]))))
    stratum = F.when(F.arrays_overlap("la", "lb"), "overlapping_provenance").otherwise("disjoint_provenance")
    full = lambda s: small(o.select(c("n").alias(s), c("k").alias(f"k{s}"), c("l").alias(f"l{s}")))
    pairs = found.filter(inside).join(full("a"), "a").join(full("b"), "b").select(c("ka").alias("a"), c("kb").alias("b"), stratum.alias("stratum"), "score", F.when(c("score") > bonus, c("rank")).alias("rank"))
    label = {n: k for n, k in o.filter(c("n").isin([x for pair in last.values() for x in pair])).select("n", "k").collect()} if last else {}
    rows = [(s, n, kept, *([label[x] for x in last[s]] if s in last else (None, None))) for s, n, kept in ((bonus, n_differ, kept_differ), (0.0, n_same, kept_same)) if n]
    return pairs, spark.createDataFrame(rows, tails)


def _later(o: DataFrame, found: DataFrame, bonus: float) -> DataFrame:
    """``n, differ, same, ties``: for each object the eligible pairs with later objects that ``found`` lacks, by kind, and ties with the bonus.

    The pairs with all later objects, less those of one kind, less those of one lecture only, from
    ranks inside kinds and lectures: no pair is made.
    """
    c = F.col

    def after(by: tuple[str, ...], out: str) -> DataFrame:
        """How many objects of the same ``by`` come later: counts per block of numbers, then places inside the block."""
        rows = o.withColumn("one", F.when(F.size("l") == 1, c("l")[0]))
        rows = (rows.filter("one IS NOT NULL") if "one" in by else rows).select("n", F.to_json(F.struct(*by)).alias("by_"), F.floor(c("n") / BLOCK).alias("block_"))
        sizes = rows.groupBy("by_", "block_").agg(F.count("*").alias("m_"))
        upto = F.sum("m_").over(Window.partitionBy("by_").orderBy(F.desc("block_")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        inside = F.row_number().over(Window.partitionBy("by_", "block_").orderBy("n"))
        return rows.withColumn("i_", inside).join(sizes.withColumn("upto_", upto), ["by_", "block_"]).select("n", (c("upto_") - c("i_")).alias(out))

    e = found.groupBy(c("a").alias("n")).agg(F.count_if("differ").alias("e_differ"), F.count_if(~c("differ")).alias("e_same"), F.count_if(c("score") == F.lit(bonus)).alias("ties"))
    rows = o.select("n").crossJoin(F.broadcast(o.agg(F.max("n").alias("top"))))  # one row
    for by, out in ((("kind",), "t"), (("one",), "l"), (("kind", "one"), "lt")):
        rows = rows.join(after(by, out), "n", "left")
    rows = rows.join(e, "n", "left").fillna(0)
    differ = (c("top") - c("n") - c("t")) - (c("l") - c("lt")) - c("e_differ")
    return written(rows.select("n", differ.alias("differ"), (c("t") - c("lt") - c("e_same")).alias("same"), "ties"), "later")


def _nth(o: DataFrame, ties: DataFrame | None, counts: DataFrame, found: DataFrame, m: int, differ: bool) -> tuple[int, int]:
    """The m-th pair, in id order, of the tail of differing or of same kinds, ties of its score included.

    ``counts`` has ``n, c``: the pairs of each first object. A running sum over blocks of objects finds the
    block, one inside it the object, and its later objects are numbered; nothing grows with the pairs.
    """
    c = F.col
    upto = lambda by, order: F.sum("c").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = counts.groupBy(F.floor(c("n") / BLOCK).alias("block")).agg(F.sum("c").alias("c"))  # a BLOCK-th of the objects
    block = blocks.withColumn("s", upto([], "block")).filter(c("s") >= m).orderBy("block").first()
    inside = counts.filter(F.floor(c("n") / BLOCK) == block.block).withColumn("s", upto([], "n") + (block.s - block.c))
    first = inside.filter(c("s") >= m).orderBy("n").first()
    one = o.filter(c("n") == first.n).select(c("l").alias("la"), c("kind").alias("kind_a"))
    rows = o.filter(c("n") > first.n).crossJoin(F.broadcast(one))  # one row
    rows = rows.filter(~((F.size("l") == 1) & (F.size("la") == 1) & (c("l")[0] == c("la")[0]))).filter((c("kind") != c("kind_a")) == F.lit(differ)).select("n")
    rows = rows.join(found.filter(c("a") == first.n).select(c("b").alias("n")), "n", "left_anti")
    if ties is not None:
        rows = rows.unionByName(ties.filter(c("a") == first.n).select(c("b").alias("n")))
    at = m - (first.s - first.c)
    return first.n, numbered(rows, ["n"], "no").filter(c("no") == at).first().n


def eligible_pairs(objects: DataFrame, lectures: str) -> DataFrame:
    """One row ``n_pairs``: the size of the cross-lecture universe, without making it.

    All pairs less those whose objects both live in exactly one and the same lecture.
    """
    half = lambda n: (n * (n - 1) / 2).cast("long")
    by = objects.groupBy(F.when(F.size(col(lectures)) == 1, col(lectures)[0]).alias("l")).agg(F.count("*").alias("n"))
    same = F.coalesce(F.sum(F.when(F.col("l").isNotNull(), half(F.col("n")))), F.lit(0))
    return by.agg((half(F.coalesce(F.sum("n"), F.lit(0))) - same).alias("n_pairs"))


def rule_reasons(distance: Column, shared_words: Column, shared_symbols: Column, cue: Column, max_distance: int = 1, min_words: int = 1, min_symbols: int = 1) -> Column:
    """Why a pair is a candidate, in fixed order; an empty array is no candidate.

    A pair without a location on either side (null distance) is never near.
    """
    return M.all_true({
        "source_proximity": F.coalesce(distance <= max_distance, F.lit(False)), "lexical_overlap": F.coalesce(shared_words >= min_words, F.lit(False)),
        "symbol_overlap": F.coalesce(shared_symbols >= min_symbols, F.lit(False)), "explicit_reference": F.coalesce(cue, F.lit(False)),
    })


#: Phrases that tie two objects named in one block, in normal form; the reference's own list is not available.
CUES = ("also known as", "based on", "because of", "called", "compared to", "consists of", "defined as", "depends on", "derived from", "equivalent to", "follows from", "known as", "leads to", "related to", "such as")


#: Objects per block of a group, members per row of a block, and pairs per task of the listing, as far as tasks go.
GROUP_BLOCK, MEMBERS, TASK_PAIRS, MOST_TASKS = 2048, 64, 1 << 22, 20_000


def rule_decisions(objects: DataFrame, blocks: DataFrame, group: str, key: str, name: str, spans: str, cues: Sequence[str] = CUES, symbols: Sequence[str] = X.SYMBOLS, max_distance: int = 1, min_words: int = 1, min_symbols: int = 1, joined: str | None = None) -> DataFrame:
    """``group, a, b, selected, reasons, exclusion_reason``: the rule filter's decision on every pair inside a group.

    ``blocks`` has ``group, block_index, span``. An object stands in the blocks that hold one of its
    spans, both in :func:`X.feature_text` form, else in those that hold its name, else nowhere. A pair
    has an explicit reference if a block with a cue phrase names both: it is a place of the object or
    holds all its words. With ``joined`` the reasons are one text, parted by it.

    The audit is quadratic inside a group by definition. A group is cut into blocks of about
    ``GROUP_BLOCK`` objects, and each pair of blocks is a unit of work, so a large group is many tasks and an
    object is copied once per block. Objects of a block with the same places, symbols and cues are the
    members of one row: three of the rules are decided once for all pairs of two rows, and the shared words
    pair by pair, where the bits of their hashes meet. Joins of objects are merged, never broadcast: the
    estimate does not count the copies, which the driver would have to hold.
    """
    c, ids, spark = F.col, ["g", "id"], objects.sparkSession
    texts = written(blocks.select(col(group).alias("g"), "block_index", X.feature_text(c("span")).alias("text")), "texts")
    own = objects.select(col(group).alias("g"), col(key).alias("id"), col(name).alias("name"), F.coalesce(col(spans), F.array().cast("array<string>")).alias("spans")).dropna(subset=ids).dropDuplicates(ids)
    own = written(own.select(*ids, "spans", X.feature_text(c("name")).alias("name"), X.lexical_tokens(X.name_key(c("name"))).alias("words")), "objects")
    quoted = own.select("g", F.explode("spans").alias("s")).dropna().distinct().select("g", "s", X.feature_text(c("s")).alias("needle"))
    held = lambda needles, n: texts.join(needles, "g").filter((c(n) != "") & F.contains("text", c(n)))
    by_span = held(quoted, "needle").select("g", "s", "block_index").join(own.select(*ids, F.explode("spans").alias("s")).hint("merge"), ["g", "s"]).select(*ids, "block_index").distinct()
    by_span = written(by_span, "by_span")
    named = own.join(by_span.hint("merge"), ids, "left_anti").select(*ids, "name")
    at = written(by_span.unionByName(held(named, "name").select(*ids, "block_index")), "places")
    cued = texts.filter(F.exists(F.array(*map(F.lit, cues)).cast("array<string>"), lambda x: F.contains("text", x))).select("g", "block_index", X.words(c("text")).alias("held"))
    said = cued.join(own.select(*ids, "words"), "g").filter(F.size(F.array_except("words", "held")) == 0).select(*ids, "block_index")
    said = said.unionByName(at.join(cued.select("g", "block_index"), ["g", "block_index"]).select(*ids, "block_index"))
    lists = lambda df, out: df.groupBy(*ids).agg(F.sort_array(F.collect_set("block_index")).alias(out)).hint("merge")
    o = own.select(*ids, "words", F.sort_array(X.symbol_tokens(c("spans"), symbols)).alias("symbols")).join(lists(at, "at"), ids, "left").join(lists(said, "said"), ids, "left")
    sizes = own.groupBy("g").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum(c("n") * (c("n") - 1) / 2)).first()[0] or 0
    tasks = min(MOST_TASKS, max(spark.sparkContext.defaultParallelism, math.ceil(total / TASK_PAIRS)))
    o = o.join(sizes.select("g", F.ceil(c("n") / GROUP_BLOCK).cast("int").alias("of")), "g").withColumn("block", F.pmod(F.hash("id"), c("of")))
    bits = F.expr("aggregate(words, 0L, (m, w) -> m | shiftleft(1L, pmod(hash(w), 64)))")
    rows = o.groupBy("g", "of", "block", "at", "said", "symbols").agg(F.collect_list(F.struct("id", "words", bits.alias("bits"))).alias("m"))
    cut = F.expr(f"explode(transform(sequence(0, int((size(m) - 1) div {MEMBERS})), k -> slice(m, k * {MEMBERS} + 1, {MEMBERS})))")
    near = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x - max_distance, x + max_distance))))
    rows = written(rows.select("g", "of", "block", "at", "said", "symbols", near.alias("near"), cut.alias("m")), "members")
    side = lambda s, i, j: rows.select("g", i.alias("i"), j.alias("j"), *(c(x).alias(f"{x}_{s}") for x in ("at", "said", "symbols", "near", "m"))).repartition(tasks, "g", "i", "j")
    met = side("a", c("block"), F.explode(F.sequence("block", c("of") - 1))).join(side("b", F.explode(F.sequence(F.lit(0), c("block"))), c("block")).hint("merge"), ["g", "i", "j"])
    first_a, first_b = c("m_a")[0]["id"], c("m_b")[0]["id"]  # no two rows of a group begin with the same id
    met = met.filter((c("i") < c("j")) | (first_a <= first_b))
    shared = lambda x, y: F.size(F.array_intersect(x, y))
    distance = F.when(F.arrays_overlap("near_a", "at_b"), 0).otherwise(max_distance + 1)
    why = lambda n: rule_reasons(distance, n, shared("symbols_a", "symbols_b"), F.arrays_overlap("said_a", "said_b"), max_distance, min_words, min_symbols)
    alone, worded = why(F.lit(None).cast("int")), why(F.lit(min_words))
    form = (lambda x: F.array_join(x, joined)) if joined is not None else lambda x: x
    met = met.select("g", (first_a == first_b).alias("same"), (F.size(alone) > 0).alias("some"), form(alone).alias("alone"), form(worded).alias("worded"), "m_a", "m_b")
    met = met.select("g", "same", "some", "alone", "worded", "m_b", F.explode("m_a").alias("x")).select("g", "same", "some", "alone", "worded", "x", F.explode("m_b").alias("y"))
    met = met.filter(~c("same") | (c("x.id") < c("y.id")))
    words = F.when(c("x.bits").bitwiseAND(c("y.bits")) == 0, 0).otherwise(shared("x.words", "y.words"))
    met = met.select("g", F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), "some", "alone", "worded", F.coalesce(words >= min_words, F.lit(False)).alias("lexical"))
    some = c("some") | c("lexical")
    return met.select(c("g").alias(group), "a", "b", some.alias("selected"), F.when(c("lexical"), c("worded")).otherwise(c("alone")).alias("reasons"), F.when(~some, "no_rule_triggered").alias("exclusion_reason"))


IDENTITY_REASONS = ("exact_normalized_name", "frozen_alias_identity", "name_token_equivalence", "initialism_name_match", "name_token_containment", "exact_source_span")


def identity_candidates(mentions: DataFrame, block: str | None, key: str, kind: str, name: str, spans: str | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Pairs of mentions of one type that may name one object, with all reasons in fixed order.

    Without ``block`` all mentions are compared, and ``key`` must be unique over them; with it only
    those of one block. Reasons are found through keys, never by comparing all pairs of a type, and
    those of names between distinct names, of which the mentions' pairs are then made: equal alias
    key, equal word sequence, initials, one name's words inside the other's (met at the rarest word
    of the shorter one), equal name; and a shared span. ``aliases`` maps ``alias`` keys to
    ``alias_key``, of one type only where it has a column ``type``.
    """
    base = mentions.select((col(block) if block else F.lit("")).alias("block"), col(key).alias("id"), col(kind).alias("type"), X.name_key_native(col(name)).alias("name"), (col(spans) if spans else F.array().cast("array<string>")).alias("spans"))
    base = written(base.dropna(subset=["block", "id", "type", "name"]).dropDuplicates(["block", "id"]), "mentions")
    c, group = F.col, ["block", "type"]
    names = base.select(*group, "name").distinct().withColumn("words", X.name_words(c("name"))).withColumn("initials", X.initials(c("words")))
    if aliases is not None:
        typed = [x for x in ("type",) if x in aliases.columns]
        names = names.join(aliases.select(*typed, c("alias").alias("name"), "alias_key"), ["name", *typed], "left").withColumn("alias_key", F.coalesce("alias_key", "name"))
    else:
        names = names.withColumn("alias_key", c("name"))
    names = written(names.select(*group, "name", "words", "initials", "alias_key"), "names")
    each = names.select(*group, "name", F.explode(F.array_distinct("words")).alias("word"))
    rare = each.join(each.groupBy(*group, "word").agg(F.count("*").alias("n")), [*group, "word"]).groupBy(*group, "name").agg(F.min(F.struct("n", "word")).alias("r"))
    tagged = lambda t, v: F.concat(F.lit(t), v)
    equal = [tagged("a:", c("alias_key")), tagged("e:", F.array_join("words", " "))]
    posted = names.select(*group, c("name").alias("name_b"), F.explode(F.concat(F.transform(F.array_distinct("words"), lambda w: tagged("w:", w)), F.array(tagged("i:", c("initials")), *equal))).alias("met"))
    sought = F.array(tagged("w:", c("r.word")), F.when((F.size("words") == 1) & (F.length(F.get("words", F.lit(0))) >= 2), tagged("i:", F.get("words", F.lit(0)))), *equal)
    sought = names.join(rare, [*group, "name"], "left").select(*group, c("name").alias("name_a"), F.explode(F.filter(sought, lambda k: k.isNotNull())).alias("met"))
    met = sought.join(posted, [*group, "met"]).filter("name_a <> name_b").select(*group, F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b")).distinct()
    side = lambda s: names.select(*group, *(c(x).alias(f"{x}_{s}") for x in ("name", "alias_key", "words", "initials")))
    short = lambda x, y: (F.size(c(f"words_{x}")) == 1) & (F.length(F.get(c(f"words_{x}"), F.lit(0))) >= 2) & (F.get(c(f"words_{x}"), F.lit(0)) == c(f"initials_{y}"))
    some = (F.size("words_a") > 0) & (F.size("words_b") > 0)
    bit = lambda flag, reason: F.when(flag, 1 << IDENTITY_REASONS.index(reason)).otherwise(0)
    bits = (
        bit(c("alias_key_a") == c("alias_key_b"), "frozen_alias_identity").bitwiseOR(bit(c("words_a") == c("words_b"), "name_token_equivalence"))
        .bitwiseOR(bit(short("a", "b") | short("b", "a"), "initialism_name_match"))
        .bitwiseOR(bit(some & (X.proper_subset(c("words_a"), c("words_b")) | X.proper_subset(c("words_b"), c("words_a"))), "name_token_containment"))
    )
    alike = met.join(side("a"), [*group, "name_a"]).join(side("b"), [*group, "name_b"]).select(*group, "name_a", "name_b", bits.alias("bits")).filter("bits > 0")
    own = lambda s: base.select(*group, c("name").alias(f"name_{s}"), c("id").alias(f"id_{s}"))
    differ = alike.join(own("a"), [*group, "name_a"]).join(own("b"), [*group, "name_b"]).select("block", "id_a", "id_b", "bits")
    same = own("a").join(own("b").withColumnRenamed("name_b", "name_a"), [*group, "name_a"]).filter("id_a < id_b").select("block", "id_a", "id_b", F.lit(1).alias("bits"))
    held = lambda s: base.select(*group, c("id").alias(f"id_{s}"), F.explode(F.array_distinct(F.filter("spans", lambda x: x.isNotNull()))).alias("span"))
    cited = held("a").withColumn("span", F.sha2("span", 256)).join(held("b").withColumn("span", F.sha2("span", 256)), [*group, "span"]).filter("id_a < id_b").select("block", "id_a", "id_b", F.lit(1 << 5).alias("bits")).distinct()
    found = differ.unionByName(same).unionByName(cited).groupBy("block", F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).agg(F.bit_or("bits").alias("bits"))
    reasons = F.filter(F.array(*(F.when(c("bits").bitwiseAND(1 << i) > 0, r) for i, r in enumerate(IDENTITY_REASONS))), lambda r: r.isNotNull())
    return found.select(*(["block"] if block else []), "a", "b", reasons.alias("reasons"))
