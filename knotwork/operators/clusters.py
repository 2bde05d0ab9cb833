"""Clusters by key, connected components, contradictions, bipartite alignment and edge aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions import measures as M
from knotwork.session import col, discard, written


def group_clusters(mentions: DataFrame, kind: str, key: str, member: str, name: str, order: str) -> DataFrame:
    """One cluster per type and identity key: first mention's name, sorted members, stable id, first position."""
    g = mentions.groupBy(col(kind).alias("type"), col(key).alias("identity_key")).agg(
        F.min_by(col(name), col(order)).alias("canonical_name"), F.min(col(order)).alias("first_seen"), F.array_sort(F.collect_set(col(member))).alias("mention_ids")
    )
    return g.withColumn("n_mentions", F.size("mention_ids")).withColumn("cluster_id", M.cluster_id(F.col("type"), F.col("identity_key"), F.col("mention_ids")))


def components(edges: DataFrame, a: str, b: str, nodes: DataFrame | None = None, node: str = "node", rounds: int = 100) -> DataFrame:
    """``node, component``: the least node id reachable from each node; nodes without edges stay alone.

    Alternating large and small stars: in each round every node links its larger neighbours, then
    all its smaller ones, to its least neighbour. Rounds grow with the logarithm of the size, not
    with the diameter; a round is two grouped joins whose groups are never collected. Each round
    is written to the shared folder, so losing an executor costs no earlier round. Self loops and
    null ends are no edges. Stops when a round changes nothing.
    """
    e = edges.select(col(a).alias("u"), col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def large_star(x: DataFrame) -> DataFrame:
        both = x.unionByName(x.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small_star(x: DataFrame) -> DataFrame:
        least = x.groupBy("u").agg(F.min("v").alias("m"))
        moved = x.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    print_of = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = print_of(e)
    for _ in range(rounds):
        before, e = e, written(small_star(large_star(e)), "edges")
        discard(before)
        now = print_of(e)
        if tuple(now) == tuple(state):
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = found.unionByName(found.select(F.col("component").alias("node"), "component")).distinct()
    if nodes is None:
        return found
    every = nodes.select(col(node).alias("node")).filter("node IS NOT NULL").distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def contradictions(labels: DataFrame, distinct: DataFrame, a: str, b: str) -> DataFrame:
    """DISTINCT pairs whose ends are in one component."""
    la, lb = (labels.select(F.col("node").alias(n), F.col("component").alias(f"c_{n}")) for n in ("a", "b"))
    d = distinct.select(col(a).alias("a"), col(b).alias("b")).distinct()
    return d.join(la, "a").join(lb, "b").filter("c_a = c_b").select("a", "b", F.col("c_a").alias("component"))


def bipartite(matches: DataFrame, left: str, right: str) -> DataFrame:
    """Each match with its component's sizes: 1 by 1 is ``matched``, anything else ``ambiguous``."""
    tagged = matches.select(F.concat(F.lit("l:"), col(left).cast("string")).alias("u"), F.concat(F.lit("r:"), col(right).cast("string")).alias("v"), col(left).alias("left"), col(right).alias("right")).distinct()
    labels = components(tagged, "u", "v")
    sizes = labels.groupBy("component").agg(F.count_if(F.col("node").startswith("l:")).alias("n_left"), F.count_if(F.col("node").startswith("r:")).alias("n_right"))
    status = F.when((F.col("n_left") == 1) & (F.col("n_right") == 1), "matched").otherwise("ambiguous")
    return tagged.join(labels.withColumnRenamed("node", "u"), "u").join(sizes, "component").select("left", "right", "n_left", "n_right", status.alias("status"))


def aggregate_edges(decisions: DataFrame, pair: str, direct: str, edge: Sequence[str], size: str, window: str, pairs: DataFrame | None = None) -> DataFrame:
    """One edge per pair: the only distinct direct edge, else ``NO_RELATION``.

    The winner of a unique edge is the decision with the fewest evidence ids, then the least window
    id. Several distinct directed edges are a conflict. ``pairs`` adds pairs without decisions. The
    distinct edges are counted by least and greatest, which combine map-side.
    """
    e = F.when(F.coalesce(col(direct), F.lit(False)), F.struct(*(col(c) for c in edge)))
    best = F.struct(col(size).alias("size"), col(window).alias("window"))
    g = decisions.groupBy(col(pair).alias("pair")).agg(
        F.count_if(F.coalesce(col(direct), F.lit(False))).alias("n_direct"), F.min(e).alias("least"), F.max(e).alias("most"), F.min(F.when(e.isNotNull(), best)).alias("best"),
    )
    if pairs is not None:
        g = pairs.select(col(pair).alias("pair")).distinct().join(g, "pair", "left").fillna(0, ["n_direct"])
    outcome = F.when(F.col("n_direct") == 0, "no_direct_edge").when(F.col("least").eqNullSafe(F.col("most")), "unique_direct_edge").otherwise("conflicting_direct_edges")
    unique = F.col("outcome") == "unique_direct_edge"
    g = g.withColumn("outcome", outcome)
    return g.select("pair", "n_direct", "outcome", *(F.when(unique, F.col(f"least.{c}")).alias(c) for c in edge), F.when(unique, F.col("best.window")).alias("window"))
