"""Consolidating pairwise matches into groups (problem 4).

Randomised contraction: in every round each vertex hooks to the vertex of its
closed neighbourhood that is first in a fresh hash order, edges are relabelled
and deduplicated, and the mapping of the round is kept. When no edge is left
the mappings are expanded from the last round back to the first. The expected
number of vertices falls by a constant factor per round whatever the degrees,
and every step is a keyed aggregation or an equi-join, so long chains and hot
vertices both stay spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenlog.session import cut


def _hooks(edges: DataFrame, seed: int) -> DataFrame:
    """(v, r): each vertex with the first vertex of its neighbourhood in hash order.

    The minimum is pre-aggregated on the map side, so a hub costs one row per task.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("n")).union(edges.select(F.col("b"), F.col("a")))
    order = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    least = both.groupBy("v").agg(F.min(F.struct(order("n").alias("h"), F.col("n").alias("n"))).alias("m"))
    own = F.struct(order("v").alias("h"), F.col("v").alias("n"))
    return least.select("v", F.least(F.col("m"), own)["n"].alias("r"))


def connected_groups(pairs: DataFrame, left: str, right: str, *, seed: int = 0x51ED, max_rounds: int = 200) -> DataFrame:
    """(group_id, member) for each vertex with at least one link to another.

    pairs: any number of repeated or reversed rows; rows with a missing end or
    equal ends link nothing and are ignored. group_id is the smallest member.
    An empty input gives an empty result.
    """
    a, b = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    edges = cut(
        pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .filter(a.isNotNull() & b.isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    empty = edges.isEmpty()
    maps: list[DataFrame] = []
    for k in range(max_rounds):
        if empty:
            break
        hooks = cut(_hooks(edges, seed + k))
        maps.append(hooks)
        ha = hooks.select(F.col("v").alias("a"), F.col("r").alias("ra"))
        hb = hooks.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        edges = cut(
            edges.join(ha, "a")
            .join(hb, "b")
            .filter("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        empty = edges.isEmpty()
    else:
        if not empty:
            raise RuntimeError(f"contraction left edges after {max_rounds} rounds")
    if not maps:
        return edges.select(F.col("a").alias("group_id"), F.col("b").alias("member"))
    labels = maps[-1]
    for m in reversed(maps[:-1]):
        up = labels.select(F.col("v").alias("r"), F.col("r").alias("top"))
        labels = m.join(up, "r", "left").select("v", F.coalesce("top", "r").alias("r"))
    labels = cut(labels)
    least = labels.groupBy("r").agg(F.min("v").alias("group_id"))
    return labels.join(least, "r").select("group_id", F.col("v").alias("member"))


def evidence_number(c: Column) -> Column:
    """The row number in ``evidence-<n>``, however spelled; NULL if there is none."""
    return F.expr("NULL").cast("bigint") if c is None else F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)^\s*evidence\s*[-_:]?\s*(\d{1,18})\s*$", 1).try_cast("bigint")


def evidence_groups(edges: DataFrame) -> DataFrame:
    """(group_id, evidence_id) over the rows of ``correlation_edges``."""
    pairs = edges.select(evidence_number(F.col("source_id")).alias("s"), evidence_number(F.col("target_id")).alias("t"))
    return connected_groups(pairs, "s", "t").select("group_id", F.col("member").alias("evidence_id"))
