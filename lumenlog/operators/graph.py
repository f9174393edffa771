"""Graph operators over edge tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenlog.session import cut


def connected_components(edges: DataFrame, left: str, right: str, *, max_rounds: int = 100) -> DataFrame:
    """(component, member): members with the smallest member linked to them.

    Alternates two steps until nothing changes: every node's larger
    neighbours are linked to its smallest one, then its smaller ones are.
    Both steps keep the components and flatten them to stars, so that the
    rounds grow with the logarithm of the size. Loops and missing ends link
    nothing.
    """
    a, b = F.col(left), F.col(right)
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(a.isNotNull() & b.isNotNull() & (F.col("u") != F.col("v"))).distinct())
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        new = cut(large.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct())
        after, e = mark(new), new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("v").alias("component"), F.col("u").alias("member")).union(e.select(F.col("v"), F.col("v"))).distinct()


def acyclic(rows: list[tuple]) -> set[int]:
    """Indexes of the (source, target, score, forward) edges to keep in one component.

    Edges that go forward in time cannot close a loop among themselves; the
    others come by falling score and are left out if they would.
    """
    after: dict[int, list[int]] = {}
    kept = {k for k, r in enumerate(rows) if r[3]}
    for k in kept:
        after.setdefault(rows[k][0], []).append(rows[k][1])
    for k in sorted((k for k, r in enumerate(rows) if not r[3]), key=lambda k: (-rows[k][2], rows[k][0], rows[k][1])):
        source, target = rows[k][0], rows[k][1]
        stack, seen = [target], set()
        while stack and source not in seen:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack.extend(after.get(x, ()))
        if source not in seen:
            kept.add(k)
            after.setdefault(source, []).append(target)
    return kept


def cyclic_core(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """Edges without those that cannot lie on a loop, as far as ``rounds`` of trimming show.

    An edge whose source nothing leads to, or whose target leads nowhere, is
    on no loop; taking such edges away lays bare the next ones.
    """
    left = edges.count()
    for _ in range(rounds):
        into, out = edges.select(F.col("target").alias("source")).distinct(), edges.select(F.col("source").alias("target")).distinct()
        edges = cut(edges.join(into, "source", "left_semi").join(out, "target", "left_semi"))
        now = edges.count()
        if now == left:
            break
        left = now
    return edges


def dag_edges(directed: DataFrame, label: DataFrame, *, limit: int = 200_000) -> DataFrame:
    """Directed relationships without loops.

    label: (component, member) of any partition that no edge crosses. Only
    edges that do not go forward in time can close a loop. Where a component
    has such an edge its edges are gathered and tested; all others pass
    untouched, which is the usual case. If more than ``limit`` edges would be
    gathered they are first trimmed to those that may lie on a loop.
    """
    forward = F.coalesce(F.col("delta_ms") > 0, F.lit(False))
    if directed.filter(~forward).isEmpty():
        return directed
    tagged = directed.join(label.select(F.col("member").alias("source"), F.col("component").alias("_c")), "source", "left").withColumn("_f", forward)
    doubtful = tagged.filter(~F.col("_f")).select("_c").distinct()
    suspects = cut(tagged.join(doubtful, "_c", "left_semi").select("_c", F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target"), "score", "_f"))
    if suspects.count() > limit:
        suspects = cyclic_core(suspects)

    def loops(series: pd.Series) -> pd.Series:
        out = []
        for row in series:
            edges = [(x["source"], x["target"], x["score"], x["_f"]) for x in row]
            kept = acyclic(edges)
            out.append([{"source": e[0], "target": e[1]} for k, e in enumerate(edges) if k not in kept])
        return pd.Series(out)

    gathered = suspects.groupBy("_c").agg(F.collect_list(F.struct("source", "target", "score", "_f")).alias("e"))
    bad = gathered.select(F.explode(F.pandas_udf(loops, "array<struct<source:bigint,target:bigint>>")("e")).alias("k")).select("k.source", "k.target")
    return directed.join(bad, ["source", "target"], "left_anti").select(*directed.columns)


def descendants(edges: list[tuple[int, int]]) -> dict[int, int]:
    """How many nodes each node reaches, by bit sets in reverse topological order."""
    after: dict[int, set[int]] = {}
    degree: dict[int, int] = {}
    for s, t in edges:
        if t not in after.setdefault(s, set()):
            after[s].add(t)
            degree[t] = degree.get(t, 0) + 1
        after.setdefault(t, set())
    order = [n for n in after if not degree.get(n)]
    for n in order:
        for t in after[n]:
            degree[t] -= 1
            if not degree[t]:
                order.append(t)
    number = {n: k for k, n in enumerate(order)}
    reach: dict[int, int] = {}
    for n in reversed(order):
        bits = 0
        for t in after[n]:
            bits |= reach[t] | (1 << number[t])
        reach[n] = bits
    return {n: b.bit_count() for n, b in reach.items()}


def reachable_counts(edges: DataFrame, *, limit: int = 50_000) -> DataFrame:
    """(id, downstream) from (source, target, component): distinct nodes below each node.

    Components up to ``limit`` edges are counted in one task each; larger ones
    by repeated joins that only ever extend newly reached pairs.
    """
    sizes = edges.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    big = sizes.filter(F.col("n") > limit).select("component")

    def count(series: pd.Series) -> pd.Series:
        return pd.Series([[{"id": k, "downstream": v} for k, v in descendants([(x["source"], x["target"]) for x in row]).items()] for row in series])

    small = edges.join(big, "component", "left_anti").groupBy("component").agg(F.collect_list(F.struct(F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target"))).alias("e"))
    got = small.select(F.explode(F.pandas_udf(count, "array<struct<id:bigint,downstream:bigint>>")("e")).alias("x")).select("x.id", "x.downstream")
    large = cut(edges.join(big, "component", "left_semi").select("source", "target").distinct())
    if large.isEmpty():
        return got
    reached, front = large, large
    while not front.isEmpty():
        step = front.select("source", F.col("target").alias("_m")).join(large.select(F.col("source").alias("_m"), "target"), "_m").select("source", "target").distinct()
        front = cut(step.join(reached, ["source", "target"], "left_anti"))
        reached = cut(reached.union(front))
    counted = reached.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("downstream"))
    return got.unionByName(counted)
