"""Parent-child links to full hierarchies with cycles (problem 6).

Spans of one trace are co-located (a connected component never leaves its
trace) and a depth-first walk with node colours finds components, paths,
depths, descendants and back edges in one pass. Traces with more spans than
``limit`` are never gathered into one task: their links are resolved by
pointer doubling, which spreads one trace over the cluster, and paths,
descendants and loops follow from joins on the doubled pointers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenlog.functions.text import present_id
from lumenlog.session import cut

RESULT = "array<struct<span_id:string,parent_span_id:string,root_span_id:string,depth:int,path:array<string>,descendants:bigint,back_edge:boolean,component:string,branch:array<string>>>"


def walk(parents: dict[str, str | None]) -> list[tuple]:
    """One trace: (span, parent, root, depth, path, descendants, back_edge, component, branch).

    White nodes are not met yet, grey ones lie on the current climb, black
    ones are done. A link to a grey node is a back edge: all nodes on the loop
    and all below it get root '' and depth -1 and an empty path; their branch
    leads from the loop to the span, for others it is empty.
    """
    children: dict[str, list[str]] = {}
    for s, p in parents.items():
        if p is not None:
            children.setdefault(p, []).append(s)
    colour: dict[str, int] = {}
    closing: set[str] = set()
    heads: list[str] = []
    for s in sorted(parents):
        climb: list[str] = []
        while s is not None and s not in colour:
            colour[s] = 1
            climb.append(s)
            up = parents[s]
            if up is None:
                heads.append(s)
            elif colour.get(up) == 1:
                closing.add(s)
            s = up
        for x in climb:
            colour[x] = 2
    out: dict[str, list] = {}
    for head in heads:
        stack: list[tuple[str, tuple[str, ...]]] = [(head, ())]
        while stack:
            s, above = stack.pop()
            path = (*above, s)
            out[s] = [parents[s], head, len(above), list(path), 0, False, head, []]
            stack.extend((c, path) for c in children.get(s, ()))
    for s in sorted(out, key=lambda x: -out[x][2]):
        p = parents[s]
        if p is not None:
            out[p][4] += 1 + out[s][4]
    for s in closing:
        loop, x = [s], parents[s]
        while x != s:
            loop.append(x)
            x = parents[x]
        component, on = min(loop), set(loop)
        size, stack2, order = 0, [(x, (x,)) for x in loop], []
        seen, branches = set(loop), {}
        while stack2:
            x, branch = stack2.pop()
            order.append(x)
            branches[x] = branch
            size += 1
            for c in children.get(x, ()):
                if c not in seen:
                    seen.add(c)
                    stack2.append((c, (*branch, c)))
        below = dict.fromkeys(order, 0)
        for x in reversed(order):
            if x not in on:
                up = parents[x]
                if up not in on:
                    below[up] += 1 + below[x]
        for x in order:
            out[x] = [parents[x], "", -1, [], size - 1 if x in on else below[x], x in closing, component, list(branches[x])]
    return [(s, *v) for s, v in out.items()]


def _walk_all(spans: pd.Series) -> pd.Series:
    names = ("span_id", "parent_span_id", "root_span_id", "depth", "path", "descendants", "back_edge", "component", "branch")
    return pd.Series([[dict(zip(names, r, strict=True)) for r in walk({x["s"]: x["p"] for x in row})] for row in spans])


def span_links(df: DataFrame) -> DataFrame:
    """(trace_id, span_id, parent): distinct spans with the parent present in the trace.

    Identifiers are compared in lower case; missing ones and an all-zero
    parent link nothing. A span that names several present parents follows
    the smallest.
    """
    ids = df.select(*(present_id(F.col(c)).alias(c) for c in ("trace_id", "span_id", "parent_span_id"))).filter("trace_id is not null and span_id is not null")
    named = ids.groupBy("trace_id", "span_id").agg(F.collect_set(F.when(F.col("parent_span_id").rlike("[^0-]"), F.col("parent_span_id"))).alias("named"))
    wanted = named.select("trace_id", "span_id", F.explode_outer("named").alias("p"))
    present = named.select("trace_id", F.col("span_id").alias("p"), F.lit(True).alias("here"))
    return wanted.join(present, ["trace_id", "p"], "left").groupBy("trace_id", "span_id").agg(F.min(F.when(F.col("here"), F.col("p"))).alias("parent"))


def pointers(links: DataFrame) -> DataFrame:
    """(trace_id, span_id, parent_span_id, up, hops, top, low) of arbitrarily large traces by pointer doubling.

    Each round a node's pointer skips to its pointer's pointer and the
    distances add up, so a chain of n spans takes log2 n rounds. A pointer
    still unresolved (top is NULL) after as many rounds as its trace has
    doublings runs into a loop and then lies on it; low is the smallest span
    met on the way, which for a span on the loop is the loop's smallest.
    """
    at = cut(links.select("trace_id", "span_id", F.col("parent").alias("parent_span_id"), F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("hops"), F.when(F.col("parent").isNull(), F.col("span_id")).alias("top"), F.col("span_id").alias("low")))
    longest = at.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, int(longest).bit_length())):
        far = at.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("top").alias("top2"), F.col("low").alias("low2"))
        at = cut(
            at.filter("top is null")
            .join(far, ["trace_id", "up"])
            .select("trace_id", "span_id", "parent_span_id", F.col("up2").alias("up"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("top2").alias("top"), F.least("low", "low2").alias("low"))
            .unionByName(at.filter("top is not null"))
        )
    return at


def doubled(links: DataFrame) -> DataFrame:
    """Roots and depths of arbitrarily large traces."""
    lost = F.col("top").isNull()
    return pointers(links).select("trace_id", "span_id", "parent_span_id", F.coalesce("top", F.lit("")).alias("root_span_id"), F.when(lost, -1).otherwise(F.col("hops")).cast("int").alias("depth"))


def doubled_whole(links: DataFrame) -> DataFrame:
    """All columns of ``walk`` for arbitrarily large traces.

    Every pointer that runs into a loop ends on it, and every span of the loop
    is the end of some pointer. With the links of the loops' spans cut, what is
    left are trees, whose paths double as the pointers do: the path to the
    pointer goes before the path from it.
    """
    at = pointers(links)
    loops = at.filter("top is null").select("trace_id", F.col("up").alias("span_id")).distinct().withColumn("on_loop", F.lit(True))
    at = at.join(loops, ["trace_id", "span_id"], "left").withColumn("on_loop", F.coalesce("on_loop", F.lit(False)))
    keep = ["trace_id", "span_id", "parent_span_id", F.col("top").isNull().alias("lost"), "on_loop", "low"]
    at = cut(at.select(*keep, F.when(~F.col("on_loop"), F.col("parent_span_id")).alias("up"), F.array("span_id").alias("line")))
    while not at.filter("up is not null").isEmpty():
        far = at.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("line").alias("line2"))
        further = at.filter("up is not null").join(far, ["trace_id", "up"]).withColumns({"up": F.col("up2"), "line": F.concat("line2", "line")}).drop("up2", "line2")
        at = cut(further.unionByName(at.filter("up is null")))
    at = at.withColumn("head", F.col("line")[0])
    below = at.select("trace_id", F.explode(F.slice("line", 1, F.size("line") - 1)).alias("span_id")).groupBy("trace_id", "span_id").agg(F.count(F.lit(1)).alias("below"))
    at = at.join(below, ["trace_id", "span_id"], "left").withColumn("below", F.coalesce("below", F.lit(0)))
    trees = at.filter(~F.col("lost")).select("trace_id", "span_id", "parent_span_id", F.col("head").alias("root_span_id"), (F.size("line") - 1).alias("depth"), F.col("line").alias("path"), F.col("below").alias("descendants"), F.lit(False).alias("back_edge"), F.col("head").alias("component"), F.expr("cast(array() as array<string>)").alias("branch"))
    named = at.filter("on_loop").select("trace_id", F.col("span_id").alias("head"), F.col("low").alias("component"))
    lost = at.filter("lost").join(named, ["trace_id", "head"])
    # the walk starts at the smallest span and enters the loop at that span's head
    sized = lost.groupBy("trace_id", "component").agg((F.count(F.lit(1)) - 1).alias("others"), F.min_by("head", "span_id").alias("entry"))
    lost = lost.join(sized, ["trace_id", "component"]).select("trace_id", "span_id", "parent_span_id", F.lit("").alias("root_span_id"), F.lit(-1).alias("depth"), F.expr("cast(array() as array<string>)").alias("path"), F.when(F.col("on_loop"), F.col("others")).otherwise(F.col("below")).alias("descendants"), (F.col("on_loop") & (F.col("parent_span_id") == F.col("entry"))).alias("back_edge"), "component", F.col("line").alias("branch"))
    return trees.unionByName(lost)


def _resolved(df: DataFrame, limit: int, whole: bool) -> DataFrame:
    links = cut(span_links(df))
    sizes = links.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("trace_id")
    hot = cut(sizes)
    small = links.join(hot, "trace_id", "left_anti")
    rows = (
        small.groupBy("trace_id")
        .agg(F.collect_list(F.struct(F.col("span_id").alias("s"), F.col("parent").alias("p"))).alias("spans"))
        .select("trace_id", F.explode(F.pandas_udf(_walk_all, RESULT)("spans")).alias("r"))
        .select("trace_id", "r.*")
    )
    if hot.isEmpty():
        return rows
    large = links.join(hot, "trace_id", "left_semi")
    return rows.unionByName(doubled_whole(large)) if whole else rows.select("trace_id", "span_id", "parent_span_id", "root_span_id", "depth").unionByName(doubled(large))


def hierarchies(df: DataFrame, *, limit: int = 200_000) -> DataFrame:
    """Every distinct span with parent, root, depth, path, descendants, loop mark.

    Columns: trace_id, span_id, parent_span_id, root_span_id, depth, path
    (root first), descendants (how many spans lie below), back_edge (the link
    that closes a loop), component. A span in a loop or below one has root
    '', depth -1 and an empty path. Traces above ``limit`` spans are resolved
    by joins, with the same result.
    """
    return _resolved(df, limit, True).drop("branch")


def roots(df: DataFrame, *, limit: int = 200_000) -> DataFrame:
    """(trace_id, span_id, root_span_id, depth) of ``hierarchies``; of large traces nothing else is made."""
    return _resolved(df, limit, False).select("trace_id", "span_id", "root_span_id", "depth")


def descendants(df: DataFrame, *, limit: int = 200_000) -> DataFrame:
    """(trace_id, span_id, descendant): every span with each other span below it.

    A span in a loop has all others of the loop, and all below the loop, as
    descendants.
    """
    h = cut(_resolved(df, limit, True))
    above = F.when(F.col("depth") >= 0, F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).otherwise(F.slice("branch", 2, F.greatest(F.size("branch") - 2, F.lit(0))))
    trees = h.select("trace_id", F.explode(above).alias("span_id"), F.col("span_id").alias("descendant"))
    lost = h.filter("depth = -1")
    loops = lost.filter(F.size("branch") == 1).select("trace_id", "component", "span_id")
    pairs = loops.join(lost.select("trace_id", "component", F.col("span_id").alias("descendant")), ["trace_id", "component"]).filter("span_id <> descendant")
    return trees.unionByName(pairs.select("trace_id", "span_id", "descendant"))
