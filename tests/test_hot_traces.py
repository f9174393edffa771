"""Traces above the limit give the same paths, descendants and loop marks as small ones."""

import random
from collections import Counter

import __spark_entry__ as entry
from lumenlog.operators import hierarchy

SHAPE = "trace_id string, span_id string, parent_span_id string"


def rows_of(df):
    return {(r["trace_id"], r["span_id"], r["parent_span_id"], r["root_span_id"], r["depth"], tuple(r["path"]), r["descendants"], r["back_edge"], r["component"]) for r in df.collect()}


def below(found):
    """Brute force: every span above each span, by climbing until one repeats."""
    parent = {(t, s): p for t, s, p, *_ in found}
    out = set()
    for t, s in parent:
        x, seen = parent[t, s], set()
        while x is not None and x not in seen:
            seen.add(x)
            out.add((t, x, s))
            x = parent[t, x]
    return {(t, a, b) for t, a, b in out if a != b}


def test_hot_traces_are_whole(spark):
    rng = random.Random(7)
    rows = [(f"T{rng.randint(1, 5)}", f"s{rng.randint(1, 30):02d}", rng.choice([None, f"s{rng.randint(1, 30):02d}", f"s{rng.randint(1, 30):02d}"])) for _ in range(130)]
    rows += [("L", f"n{k:02d}", f"n{(k + 1) % 9:02d}") for k in range(9)] + [("L", "a", "n04"), ("L", "b", "a"), ("L", "o", "o"), ("L", "r", None), ("L", "q", "r")]
    df = spark.createDataFrame(rows, SHAPE)
    want = rows_of(hierarchy.hierarchies(df))
    assert rows_of(hierarchy.hierarchies(df, limit=5)) == want and any(r[7] for r in want) and any(len(r[5]) > 3 for r in want)
    pairs = below(want)
    assert Counter((t, a) for t, a, _ in pairs) == Counter({r[:2]: r[6] for r in want if r[6]})
    for limit in (5, 200_000):
        got = [tuple(r) for r in hierarchy.descendants(df, limit=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs


def test_registered(spark, small):
    whole = entry.queries()["p6_hierarchies"](spark, small)
    assert {"path", "descendants", "back_edge", "component"} <= set(whole.columns)
    want = rows_of(whole)
    assert {(r[0], r[1], r[3], r[4]) for r in want} == {tuple(r) for r in entry.queries()["p6_found"](spark, small).collect()}
    assert {tuple(r) for r in entry.queries()["p6_descendants"](spark, small).collect()} == below(want)
