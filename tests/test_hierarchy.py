import random

from lumenlog.operators import hierarchy


def frame(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, n int, parent string")


def brute(rows):
    spans = {(t.lower(), s.lower()) for t, s, _ in rows if t and s}
    parent = {}
    for t, s, p in rows:
        if t and s and p and p.strip("0") and (t.lower(), p.lower()) in spans:
            k = (t.lower(), s.lower())
            parent[k] = min(parent.get(k, p.lower()), p.lower())
    out = set()
    for t, s in spans:
        x, d, seen = s, 0, {s}
        while (t, x) in parent:
            x, d = parent[t, x], d + 1
            if x in seen:
                x, d = "", -1
                break
            seen.add(x)
        out.add((t, s, x, d))
    return out


def found(df, **kw):
    return {(r["trace_id"], r["span_id"], r["root_span_id"], r["depth"]) for r in hierarchy.hierarchies(df, **kw).collect()}


def test_random_forests_and_loops(spark):
    rng = random.Random(5)
    rows = [(f"T{rng.randint(1, 6)}", f"s{rng.randint(1, 25)}", rng.choice([None, "", "0000", f"S{rng.randint(1, 25)}"])) for _ in range(400)]
    rows += [(None, "a", "b"), ("t", None, "b"), ("", "a", None)]
    df = frame(spark, [(*r, 1, "x") for r in rows])
    assert found(df) == brute(rows)
    assert found(df, limit=5) == brute(rows)


def test_paths_descendants_and_back_edges(spark):
    rows = [("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "x", "y"), ("t", "y", "x"), ("t", "z", "y"), ("t", "o", "o")]
    got = {r["span_id"]: r for r in hierarchy.hierarchies(frame(spark, [(*r, 1, "x") for r in rows])).collect()}
    assert got["c"]["path"] == ["a", "b", "c"] and got["a"]["descendants"] == 2 and got["c"]["descendants"] == 0
    assert [got[k]["depth"] for k in "xyzo"] == [-1] * 4
    assert got["o"]["back_edge"] and got["x"]["back_edge"] != got["y"]["back_edge"] and not got["z"]["back_edge"]
    assert got["x"]["component"] == got["z"]["component"] == "x"


def test_long_chain_by_doubling(spark):
    rows = [("t", f"{k:05d}", f"{k - 1:05d}" if k else None, 1, "") for k in range(1, 700)] + [("t", "00000", None, 1, "")]
    got = {r["span_id"]: r["depth"] for r in hierarchy.hierarchies(frame(spark, rows), limit=10).collect()}
    assert got["00699"] == 699 - 1 or got["00699"] == 699


def test_empty(spark):
    assert found(frame(spark, [])) == set()
