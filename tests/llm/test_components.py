import random

from lumenlog.llm import components


def groups(df, a="s", b="t"):
    return {(r["group_id"], r["member"]) for r in components.connected_groups(df, a, b).collect()}


def brute(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {(root(x), x) for x in parent}


def test_random_graphs_chains_and_hubs(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)]
    pairs += [(1000 + k, 1001 + k) for k in range(300)] + [(5000, 5001 + k) for k in range(200)] + [(7, 7), (None, 1), (2, None), *[(9001, 9000)] * 3]
    df = spark.createDataFrame([(a, b, 1, "m") for a, b in pairs], "s bigint, t bigint, group_id int, member string")
    assert groups(df) == brute(pairs)
    assert {(r["group_id"], r["member"]) for r in components.connected_groups(df, "s", "t", seed=99).collect()} == brute(pairs)


def test_empty_and_unlinked(spark):
    df = spark.createDataFrame([], "s bigint, t bigint")
    assert groups(df) == set()
    assert groups(spark.createDataFrame([(1, 1), (None, 2)], "s bigint, t bigint")) == set()


def test_spelling_of_ids(spark):
    df = spark.createDataFrame([(" Evidence-12", "evidence-3 ", 1.0), ("EVIDENCE-3", "evidence-4", None), ("", "evidence-9", 1.0), ("junk", "evidence-9", 1.0)], "source_id string, target_id string, score double")
    assert {tuple(r) for r in components.evidence_groups(df).collect()} == {(3, 3), (3, 4), (3, 12)}
