from pyspark.sql import functions as F

from lumenlog.llm import packing


def packed(spark, sizes, capacities, **kw):
    items = spark.createDataFrame([(k, s, 1) for k, s in enumerate(sizes)], "id bigint, size int, capacity int")
    return packing.pack(items, spark.createDataFrame([(f"w{c}", c) for c in capacities], "window_name string, capacity_tokens int"), **kw)


def check(rows, sizes, capacity):
    rows = [r for r in rows if r["capacity"] == capacity]
    whole = {}
    for r in rows:
        whole.setdefault(r["id"], []).append(r["tokens"])
    assert {k: sum(v) for k, v in whole.items()} == {k: s for k, s in enumerate(sizes) if s and s > 0}
    assert all(len(v) == -(-sizes[k] // capacity) for k, v in whole.items())
    windows = {}
    for r in rows:
        windows[r["window"]] = windows.get(r["window"], 0) + r["tokens"]
    assert all(r["window_tokens"] == windows[r["window"]] <= capacity for r in rows)
    return sum(windows.values()) / (len(windows) * capacity)


def test_fill_and_splits(spark):
    sizes = [(k * 37) % 301 + 1 for k in range(2000)] + [5000, 512, 0, None]
    rows = packed(spark, sizes, [512, 2048], per_part=300).collect()
    assert check(rows, sizes, 512) > 0.97 and check(rows, sizes, 2048) > 0.97


def test_many_levels_of_merging(spark):
    sizes = [k % 50 + 1 for k in range(400)]
    assert check(packed(spark, sizes, [64], per_part=5).collect(), sizes, 64) > 0.9


def test_repeated_runs_agree(spark):
    sizes = [(k * 13) % 90 + 1 for k in range(300)]
    assert {tuple(r) for r in packed(spark, sizes, [100]).collect()} == {tuple(r) for r in packed(spark, sizes, [100]).collect()}


def test_empty(spark):
    assert packed(spark, [], [10]).count() == 0
    assert packed(spark, [1, 2], [0]).count() == 0


def test_count_of_pieces(spark):
    df = spark.createDataFrame([("I'm here,  now 12!\n\nÉté",), ("",), (None,)], "t string").select(packing.token_count(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [11, 0, None]


def test_counted_sizes_equal_given_ones(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").filter("n_tokens is not null")
    bad = d.filter(packing.token_count(F.col("text")) != F.col("n_tokens")).count()
    assert bad == 0
