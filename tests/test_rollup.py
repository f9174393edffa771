from pyspark.sql import functions as F

from lumenlog.operators import rollup
from lumenlog.session import table


def test_merging_batches_equals_one_rollup(spark, small):
    kept = rollup.retained(table(spark, small, "parsed_events"))
    once = rollup.rollup(kept)
    parts = rollup.rollup(kept.filter("event_id % 2 = 0")).withColumn("batch", F.lit(0)).unionByName(rollup.rollup(kept.filter("event_id % 2 = 1")).withColumn("batch", F.lit(1)))
    cols = [c for c in once.columns]
    assert once.select(cols).exceptAll(rollup.merge_rollups(parts).select(cols)).count() == 0


def test_greedy_fill_passes_over_what_does_not_fit():
    rows = [(1, 10, 5), (2, 20, 100), (1, 11, 5), (2, 21, 1)]
    assert rollup.greedy_fill(rows, 10, 12) == [10, 11]
    assert rollup.greedy_fill([(1, 10, 500)], 10, 12) == [10]


def test_bounded_bytes(spark):
    for s, n, want in (("aé€", 6, "aé€"), ("aé€", 5, "aé"), ("aé€", 2, "a"), ("€", 1, ""), ("", 3, ""), (None, 3, None)):
        assert spark.createDataFrame([(s,)], "s string").select(rollup.bounded_bytes(F.col("s"), n).alias("v")).first()["v"] == want


def test_attribute_budget():
    keep = rollup.fold_attributes([("a", "x" * 30), ("error.code", "y" * 30), ("b", "z")], 60, frozenset({"error"}))
    assert "error.code" in keep and "a" not in keep
    assert dict(rollup.scalar_leaves({"a": {"b": 1, "c": [1]}, "d": None, "e": "x"})) == {"a.b": 1, "e": "x"}


def test_bounded_selection_keeps_small_analyses_whole(spark):
    df = spark.createDataFrame([(1, 1, k, "ERROR", 1, None, "x" * 10) for k in range(5)] + [(2, k % 2, 100 + k, "ERROR", 1, None, "x" * 10) for k in range(50)], "analysis_id int, artifact_id int, id bigint, severity string, occurrence_count bigint, first_seen timestamp_ntz, representative_line string")
    got = rollup.bounded_selection(df, records=10, size=1000)
    assert {r["analysis_id"]: r["count"] for r in got.groupBy("analysis_id").count().collect()} == {1: 5, 2: 10}
