import datetime as dt
import json

from pyspark.sql import functions as F

from lumenlog.operators import correlation, results
from lumenlog.session import cut, table
from lumenlog.streaming import incremental


def test_documents_hold_every_node_and_edge(spark, small):
    e = table(spark, small, "evidence")
    related = cut(correlation.relationships(e))
    ranked = cut(correlation.ranked_causes(e, related))
    docs = [json.loads(r["document"]) for r in results.component_documents(ranked, e, related).collect()]
    assert sum(len(d["nodes"]) for d in docs) == e.count()
    assert sum(len(d["edges"]) for d in docs) == related.count()
    assert all([n["cause_rank"] for n in d["nodes"]] == list(range(1, len(d["nodes"]) + 1)) for d in docs)


def test_statuses(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 4), (2, 5, 5)], "analysis_id int, id bigint, component bigint")
    artifacts = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 11), (5, 12)], "id bigint, artifact_id int")
    got = {(r["analysis_id"], r["artifact_id"]): r["status"] for r in results.artifact_statuses(ranked, artifacts).collect()}
    assert got == {(1, 10): "linked", (1, 11): "partially_linked", (2, 12): None}
    assert [tuple(r) for r in results.primary_components(ranked, artifacts).collect()] == [(1, 1, 2, 3)]


def test_iso(spark):
    rows = [(dt.datetime(2026, 1, 2, 3, 4, 5),), (dt.datetime(2026, 1, 2, 3, 4, 5, 60),), (None,)]
    got = [r["v"] for r in spark.createDataFrame(rows, "t timestamp_ntz").select(results.iso(F.col("t")).alias("v")).collect()]
    assert got == ["2026-01-02T03:04:05", "2026-01-02T03:04:05.000060", None]


def test_fallback_budget(spark):
    df = spark.createDataFrame([(1, k, "x" * 100) for k in range(5)] + [(2, 9, "y" * 900), (2, 10, None), (2, 11, "")], "analysis_id int, artifact_id int, text string")
    got = sorted((r["analysis_id"], r["artifact_id"], len(r["excerpt"])) for r in results.fallback_contexts(df, each=800, together=250).collect())
    assert got == [(1, 0, 100), (1, 1, 100), (2, 9, 800)]


def test_open_entries_go_on_in_the_next_batch():
    import re

    starts = re.compile("A ").match
    kept, done = incremental.fold_lines(None, [(1, "A one"), (2, " more")], starts)
    assert done == [] and kept == (1, 2, "A one\n more")
    kept, done = incremental.fold_lines(kept, [(3, " end"), (4, "A two")], starts)
    assert done == [(1, 3, "A one\n more\n end")] and kept == (4, 4, "A two")
    assert incremental.fold_lines(kept, [], starts) == (kept, [])
