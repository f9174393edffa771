import datetime as dt

import pytest

from lumenlog.operators import correlation, graph

SCHEMA = "id bigint, analysis_id int, artifact_id int, fingerprint string, event_type string, severity string, trace_id string, request_id string, span_id string, parent_span_id string, service string, endpoint string, http_status int, source_format string, first_seen timestamp_ntz, resolved_identity string"
T0 = dt.datetime(2026, 1, 1)
FIELDS = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]


def rows(spark, *given):
    out = []
    for k, g in enumerate(given, 1):
        base = {"id": k, "analysis_id": 1, "artifact_id": 1, "fingerprint": f"fp-{k}", "event_type": "error", "severity": "ERROR", "source_format": "generic"}
        out.append(tuple((base | g).get(f) for f in FIELDS))
    return spark.createDataFrame(out, SCHEMA)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def test_propagation_chain(spark):
    e = rows(spark, {"trace_id": "t", "source_format": "database", "first_seen": at(0)}, {"trace_id": "t", "source_format": "opentelemetry", "first_seen": at(100)}, {"trace_id": "t", "source_format": "web_server", "http_status": 500, "first_seen": at(250)})
    got = {r["id"]: r for r in correlation.ranked_causes(e).collect()}
    assert [got[k]["role"] for k in (1, 2, 3)] == ["root", "propagation", "victim"]
    assert {r["component"] for r in got.values()} == {1} and got[1]["cause_rank"] == 1 and got[1]["downstream"] == 2


def test_parent_link_beats_time_and_conflicting_traces_do_not_link(spark):
    e = rows(spark, {"span_id": "p", "trace_id": "a", "first_seen": at(500)}, {"parent_span_id": "p", "trace_id": "a", "first_seen": at(0), "event_type": None}, {"parent_span_id": "p", "trace_id": "b", "first_seen": at(9e6)})
    got = correlation.relationships(e).filter("relationship_type = 'explicit_parent_child'").collect()
    assert [(r["source"], r["target"], r["direction_confidence"]) for r in got] == [(1, 2, 1.0)]


def test_equal_times_give_an_association(spark):
    e = rows(spark, {"trace_id": "t", "first_seen": at(0)}, {"trace_id": "t", "first_seen": at(0)})
    assert [r["relationship_type"] for r in correlation.relationships(e).collect()] == [None]


def test_time_alone_is_not_enough(spark):
    e = rows(spark, {"first_seen": at(0), "event_type": "a"}, {"first_seen": at(2000), "event_type": "b"})
    assert correlation.relationships(e).count() == 0


def test_recurrence_beyond_the_window(spark):
    e = rows(spark, *({"fingerprint": "f", "service": "s", "first_seen": at(k * 1_200_000)} for k in range(3)))
    assert correlation.relationships(e).count() == 0


@pytest.mark.parametrize(("n", "want"), [(5, 10), (128, 128 * 127 // 2), (200, 200 * 32 - 32 * 33 // 2)])
def test_identity_groups_are_bounded(spark, n, want):
    e = rows(spark, *({"trace_id": "t", "first_seen": at(k)} for k in range(n)))
    assert correlation.identity_pairs(correlation.prepare(e)).count() == want


def test_order_of_input_does_not_matter(spark):
    e = rows(spark, *({"trace_id": f"t{k % 3}", "service": "s", "first_seen": at(k * 300)} for k in range(30)))
    a = {tuple(r) for r in correlation.relationships(e).drop("signals").collect()}
    assert a == {tuple(r) for r in correlation.relationships(e.orderBy("first_seen", ascending=False).repartition(7)).drop("signals").collect()}


def test_blank_and_missing_values_never_match(spark):
    e = rows(spark, {"trace_id": "", "first_seen": None}, {"trace_id": "", "first_seen": None}, {"trace_id": None, "first_seen": at(1)})
    assert correlation.relationships(e).count() == 0
    assert correlation.relationships(e.limit(0)).count() == 0


def test_loops_are_cut_by_score():
    assert graph.acyclic([(1, 2, 0.5, True), (2, 3, 0.9, False), (3, 1, 0.8, False)]) == {0, 1}


def test_descendants():
    assert graph.descendants([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)]) == {1: 4, 2: 2, 3: 2, 4: 1, 5: 0}


def test_large_components_count_the_same(spark):
    edges = spark.createDataFrame([(a, b, 1) for a, b in [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)]], "source bigint, target bigint, component bigint")
    small = {r["id"]: r["downstream"] for r in graph.reachable_counts(edges).collect() if r["downstream"]}
    assert small == {r["id"]: r["downstream"] for r in graph.reachable_counts(edges, limit=1).collect()}


def test_ranks_of_large_groups(spark):
    from pyspark.sql import functions as F

    from lumenlog.operators.ranking import position

    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    a = {tuple(r) for r in position(df, ["k"], [F.col("v")], size="n").collect()}
    assert a == {tuple(r) for r in position(df, ["k"], [F.col("v")], size="n", limit=10).collect()}


def test_loops_in_tables(spark):
    rows = [(1, 2, 0.5, 3.0), (2, 3, 0.9, -1.0), (3, 1, 0.8, None), (4, 5, 0.1, -2.0), (6, 7, 0.2, 1.0)]
    edges = spark.createDataFrame(rows, "source bigint, target bigint, score double, delta_ms double")
    label = graph.connected_components(edges, "source", "target")
    want = {(1, 2), (2, 3), (4, 5), (6, 7)}
    assert {(r["source"], r["target"]) for r in graph.dag_edges(edges, label).collect()} == want
    assert {(r["source"], r["target"]) for r in graph.dag_edges(edges, label, limit=1).collect()} == want
