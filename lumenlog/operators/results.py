"""Statuses, contexts and nested result documents of an investigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenlog.operators.ranking import position


def iso(c: Column) -> Column:
    """ISO text of a time; microseconds are left out where they are zero."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(c, "SSSSSS")
    return F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part))


def primary_components(ranked: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(analysis_id, component, artifacts, nodes): most artifacts, then most nodes, then the smallest id.

    ranked: rows of ``ranked_causes``; artifacts: (id, artifact_id). An
    analysis whose components are all single nodes has none.
    """
    n = ranked.select("analysis_id", "id", "component").join(artifacts.select("id", "artifact_id"), "id")
    c = n.groupBy("analysis_id", "component").agg(F.countDistinct("artifact_id").alias("artifacts"), F.count(F.lit(1)).alias("nodes"))
    best = F.max(F.struct("artifacts", "nodes", (-F.col("component")).alias("k")))
    return c.groupBy("analysis_id").agg(best.alias("b")).filter("b.nodes > 1").select("analysis_id", (-F.col("b.k")).alias("component"), "b.artifacts", "b.nodes")


def artifact_statuses(ranked: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(analysis_id, artifact_id, nodes, linked_nodes, status).

    status is linked, partially_linked or not_linked by how many of the
    artifact's nodes lie in the primary component; NULL where the analysis
    has none.
    """
    main = primary_components(ranked, artifacts).select("analysis_id", F.col("component").alias("main"))
    n = ranked.select("analysis_id", "id", "component").join(artifacts.select("id", "artifact_id"), "id").join(main, "analysis_id", "left")
    g = n.groupBy("analysis_id", "artifact_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("component") == F.col("main")).alias("linked_nodes"), F.max("main").alias("main"))
    status = F.when(F.col("main").isNull(), F.lit(None).cast("string")).when(F.col("linked_nodes") == F.col("nodes"), "linked").when(F.col("linked_nodes") > 0, "partially_linked").otherwise("not_linked")
    return g.select("analysis_id", "artifact_id", "nodes", "linked_nodes", status.alias("status"))


def top_causes(ranked: DataFrame, *, per_component: int = 3) -> DataFrame:
    """The best ranked rows of every component with more than one node."""
    return ranked.filter((F.col("size") > 1) & (F.col("cause_rank") <= per_component))


def fitting_components(ranked: DataFrame, evidence: DataFrame, *, size: int = 3 * 1024 * 1024) -> DataFrame:
    """(analysis_id, component, bytes, running): components in order of size until the budget of bytes is spent.

    The first component is kept whatever its size.
    """
    text = evidence.select("id", F.coalesce(F.octet_length("representative_line"), F.lit(0)).alias("_b"))
    c = ranked.join(text, "id").groupBy("analysis_id", "component").agg(F.count(F.lit(1)).alias("nodes"), F.sum("_b").alias("bytes"))
    ranked_c = position(c, ["analysis_id"], [F.col("nodes").desc(), F.col("component")], name="place")
    running = F.sum("bytes").over(Window.partitionBy("analysis_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked_c.withColumn("running", running).filter((F.col("running") <= size) | (F.col("place") == 1)).drop("place")


def evidence_struct() -> Column:
    """One evidence row as it is given out."""
    return F.struct(
        F.concat(F.lit("evidence-"), F.col("id").cast("string")).alias("id"), "artifact_id", "event_type", "severity", "service", "module", "host", "endpoint", "http_status", "trace_id", "request_id", "span_id", "fingerprint", "occurrence_count",
        iso(F.col("first_seen")).alias("first_seen"), iso(F.col("last_seen")).alias("last_seen"), F.col("representative_line").alias("line"),
    )


def component_documents(ranked: DataFrame, evidence: DataFrame, related: DataFrame) -> DataFrame:
    """(analysis_id, component, document): each component as one JSON document with nodes, edges and timeline."""
    rows = ranked.drop("analysis_id").join(evidence, "id")
    node = F.struct("cause_rank", "role", F.round("cause_score", 4).alias("score"), evidence_struct().alias("evidence"))
    nodes = rows.groupBy("analysis_id", "component").agg(F.array_sort(F.collect_list(node)).alias("nodes"), F.array_sort(F.collect_list(F.struct(F.col("relative_ms").isNull().alias("untimed"), "relative_ms", F.concat(F.lit("evidence-"), F.col("id").cast("string")).alias("node")))).alias("timeline"))
    label = ranked.select(F.col("id").alias("source"), "component")
    edge = F.struct("source", "target", F.round("score", 4).alias("score"), "delta_ms", "relationship_type")
    edges = related.join(label, "source").groupBy("component").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    d = nodes.join(edges, "component", "left")
    body = F.struct(F.concat(F.lit("component-"), F.col("component").cast("string")).alias("component"), "nodes", F.coalesce("edges", F.expr("array()").cast("array<struct<source:bigint,target:bigint,score:double,delta_ms:double,relationship_type:string>>")).alias("edges"), "timeline")
    return d.select("analysis_id", "component", F.to_json(body).alias("document"))


def simple_documents(selected: DataFrame, evidence: DataFrame) -> DataFrame:
    """(analysis_id, document): the selected evidence of an analysis in order of time, with counts."""
    total = evidence.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("total"))
    rows = evidence.join(selected.select("id"), "id", "left_semi")
    item = F.struct(F.col("first_seen").isNotNull().alias("timed"), F.col("first_seen").alias("at"), F.col("id").alias("k"), evidence_struct().alias("e"))
    g = rows.groupBy("analysis_id").agg(F.array_sort(F.collect_list(item)).alias("i")).join(total, "analysis_id")
    listed = F.transform("i", lambda x: x["e"])
    body = F.struct(F.col("total").alias("evidence_count"), F.size("i").alias("returned"), (F.size("i") < F.col("total")).alias("truncated"), listed.alias("evidence"))
    return g.select("analysis_id", F.to_json(body).alias("document"))


def fallback_contexts(texts: DataFrame, *, each: int = 64 * 1024, together: int = 256 * 1024) -> DataFrame:
    """(analysis_id, artifact_id, excerpt): excerpts of unstructured artifacts within a budget of bytes.

    Artifacts come in order of their id; the first is always given, later ones
    while the sum stays within the budget.
    """
    from lumenlog.operators.rollup import bounded_bytes

    rows = texts.select("analysis_id", "artifact_id", bounded_bytes(F.col("text"), each).alias("excerpt")).filter("excerpt is not null and excerpt <> ''")
    w = Window.partitionBy("analysis_id").orderBy("artifact_id")
    rows = rows.withColumns({"_s": F.sum(F.octet_length("excerpt")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_n": F.row_number().over(w)})
    return rows.filter((F.col("_s") <= together) | (F.col("_n") == 1)).select("analysis_id", "artifact_id", "excerpt")
