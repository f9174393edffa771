"""Queries of candidate pairs, relationships, components and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.operators import correlation, results
from lumenlog.operators.correlation import EQUALITY, STRENGTH, STRUCTURAL, WEIGHTS
from lumenlog.operators.graph import connected_components
from lumenlog.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_TEXTS = ("trace_id", "request_id", "span_id", "parent_span_id", "service", "module", "host", "pod", "endpoint", "event_type", "fingerprint", "source_format", "resolved_identity", "severity")
_ROWS = f"""w(fmt, sig, st) AS (VALUES {", ".join(f"('{f}', '{s}', CAST({STRENGTH[k]} AS DOUBLE))" for f, w in WEIGHTS.items() for s, k in w.items())}),
r AS (SELECT id, analysis_id, artifact_id, first_seen, http_status, CAST(NULL AS VARCHAR) AS container, {", ".join(f"nullif({c}, '') AS {c}" for c in _TEXTS)} FROM evidence)"""
_IDENTITY = """k AS (SELECT analysis_id, id, first_seen, kind, key FROM (UNPIVOT (SELECT analysis_id, id, first_seen, trace_id, request_id, resolved_identity, span_id FROM r) ON trace_id, request_id, resolved_identity, span_id INTO NAME kind VALUE key)),
kp AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, kind, key ORDER BY first_seen NULLS FIRST, id) AS pos, count(*) OVER (PARTITION BY analysis_id, kind, key) AS n FROM k),
ident AS (SELECT DISTINCT l.analysis_id, least(l.id, r2.id) AS lo, greatest(l.id, r2.id) AS hi FROM kp l JOIN kp r2 ON l.analysis_id = r2.analysis_id AND l.kind = r2.kind AND l.key = r2.key AND r2.pos > l.pos AND r2.pos - l.pos <= CASE WHEN l.n <= 128 THEN l.n ELSE 32 END)"""
_PARENT = """par AS (SELECT c.analysis_id, c.id AS child, arg_min(p.id, row(p.first_seen IS NOT NULL, p.first_seen, p.id)) AS parent FROM r p JOIN r c ON p.analysis_id = c.analysis_id AND p.span_id = c.parent_span_id AND p.id <> c.id
 AND (p.trace_id IS NULL OR c.trace_id IS NULL OR p.trace_id = c.trace_id) JOIN w wp ON wp.fmt = p.source_format AND wp.sig = 'PARENT_SPAN' JOIN w wc ON wc.fmt = c.source_format AND wc.sig = 'PARENT_SPAN' GROUP BY 1, 2)"""


def _signal_rows(pairs: str, order: str) -> str:
    """SQL rows (source, target, sig, st) of the signals that the pairs share."""
    same = [f"SELECT p.source, p.target, '{s}' AS sig FROM {pairs} p JOIN r a ON a.id = p.source JOIN r b ON b.id = p.target WHERE a.{c} = b.{c}" for s, c in EQUALITY.items()]
    same.append(f"SELECT p.source, p.target, 'RESOLVED_IDENTITY' AS sig FROM {pairs} p JOIN r a ON a.id = p.source JOIN r b ON b.id = p.target WHERE a.resolved_identity = b.resolved_identity AND NOT coalesce(a.trace_id = b.trace_id, false) AND NOT coalesce(a.request_id = b.request_id, false)")
    same.append(f"SELECT p.source, p.target, 'HTTP_STATUS' AS sig FROM {pairs} p JOIN r a ON a.id = p.source JOIN r b ON b.id = p.target WHERE a.http_status = b.http_status AND a.http_status >= 400")
    same.append(f"SELECT p.source, p.target, 'PARENT_SPAN' AS sig FROM {pairs} p JOIN r a ON a.id = p.source JOIN r b ON b.id = p.target WHERE a.span_id = b.parent_span_id AND coalesce(a.trace_id = b.trace_id, true)")
    return f"{order}0 AS ({' UNION ALL '.join(same)}), {order} AS (SELECT s.source, s.target, s.sig, least(wa.st, wb.st) AS st FROM {order}0 s JOIN r a ON a.id = s.source JOIN r b ON b.id = s.target JOIN w wa ON wa.fmt = a.source_format AND wa.sig = s.sig JOIN w wb ON wb.fmt = b.source_format AND wb.sig = s.sig)"


_STRUCT = ", ".join(f"'{s}'" for s in STRUCTURAL)
_TEMPORAL = f"""tp AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY first_seen, id) AS pos FROM r WHERE first_seen IS NOT NULL),
cand AS (SELECT l.analysis_id, l.id AS source, t.id AS target, date_diff('microsecond', l.first_seen, t.first_seen) / 1000.0 AS delta, l.artifact_id = t.artifact_id AS same FROM tp l JOIN tp t ON l.analysis_id = t.analysis_id AND t.pos - l.pos BETWEEN 1 AND 40
 WHERE date_diff('microsecond', l.first_seen, t.first_seen) <= 5000000 AND NOT coalesce(l.trace_id = t.trace_id, false) AND NOT coalesce(l.request_id = t.request_id, false) AND NOT coalesce(l.resolved_identity = t.resolved_identity, false) AND NOT coalesce(l.span_id = t.span_id, false)),
{_signal_rows("cand", "cs")},
temp AS (SELECT DISTINCT c.analysis_id, least(c.source, c.target) AS lo, greatest(c.source, c.target) AS hi FROM cand c JOIN (SELECT source, target, max(st) AS top, count(*) AS n FROM cs WHERE sig IN ({_STRUCT}) GROUP BY 1, 2) g ON g.source = c.source AND g.target = c.target
 WHERE c.delta <= CASE WHEN g.top >= 0.85 THEN 5000 WHEN g.top >= 0.60 THEN 2500 ELSE 1000 END AND g.n >= CASE WHEN coalesce(c.same, false) THEN 1 ELSE 2 END)"""


@query(f"WITH {_ROWS}, {_IDENTITY} SELECT * FROM ident")
def identity_pairs(spark, d):
    return correlation.identity_pairs(correlation.prepare(table(spark, d, "evidence")))


@query(f"WITH {_ROWS}, {_PARENT} SELECT analysis_id, parent, child FROM par")
def parent_pairs(spark, d):
    return correlation.parent_pairs(correlation.prepare(table(spark, d, "evidence")))


@query(f"WITH {_ROWS}, {_TEMPORAL} SELECT * FROM temp")
def temporal_pairs(spark, d):
    return correlation.temporal_pairs(correlation.prepare(table(spark, d, "evidence")))


_EDGES = f"""{_ROWS}, {_IDENTITY}, {_PARENT}, {_TEMPORAL},
ex AS (SELECT analysis_id, lo, hi, arg_min(source, target) AS source, min(target) AS target FROM (SELECT analysis_id, least(parent, child) AS lo, greatest(parent, child) AS hi, parent AS source, child AS target FROM par) GROUP BY 1, 2, 3),
oth AS (SELECT * FROM (SELECT * FROM ident UNION SELECT * FROM temp) u WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.analysis_id = u.analysis_id AND ex.lo = u.lo AND ex.hi = u.hi)),
pr AS (SELECT analysis_id, source, target, true AS explicit FROM ex UNION ALL SELECT o.analysis_id, CASE WHEN coalesce(b.first_seen < a.first_seen, false) THEN hi ELSE lo END, CASE WHEN coalesce(b.first_seen < a.first_seen, false) THEN lo ELSE hi END, false FROM oth o JOIN r a ON a.id = o.lo JOIN r b ON b.id = o.hi),
{_signal_rows("pr", "ps")},
sc AS (SELECT p.*, date_diff('microsecond', a.first_seen, b.first_seen) / 1000.0 AS delta_ms, coalesce(g.miss, 1.0) AS miss, coalesce(g.n, 0) AS n FROM pr p JOIN r a ON a.id = p.source JOIN r b ON b.id = p.target LEFT JOIN (SELECT source, target, product(1 - st) AS miss, count(*) AS n FROM ps GROUP BY 1, 2) g ON g.source = p.source AND g.target = p.target),
edges AS (SELECT analysis_id, source, target, 1 - miss * (1 - CASE WHEN delta_ms >= 0 THEN 0.3 / (1 + delta_ms / 1000) ELSE 0 END) AS score, delta_ms, n + CASE WHEN delta_ms >= 0 THEN 1 ELSE 0 END AS n_signals,
 CASE WHEN explicit THEN 'explicit_parent_child' WHEN delta_ms > 0 THEN 'inferred_propagation' END AS relationship_type, CASE WHEN explicit THEN 1.0 WHEN delta_ms > 0 THEN 1 / (1 + delta_ms / 1000) END AS direction_confidence FROM sc WHERE n > 0 OR delta_ms >= 0)"""


@query(f"WITH {_EDGES} SELECT analysis_id, source, target, round(CAST(score AS DOUBLE), 6) AS score, round(CAST(delta_ms AS DOUBLE), 3) AS delta_ms, CAST(n_signals AS BIGINT) AS n_signals, relationship_type, round(CAST(direction_confidence AS DOUBLE), 6) AS direction_confidence FROM edges WHERE score > 0")
def relationships(spark, d):
    e = correlation.relationships(table(spark, d, "evidence"))
    return e.select("analysis_id", "source", "target", F.round("score", 6).alias("score"), F.round("delta_ms", 3).alias("delta_ms"), F.size("signals").cast("bigint").alias("n_signals"), "relationship_type", F.round("direction_confidence", 6).alias("direction_confidence"))


@query(f"""WITH RECURSIVE {_EDGES}, e2 AS (SELECT source AS u, target AS v FROM edges WHERE score > 0 UNION SELECT target, source FROM edges WHERE score > 0),
reach(u, v) AS (SELECT u, u FROM e2 UNION SELECT reach.u, e2.v FROM reach JOIN e2 ON e2.u = reach.v) SELECT min(v) AS component, u AS member FROM reach GROUP BY u""")
def relationship_components(spark, d):
    e = correlation.relationships(table(spark, d, "evidence"))
    return connected_components(e, "source", "target")


@query()
def ranked_causes(spark, d):
    return correlation.ranked_causes(table(spark, d, "evidence"))


@query()
def primary_components(spark, d):
    e = table(spark, d, "evidence")
    return results.primary_components(correlation.ranked_causes(e), e)


@query()
def component_timeline(spark, d):
    """Nodes of each component in order of time, missing times last, then by their text id."""
    n = correlation.ranked_causes(table(spark, d, "evidence"))
    entry = F.struct(F.col("relative_ms").isNull().alias("missing"), "relative_ms", F.concat(F.lit("evidence-"), F.col("id").cast("string")).alias("node_id"), "role")
    return n.groupBy("analysis_id", "component").agg(F.array_sort(F.collect_list(entry)).alias("timeline"))


@query("""SELECT analysis_id, count(*) AS edges, CAST(sum(CASE WHEN relationship_type IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS associations, round(avg(score), 6) AS mean_score FROM correlation_edges GROUP BY 1""")
def edge_summary(spark, d):
    return table(spark, d, "correlation_edges").groupBy("analysis_id").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.when(F.col("relationship_type").isNull(), 1).otherwise(0)).alias("associations"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("""WITH e AS (SELECT lower(trim(source_id)) AS s, lower(trim(target_id)) AS t, score FROM correlation_edges WHERE nullif(trim(source_id), '') IS NOT NULL AND nullif(trim(target_id), '') IS NOT NULL)
SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming, round(sum(coalesce(w, 0)), 6) AS out_strength FROM (SELECT s AS node, 1 AS o, 0 AS i, score AS w FROM e UNION ALL SELECT t, 0, 1, NULL FROM e) GROUP BY 1""")
def edge_degrees(spark, d):
    norm = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    e = table(spark, d, "correlation_edges").select(norm("source_id").alias("s"), norm("target_id").alias("t"), "score").filter("s is not null and t is not null")
    both = e.select(F.col("s").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("score").alias("w")).union(e.select("t", F.lit(0), F.lit(1), F.lit(None).cast("double")))
    return both.groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.round(F.sum(F.coalesce("w", F.lit(0.0))), 6).alias("out_strength"))
