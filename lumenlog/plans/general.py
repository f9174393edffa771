"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.operators import hierarchy, loglines, nested, times
from lumenlog.session import table


def zones(spark, d):
    """One valid zone per host, UTC where none is given; the table has one row per host of the fleet."""
    clocks = table(spark, d, "host_clocks").groupBy("host").agg(F.max("tz_name").alias("tz_name"))
    return clocks.select("host", F.coalesce(times.known_zone(F.col("tz_name")), F.lit("UTC")).alias("tz_name"))


def all_times(spark, d):
    """Every raw time of the four sources with its normal form."""
    none = F.lit(None).cast("string")
    shape = ["src", "rec_key", "raw", "host", "who", "received_at"]
    parsed = table(spark, d, "parsed_events").select(F.lit("parsed").alias("src"), F.col("event_id").cast("string").alias("rec_key"), F.col("timestamp_raw").alias("raw"), "host", F.col("service").alias("who"), "received_at")
    docker = table(spark, d, "docker_logs").select(F.lit("docker").alias("src"), F.col("log_id").cast("string").alias("rec_key"), F.col("time_raw").alias("raw"), none.alias("host"), F.col("container_id").alias("who"), "received_at")
    arrived = times.from_micros(F.col("ingestion_time") * 1000)
    cloud = table(spark, d, "cloudwatch_logs").select(F.lit("cloudwatch").alias("src"), F.col("row_id").cast("string").alias("rec_key"), F.col("timestamp_raw").alias("raw"), none.alias("host"), F.col("log_group").alias("who"), arrived.alias("received_at"))
    exports = table(spark, d, "otlp_exports")
    nodes = nested.flatten(exports.select("export_id", "payload"), "export_id", "payload", tables=[nested.RECORDS])
    otlp = nodes.select(F.lit("otlp").alias("src"), F.concat_ws("/", F.col("doc").cast("string"), F.array_join("positions", "/")).alias("rec_key"), F.try_element_at("scalars", F.lit("timeUnixNano")).alias("raw"), none.alias("host"), F.lit("otlp").alias("who"), F.lit(None).cast("timestamp_ntz").alias("received_at"))
    every = parsed.select(shape).unionByName(docker.select(shape)).unionByName(cloud.select(shape)).unionByName(otlp.select(shape))
    every = every.join(zones(spark, d), "host", "left")
    return times.normalise_times(every, value="raw", source=F.concat_ws("/", "src", "who"), host_zone=F.col("tz_name"), received="received_at")


def p3_doubts(spark, d):
    """How many times of each source have which doubt, and how many are read as what."""
    t = all_times(spark, d).filter("utc_us is not null")
    return t.groupBy("src", "layout", "meaning", "doubt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ambiguous").cast("int")).alias("ambiguous"))


def p3_found(spark, d):
    return all_times(spark, d).filter("utc_us is not null").select("src", "rec_key", "utc_us")


def p5_found(spark, d):
    return nested.records_with_resource_keys(table(spark, d, "otlp_exports"))


def _spans(spark, d):
    return table(spark, d, "evidence").select("trace_id", "span_id", "parent_span_id")


def p6_found(spark, d):
    return hierarchy.roots(_spans(spark, d))


def p6_hierarchies(spark, d):
    return hierarchy.hierarchies(_spans(spark, d))


def p6_descendants(spark, d):
    return hierarchy.descendants(_spans(spark, d))


def p7_found(spark, d):
    return loglines.parse_entries(table(spark, d, "raw_lines"), stating=True).select("artifact_id", "first_line", "last_line", "level", "component")


QUERIES = {"p3_found": p3_found, "p3_doubts": p3_doubts, "p5_found": p5_found, "p6_found": p6_found, "p6_hierarchies": p6_hierarchies, "p6_descendants": p6_descendants, "p7_found": p7_found}

_SPANS = """WITH RECURSIVE ids AS (SELECT lower(trim(trace_id)) AS t, lower(trim(span_id)) AS s, lower(trim(parent_span_id)) AS p FROM evidence WHERE nullif(trim(trace_id), '') IS NOT NULL AND nullif(trim(span_id), '') IS NOT NULL),
n AS (SELECT DISTINCT t, s FROM ids), l AS (SELECT n.t, n.s, min(k.p) AS p FROM n LEFT JOIN (SELECT i.* FROM ids i JOIN n q ON q.t = i.t AND q.s = i.p WHERE regexp_matches(i.p, '[^0-]')) k ON k.t = n.t AND k.s = n.s GROUP BY 1, 2),
down(t, s, root, depth) AS (SELECT t, s, s, 0 FROM l WHERE p IS NULL UNION ALL SELECT l.t, l.s, d.root, d.depth + 1 FROM down d JOIN l ON l.t = d.t AND l.p = d.s)
SELECT l.t AS trace_id, l.s AS span_id, coalesce(d.root, '') AS root_span_id, CAST(coalesce(d.depth, -1) AS INTEGER) AS depth FROM l LEFT JOIN down d ON d.t = l.t AND d.s = l.s"""
_either = lambda j, a, b: f"coalesce(nullif(json_extract({j}, '$.{a}'), 'null'), nullif(json_extract({j}, '$.{b}'), 'null'))"
_items = lambda j: f"CASE WHEN json_type({j}) = 'ARRAY' THEN from_json({j}, '[\"JSON\"]') ELSE [] END"
_text = lambda j, a, b: f"coalesce(json_extract_string({j}, '$.{a}'), json_extract_string({j}, '$.{b}'), '')"
_RECORDS = f"""WITH p AS (SELECT export_id, ltrim(payload, chr(65279)) AS j FROM otlp_exports), d AS (SELECT export_id, CASE WHEN json_valid(j) THEN CASE WHEN json_type(j) = 'VARCHAR' THEN CAST(json_extract_string(j, '$') AS JSON) ELSE CAST(j AS JSON) END END AS j FROM p),
r0 AS (SELECT export_id, {_items(_either("j", "resourceLogs", "resource_logs"))} AS a FROM d), r AS (SELECT export_id, unnest(a) AS j, generate_subscripts(a, 1) - 1 AS res_pos FROM r0),
k AS (SELECT DISTINCT export_id, res_pos, json_extract_string(x, '$.key') AS attr_key FROM (SELECT export_id, res_pos, unnest({_items("json_extract(j, '$.resource.attributes')")}) AS x FROM r) WHERE nullif(json_extract_string(x, '$.key'), '') IS NOT NULL),
s0 AS (SELECT export_id, res_pos, {_items(_either("j", "scopeLogs", "scope_logs"))} AS a FROM r), s AS (SELECT export_id, res_pos, unnest(a) AS j, generate_subscripts(a, 1) - 1 AS scope_pos FROM s0),
l0 AS (SELECT export_id, res_pos, scope_pos, {_items(_either("j", "logRecords", "log_records"))} AS a FROM s), l AS (SELECT export_id, res_pos, scope_pos, unnest(a) AS j, generate_subscripts(a, 1) - 1 AS rec_pos FROM l0)
SELECT l.export_id, CAST(l.res_pos AS INTEGER) AS res_pos, CAST(scope_pos AS INTEGER) AS scope_pos, CAST(rec_pos AS INTEGER) AS rec_pos, {_text("l.j", "traceId", "trace_id")} AS trace_id, {_text("l.j", "spanId", "span_id")} AS span_id, coalesce(k.attr_key, '') AS attr_key
FROM l LEFT JOIN k ON k.export_id = l.export_id AND k.res_pos = l.res_pos WHERE json_type(l.j) = 'OBJECT'"""
ORACLES: dict[str, str] = {"p5_found": _RECORDS, "p6_found": _SPANS}
