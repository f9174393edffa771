"""Queries of format detection, field extraction and the per-format heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions import detect, events
from lumenlog.functions.text import first_level, normalize_message
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


def _marks(c: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(c, m.replace("'", "''")) for m in marks) + ")"


def _re(pattern: str) -> str:
    """The same pattern for the other engine: flags for lines, no terminator flag."""
    return pattern.replace("(?md)", "(?m)").replace("(?mdi)", "(?mi)").replace("'", "''")


_DETECT_SQL = f"""WITH s AS (SELECT event_id, raw_line AS t, lower(raw_line) AS l, regexp_replace(lower(raw_line), '\\s+', '', 'g') AS c, regexp_extract(lower(f.original_filename), '(\\.[^./]+)$', 1) AS suffix,
  (regexp_matches(ltrim(raw_line), '^[{{\\[]') AND (json_valid(trim(regexp_extract(ltrim(raw_line), '^\\s*([^\\n\\r]+)', 1))) OR regexp_matches(ltrim(raw_line), '{_re(detect.JSON_HEAD)}'))) AS j
  FROM parsed_events LEFT JOIN (SELECT id AS aid, original_filename FROM analysis_artifacts) f ON f.aid = artifact_id)
SELECT event_id, CASE WHEN suffix IN ('.png', '.jpg', '.jpeg', '.webp') THEN 'image' WHEN j AND {_marks("c", detect.OTLP_MARKS)} THEN 'opentelemetry'
 WHEN j AND (contains(c, '"kubernetes":') OR (contains(c, '"log":') AND (contains(c, '"stream":') OR contains(c, '"container_id":')))) THEN 'container'
 WHEN j AND contains(c, '"entries":') AND (contains(l, '"starteddatetime"') OR contains(c, '"request":')) THEN 'browser'
 WHEN regexp_matches(t, '{_re(detect.SYSLOG)}') THEN 'syslog' WHEN regexp_matches(t, '{_re(detect.CRI)}') THEN 'container'
 WHEN regexp_matches(t, '{_re(detect.ACCESS)}') OR regexp_matches(t, '{_re(detect.NGINX)}') OR regexp_matches(t, '{_re(detect.APACHE)}') THEN 'web_server'
 WHEN {_marks("l", detect.STACK_MARKS)} OR regexp_matches(t, '{_re(detect.FRAME)}') THEN 'stack_trace' WHEN {_marks("l", detect.CI_MARKS)} THEN 'ci_cd' WHEN {_marks("l", detect.DATABASE_MARKS)} THEN 'database'
 WHEN {_marks("l", detect.BROKER_MARKS)} THEN 'message_broker' WHEN {_marks("t", detect.LAMBDA_MARKS)} OR (j AND contains(c, '"awsrequestid":')) OR (j AND {_marks("c", detect.LAMBDA_JSON_MARKS)}) THEN 'serverless'
 WHEN {_marks("l", detect.GATEWAY_MARKS)} OR (j AND (contains(c, '"requestcontext":') OR contains(c, '"elb_status_code":'))) OR regexp_matches(t, '{_re(detect.BALANCER)}') THEN 'cloud_gateway'
 WHEN j THEN 'json' WHEN suffix = '.har' AND regexp_matches(ltrim(t), '^[{{\\[]') THEN 'browser' ELSE 'generic' END AS detected FROM s"""


@query(_DETECT_SQL)
def format_detect(spark, d):
    names = table(spark, d, "analysis_artifacts").select(F.col("id").alias("artifact_id"), "original_filename")
    e = table(spark, d, "parsed_events").select("event_id", "artifact_id", "raw_line").join(names, "artifact_id", "left")
    return e.select("event_id", detect.detect_format(F.col("raw_line"), F.col("original_filename")).alias("detected"))


@query("SELECT artifact_id, count(*) AS lines, CAST(sum(CASE WHEN regexp_matches(raw_line, '^\\d{4}-\\d{2}-\\d{2}T\\S+\\s+(stdout|stderr)\\s+[FP]\\s') THEN 1 ELSE 0 END) AS BIGINT) AS cri_lines, CAST(sum(CASE WHEN regexp_matches(raw_line, '^<\\d{1,3}>') THEN 1 ELSE 0 END) AS BIGINT) AS syslog_lines FROM raw_lines GROUP BY 1")
def layout_counts(spark, d):
    c = F.col("raw_line")
    n = lambda p: F.sum(F.when(c.rlike(p), 1).otherwise(0))
    return table(spark, d, "raw_lines").groupBy("artifact_id").agg(F.count(F.lit(1)).alias("lines"), n(r"^\d{4}-\d{2}-\d{2}T\S+\s+(stdout|stderr)\s+[FP]\s").alias("cri_lines"), n(r"^<\d{1,3}>").alias("syslog_lines"))


@query()
def field_extract(spark, d):
    f = table(spark, d, "parsed_events").select("event_id", F.explode(F.array(events.fields(F.col("raw_line")))).alias("f"))
    return f.select("event_id", *(F.col(f"f.{c}").alias(c) for c in ("trace_id", "service", "module", "host", "request_id", "http_status")))


_EXC = "\\b([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception|Failure))\\b"


@query(f"SELECT event_id, regexp_extract(nullif(regexp_extract(raw_line, '{_EXC}', 1), ''), '([^.]+)$', 1) AS exception_type FROM parsed_events WHERE NOT contains(raw_line, chr(10))")
def exception_extract(spark, d):
    e = table(spark, d, "parsed_events").filter(~F.col("raw_line").contains("\n"))
    return e.select("event_id", events.exception_type(F.col("raw_line")).alias("exception_type"))


@query(f"SELECT event_id, regexp_extract(list_extract(regexp_extract_all(raw_line, '{_EXC}', 1), -1), '([^.]+)$', 1) AS exception_type FROM parsed_events WHERE contains(raw_line, chr(10))")
def exception_extract_multiline(spark, d):
    e = table(spark, d, "parsed_events").filter(F.col("raw_line").contains("\n"))
    return e.select("event_id", events.exception_type(F.col("raw_line"), F.lit(True)).alias("exception_type"))


_LEVEL_ORACLE = "SELECT event_id, CASE upper(w) WHEN 'WARN' THEN 'WARNING' WHEN 'ERR' THEN 'ERROR' WHEN 'SEVERE' THEN 'CRITICAL' WHEN 'FATAL' THEN 'CRITICAL' WHEN 'ALERT' THEN 'CRITICAL' WHEN 'EMERG' THEN 'CRITICAL' WHEN 'EMERGENCY' THEN 'CRITICAL' WHEN 'NOTICE' THEN 'INFO' ELSE nullif(upper(w), '') END AS level_first FROM (SELECT event_id, regexp_extract(raw_line, '(?i)(?:^|[^A-Za-z])(TRACE|DEBUG|INFO|NOTICE|WARNING|WARN|ERROR|ERR|SEVERE|FATAL|CRITICAL|ALERT|EMERG(?:ENCY)?)(?:[^A-Za-z]|$)', 1) AS w FROM parsed_events)"


@query(_LEVEL_ORACLE)
def level_first_keyword(spark, d):
    return table(spark, d, "parsed_events").select("event_id", first_level(F.col("raw_line")).alias("level_first"))


@query("SELECT log_id, regexp_replace(lower(regexp_replace(regexp_replace(log, '\\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\b', '<uuid>', 'g'), '\\b\\d+\\b', '<number>', 'g')), '^\\s+|\\s+$', '', 'g') AS message FROM docker_logs")
def message_mask(spark, d):
    return table(spark, d, "docker_logs").select("log_id", normalize_message(F.col("log")).alias("message"))


@query("SELECT artifact_id, line_number, CASE CAST(p AS INT) % 8 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'WARNING' WHEN 5 THEN 'INFO' WHEN 6 THEN 'INFO' ELSE 'DEBUG' END AS level_syslog FROM (SELECT artifact_id, line_number, regexp_extract(raw_line, '^<(\\d{1,3})>', 1) AS p FROM raw_lines) WHERE p <> ''")
def syslog_priority(spark, d):
    p = table(spark, d, "raw_lines").select("artifact_id", "line_number", F.regexp_extract("raw_line", r"^<(\d{1,3})>", 1).alias("p")).filter("p <> ''")
    return p.select("artifact_id", "line_number", events.syslog_level(F.col("p").cast("int")).alias("level_syslog"))


@query("WITH l AS (SELECT DISTINCT artifact_id, line_number, regexp_extract(raw_line, '^(\\d{4}-\\d{2}-\\d{2}T\\S+)\\s+(stdout|stderr)\\s+([FP])\\s([\\s\\S]*)$', 2) AS stream, regexp_extract(raw_line, '^(\\d{4}-\\d{2}-\\d{2}T\\S+)\\s+(stdout|stderr)\\s+([FP])\\s([\\s\\S]*)$', 3) AS flag FROM raw_lines) SELECT artifact_id, line_number, stream, flag FROM l WHERE flag <> ''")
def cri_heads(spark, d):
    h = events.cri_line(F.col("raw_line"))
    return table(spark, d, "raw_lines").select("artifact_id", "line_number", h["stream"].alias("stream"), h["flag"].alias("flag")).filter("flag is not null").distinct()


@query("SELECT event_id, (contains(l, 'warn') OR contains(l, 'error') OR contains(l, 'err') OR contains(l, 'severe') OR contains(l, 'fatal') OR contains(l, 'critical') OR contains(l, 'alert') OR contains(l, 'emerg') OR contains(l, 'exception') OR contains(l, 'failure') OR contains(l, 'traceback') OR contains(l, 'panic:') OR contains(l, 'segmentation fault') OR contains(l, 'slow query')) AS marked FROM (SELECT event_id, lower(raw_line) AS l FROM parsed_events)")
def important_marks(spark, d):
    low = F.lower("raw_line")
    marked = F.lit(False)
    for m in events.IMPORTANT_MARKS:
        marked = marked | low.contains(m)
    return table(spark, d, "parsed_events").select("event_id", marked.alias("marked"))


@query("SELECT event_id, len(coalesce(stack_frames, [])) AS frames, stack_frames[1].file AS first_file, stack_frames[1].line_no AS first_line FROM parsed_events")
def stack_columns(spark, d):
    f = F.coalesce(F.size("stack_frames"), F.lit(0))
    one = F.try_element_at("stack_frames", F.lit(1))
    return table(spark, d, "parsed_events").select("event_id", F.when(F.col("stack_frames").isNull(), 0).otherwise(f).cast("bigint").alias("frames"), one["file"].alias("first_file"), one["line_no"].alias("first_line"))


@query()
def text_events(spark, d):
    """All canonical fields parsed again from the raw text."""
    e = events.text_event(table(spark, d, "parsed_events").select("event_id", "raw_line"), "raw_line")
    return e.withColumn("frames", F.size("stack_frames")).drop("raw_line", "stack_frames")


@query()
def endpoint_extract(spark, d):
    return table(spark, d, "parsed_events").select("event_id", events.endpoint(F.col("raw_line")).alias("endpoint_found"))
