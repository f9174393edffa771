"""Queries of retention, rollup, identity, selection, paging and progress."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lumenlog.functions.text import blank_to_null, fingerprint, level, level_of_status, otel_level, same_fingerprint, same_key
from lumenlog.operators import ranking, rollup
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


# SQL building blocks of the oracles
_T = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
LEVEL_SQL = """(CASE WHEN regexp_full_match({c}, '\\s*\\d{{1,18}}\\s*') THEN
  CASE WHEN CAST(trim({c}) AS BIGINT) >= 50 THEN 'CRITICAL' WHEN CAST(trim({c}) AS BIGINT) >= 40 THEN 'ERROR' WHEN CAST(trim({c}) AS BIGINT) >= 30 THEN 'WARNING' WHEN CAST(trim({c}) AS BIGINT) >= 20 THEN 'INFO' ELSE 'DEBUG' END
  ELSE nullif(CASE upper(trim({c})) WHEN 'WARN' THEN 'WARNING' WHEN 'ERR' THEN 'ERROR' WHEN 'SEVERE' THEN 'CRITICAL' WHEN 'FATAL' THEN 'CRITICAL' WHEN 'ALERT' THEN 'CRITICAL' WHEN 'EMERG' THEN 'CRITICAL' WHEN 'EMERGENCY' THEN 'CRITICAL' WHEN 'NOTICE' THEN 'INFO' ELSE upper(trim({c})) END, '') END)"""
UUID_SQL = "[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}"
MESSAGE_SQL = "regexp_replace(lower(regexp_replace(regexp_replace({c}, '\\b" + UUID_SQL + "\\b', '<uuid>', 'g'), '\\b\\d+\\b', '<number>', 'g')), '^\\s+|\\s+$', '', 'g')"
_BOUND = "CASE WHEN length({f}) <= 255 THEN {f} ELSE left({f}, 190) || ':' || sha256({f}) END"


def level_sql(c: str) -> str:
    return LEVEL_SQL.format(c=c)


def message_sql(c: str) -> str:
    return MESSAGE_SQL.format(c=c)


CANONICAL_SQL = f"""canonical AS (
 SELECT * EXCLUDE (level, trace_id, request_id, span_id, service, module, host, pod, endpoint, exception_type, exception_message, source_format),
  {level_sql("level")} AS level, {", ".join(f"nullif({c}, '') AS {c}" for c in "trace_id request_id span_id service module host pod endpoint exception_type exception_message source_format".split())}
 FROM parsed_events),
printed AS (SELECT *, CASE WHEN exception_type IS NOT NULL THEN lower(exception_type) || ':' || coalesce({message_sql("exception_message")}, '')
  ELSE coalesce(level, 'event') || ':' || {message_sql("raw_line")} END AS f0 FROM canonical),
events_ AS (SELECT *, {_BOUND.format(f="f0")} AS fingerprint FROM printed),
kept AS (SELECT * FROM events_ WHERE coalesce(level IN ('WARNING','WARN','ERROR','CRITICAL'), false) OR exception_type IS NOT NULL OR coalesce(len(stack_frames) > 0, false)
  OR coalesce(http_status >= 400, false) OR (coalesce(source_format = 'opentelemetry', false) AND (trace_id IS NOT NULL OR span_id IS NOT NULL)))"""


@query(f"SELECT event_id, {level_sql('level')} AS level_norm FROM parsed_events")
def level_alias(spark, d):
    return table(spark, d, "parsed_events").select("event_id", level(F.col("level")).alias("level_norm"))


@query("SELECT event_id, CASE WHEN http_status >= 500 THEN 'ERROR' WHEN http_status >= 400 THEN 'WARNING' WHEN http_status IS NOT NULL THEN 'INFO' END AS level_http FROM parsed_events")
def http_level(spark, d):
    return table(spark, d, "parsed_events").select("event_id", level_of_status(F.col("http_status")).alias("level_http"))


@query("SELECT id, CASE WHEN n <= 0 THEN NULL WHEN n >= 21 THEN 'CRITICAL' WHEN n >= 17 THEN 'ERROR' WHEN n >= 13 THEN 'WARNING' WHEN n >= 9 THEN 'INFO' WHEN n >= 5 THEN 'DEBUG' WHEN n IS NOT NULL THEN 'TRACE' END AS level_otel FROM (SELECT id, first_line_number % 25 AS n FROM evidence)")
def otel_severity(spark, d):
    return table(spark, d, "evidence").select("id", otel_level((F.col("first_line_number") % 25).cast("string")).alias("level_otel"))


@query(f"WITH {CANONICAL_SQL} SELECT event_id FROM kept")
def filter_retention(spark, d):
    return rollup.retained(table(spark, d, "parsed_events")).select("event_id")


@query(f"WITH {CANONICAL_SQL} SELECT event_id, fingerprint FROM events_")
def event_fingerprint(spark, d):
    return rollup.canonical_events(table(spark, d, "parsed_events")).select("event_id", "fingerprint")


@query(f"WITH f AS (SELECT doc_id, 'event:' || {message_sql('text')} AS f0 FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7f]')) SELECT doc_id, {_BOUND.format(f='f0')} AS fingerprint FROM f")
def fingerprint_long(spark, d):
    docs = table(spark, d, "documents").filter(~F.col("text").rlike(r"[^\x00-\x7f]"))
    none = F.lit(None).cast("string")
    return docs.select("doc_id", fingerprint(none, none, none, F.col("text")).alias("fingerprint"))


@query()
def document_fingerprints(spark, d):
    """Fingerprint of every document in any script; NULL for a NULL text. The SQL engine's \\b and \\d know ASCII only, so none is given."""
    none = F.lit(None).cast("string")
    return table(spark, d, "documents").select("doc_id", fingerprint(none, none, none, F.col("text")).alias("fingerprint"))


@query("SELECT event_id, sha256(concat_ws('|', coalesce(lower(nullif(trim(trace_id),'')), '__none__'), coalesce(lower(nullif(trim(request_id),'')), '__none__'), coalesce(lower(nullif(trim(span_id),'')), '__none__'))) AS correlation_key FROM parsed_events")
def correlation_key(spark, d):
    return table(spark, d, "parsed_events").select("event_id", same_key(F.lit(None).cast("string"), F.col("trace_id"), F.col("request_id"), F.col("span_id")).alias("correlation_key"))


@query("SELECT id, nullif(regexp_replace(regexp_replace(" + message_sql("fingerprint") + ", '\\s+', ' ', 'g'), '^([^:\\s]*)\\s*:\\s*', '\\1:'), '') AS fingerprint_norm FROM evidence")
def stored_fingerprint(spark, d):
    return table(spark, d, "evidence").select("id", same_fingerprint(F.col("fingerprint")).alias("fingerprint_norm"))


_ROLLUP_SQL = """rolled AS (SELECT analysis_id, artifact_id, left(fingerprint, 255) AS fingerprint, trace_id, request_id, span_id, count(*) AS occurrence_count, min(received_at) AS first_seen, max(received_at) AS last_seen,
 min(line_number) AS first_line_number, max(line_number) AS last_line_number,
 arg_min(exception_type, o) FILTER (WHERE exception_type IS NOT NULL) AS event_type, arg_min(level, o) FILTER (WHERE level IS NOT NULL) AS severity, arg_min(service, o) FILTER (WHERE service IS NOT NULL) AS service,
 arg_min(module, o) FILTER (WHERE module IS NOT NULL) AS module, arg_min(host, o) FILTER (WHERE host IS NOT NULL) AS host, arg_min(pod, o) FILTER (WHERE pod IS NOT NULL) AS pod,
 arg_min(endpoint, o) FILTER (WHERE endpoint IS NOT NULL) AS endpoint, arg_min(source_format, o) FILTER (WHERE source_format IS NOT NULL) AS source_format, arg_min(http_status, o) FILTER (WHERE http_status IS NOT NULL) AS http_status,
 arg_min(raw_line, o) FILTER (WHERE raw_line IS NOT NULL) AS representative_line FROM (SELECT *, row_number() OVER (ORDER BY line_number, event_id) AS o FROM kept) GROUP BY 1, 2, 3, 4, 5, 6)"""
_KEY_SQL = "sha256(concat_ws('|', coalesce(trace_id, '__none__'), coalesce(request_id, '__none__'), coalesce(span_id, '__none__'))) AS correlation_key"


@query(f"WITH {CANONICAL_SQL}, {_ROLLUP_SQL} SELECT *, {_KEY_SQL} FROM rolled")
def evidence_rollup(spark, d):
    return rollup.rollup(rollup.retained(table(spark, d, "parsed_events")))


@query(f"WITH {CANONICAL_SQL}, {_ROLLUP_SQL} SELECT *, {_KEY_SQL} FROM rolled")
def evidence_merge_batches(spark, d):
    kept = rollup.retained(table(spark, d, "parsed_events"))
    whole = None
    for b in range(3):
        part = rollup.rollup(kept.filter(F.pmod(F.col("event_id"), F.lit(3)) == b)).withColumn("batch", F.lit(b))
        whole = part if whole is None else whole.unionByName(part)
    return rollup.merge_rollups(whole)


@query(f"WITH {CANONICAL_SQL}, {_ROLLUP_SQL}, n AS (SELECT fingerprint, CAST(sum(occurrence_count) AS BIGINT) AS occurrences, CAST(count(*) AS BIGINT) AS evidence_rows FROM rolled GROUP BY 1) SELECT * FROM n ORDER BY occurrences DESC, fingerprint LIMIT 20")
def evidence_rollup_top(spark, d):
    rolled = rollup.rollup(rollup.retained(table(spark, d, "parsed_events")))
    return rolled.groupBy("fingerprint").agg(F.sum("occurrence_count").alias("occurrences"), F.count(F.lit(1)).alias("evidence_rows")).orderBy(F.desc("occurrences"), "fingerprint").limit(20)


@query("SELECT id, CASE WHEN nullif(trace_id,'') <> '__none__' THEN 'trace:' || trace_id WHEN nullif(request_id,'') <> '__none__' THEN 'request:' || request_id ELSE 'unresolved:' || id END AS identity, CASE WHEN nullif(trace_id,'') <> '__none__' THEN 'trace_id' WHEN nullif(request_id,'') <> '__none__' THEN 'request_id' ELSE 'unresolved' END AS match_type, CAST(CASE WHEN nullif(trace_id,'') <> '__none__' THEN 1.0 WHEN nullif(request_id,'') <> '__none__' THEN 0.9 ELSE 0.0 END AS DOUBLE) AS strength FROM evidence")
def identity_resolve(spark, d):
    return rollup.identity(table(spark, d, "evidence"))


@query("SELECT id, analysis_id, canonical_id FROM (SELECT id, analysis_id, first_value(id) OVER (PARTITION BY analysis_id, content_sha256 ORDER BY file_position, id) AS canonical_id FROM analysis_artifacts WHERE nullif(content_sha256, '') IS NOT NULL) WHERE id <> canonical_id")
def artifact_duplicates(spark, d):
    return rollup.duplicate_artifacts(table(spark, d, "analysis_artifacts"))


@query("SELECT analysis_id, artifact_id, count(*) AS evidence_count FROM evidence GROUP BY 1, 2")
def counts_by_artifact(spark, d):
    return table(spark, d, "evidence").groupBy("analysis_id", "artifact_id").agg(F.count(F.lit(1)).alias("evidence_count"))


@query("SELECT analysis_id, fingerprint, count(*) AS n FROM evidence WHERE fingerprint IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_fingerprints(spark, d):
    return table(spark, d, "evidence").filter("fingerprint is not null").groupBy("analysis_id", "fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _bridge(column: str) -> None:
    sql = f"SELECT analysis_id, {column} AS value, count(DISTINCT artifact_id) AS artifacts FROM evidence WHERE nullif({column}, '') IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT artifact_id) > 1"

    def run(spark, d):
        return rollup.bridges(table(spark, d, "evidence"), column)

    run.__name__ = f"bridging_{column}"
    query(sql)(run)


for _c in ("trace_id", "request_id", "span_id", "resolved_identity"):
    _bridge(_c)


@query("WITH n AS (SELECT analysis_id, count(*) AS artifacts, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM analysis_artifacts GROUP BY 1) SELECT a.id, a.user_id, a.title, a.status, a.created_at, coalesce(n.artifacts, 0) AS artifacts, coalesce(n.bytes, 0) AS bytes FROM analyses a LEFT JOIN n ON n.analysis_id = a.id")
def history_counts(spark, d):
    n = table(spark, d, "analysis_artifacts").groupBy(F.col("analysis_id").alias("id")).agg(F.count(F.lit(1)).alias("artifacts"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return table(spark, d, "analyses").select("id", "user_id", "title", "status", "created_at").join(n, "id", "left").fillna(0, ["artifacts", "bytes"])


PAGE = 20


@query(f"SELECT user_id, id, created_at, page FROM (SELECT user_id, id, created_at, (row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) - 1) // {PAGE} + 1 AS page FROM analyses)")
def history_pages(spark, d):
    ranked = ranking.position(table(spark, d, "analyses").select("user_id", "id", "created_at"), ["user_id"], [F.col("created_at").desc(), F.col("id").desc()])
    return ranked.select("user_id", "id", "created_at", (F.floor((F.col("pos") - 1) / PAGE) + 1).cast("bigint").alias("page"))


@query("SELECT id, created_at, encode(strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '|' || id)::VARCHAR IS NOT NULL AS has_cursor FROM analyses WHERE created_at < TIMESTAMP '2026-04-01' ORDER BY created_at DESC, id DESC LIMIT 21")
def history_keyset(spark, d):
    """One page after a cursor, with one row more to tell whether there is a next page."""
    rows = table(spark, d, "analyses").filter(F.col("created_at") < F.lit("2026-04-01").cast("timestamp_ntz")).orderBy(F.desc("created_at"), F.desc("id")).limit(PAGE + 1)
    cursor = F.base64(F.encode(F.concat_ws("|", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.col("id").cast("string")), "UTF-8"))
    return rows.select("id", "created_at", cursor.isNotNull().alias("has_cursor"))


@query("SELECT analysis_id, id, first_seen, row_number() OVER (PARTITION BY analysis_id ORDER BY first_seen NULLS FIRST, id) AS place FROM evidence")
def timeline_keyset(spark, d):
    return ranking.position(table(spark, d, "evidence").select("analysis_id", "id", "first_seen"), ["analysis_id"], [F.col("first_seen").asc_nulls_first(), F.col("id")], name="place")


@query("SELECT analysis_id, id FROM (SELECT analysis_id, id, row_number() OVER (PARTITION BY analysis_id ORDER BY first_seen NULLS FIRST, id) AS a, row_number() OVER (PARTITION BY analysis_id ORDER BY first_seen DESC NULLS LAST, id DESC) AS b FROM evidence) WHERE a <= 50 OR b <= 50")
def boundary_rows(spark, d):
    e = table(spark, d, "evidence").select("analysis_id", "id", "first_seen")
    up = ranking.position(e, ["analysis_id"], [F.col("first_seen").asc_nulls_first(), F.col("id")], size="n")
    return up.filter((F.col("pos") <= 50) | (F.col("pos") > F.col("n") - 50)).select("analysis_id", "id")


@query("SELECT analysis_id, CAST(sum(size_bytes) AS BIGINT) AS total, CAST(sum(CASE WHEN status IN ('processed', 'duplicate') THEN size_bytes ELSE 0 END) AS BIGINT) AS done, CASE WHEN coalesce(sum(size_bytes), 0) <= 0 THEN 0 ELSE greatest(0, least(98, CAST(sum(CASE WHEN status IN ('processed', 'duplicate') THEN size_bytes ELSE 0 END) AS BIGINT) * 98 // CAST(sum(size_bytes) AS BIGINT))) END AS percentage FROM analysis_artifacts GROUP BY 1")
def ingestion_progress(spark, d):
    done = F.sum(F.when(F.col("status").isin("processed", "duplicate"), F.col("size_bytes")).otherwise(0)).alias("done")
    g = table(spark, d, "analysis_artifacts").groupBy("analysis_id").agg(F.sum("size_bytes").alias("total"), done)
    share = F.greatest(F.lit(0), F.least(F.lit(98), F.expr("done * 98 div total")))
    return g.withColumn("percentage", F.when(F.coalesce("total", F.lit(0)) <= 0, 0).otherwise(share).cast("bigint"))


@query("SELECT id, analysis_id, max(size_bytes) OVER (PARTITION BY analysis_id ORDER BY file_position, id ROWS UNBOUNDED PRECEDING) AS running_max, CAST(sum(size_bytes) OVER (PARTITION BY analysis_id ORDER BY file_position, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_sum FROM analysis_artifacts")
def running_progress(spark, d):
    w = Window.partitionBy("analysis_id").orderBy("file_position", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "analysis_artifacts").select("id", "analysis_id", F.max("size_bytes").over(w).alias("running_max"), F.sum("size_bytes").over(w).alias("running_sum"))


@query("SELECT analysis_id, artifact_id, max(last_line_number) AS max_line, CAST(sum(last_line_number - first_line_number + 1) AS BIGINT) AS lines FROM evidence GROUP BY 1, 2")
def finalize_rollup(spark, d):
    return table(spark, d, "evidence").groupBy("analysis_id", "artifact_id").agg(F.max("last_line_number").alias("max_line"), F.sum(F.expr("last_line_number - first_line_number + 1")).alias("lines"))


_RANK_SQL = "CASE WHEN upper(severity) IN ('CRITICAL','FATAL') THEN 4 WHEN upper(severity) = 'ERROR' THEN 3 WHEN upper(severity) IN ('WARNING','WARN') THEN 2 ELSE 0 END"


@query(f"SELECT analysis_id, artifact_id, id, turn, row_number() OVER (PARTITION BY analysis_id ORDER BY turn, artifact_id, id) AS place FROM (SELECT analysis_id, artifact_id, id, row_number() OVER (PARTITION BY analysis_id, artifact_id ORDER BY {_RANK_SQL} DESC, coalesce(occurrence_count, 0) DESC, first_seen NULLS FIRST, id) AS turn FROM evidence)")
def round_robin(spark, d):
    return rollup.round_robin(table(spark, d, "evidence")).select("analysis_id", "artifact_id", "id", "turn", "place")


@query()
def bounded_selection(spark, d):
    return rollup.bounded_selection(table(spark, d, "evidence"))


_STATIC_SQL = f"""WITH f AS (SELECT analysis_id, fingerprint, count(*) AS n FROM evidence GROUP BY 1, 2), b AS (SELECT analysis_id, trace_id FROM evidence WHERE nullif(trace_id, '') IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT artifact_id) > 1),
s AS (SELECT e.analysis_id, e.id, CASE WHEN nullif(e.span_id, '') IS NOT NULL OR nullif(e.parent_span_id, '') IS NOT NULL THEN 5.0 ELSE 0.0 END + CASE WHEN b.trace_id IS NOT NULL THEN 4.0 WHEN nullif(e.trace_id, '') IS NOT NULL OR nullif(e.request_id, '') IS NOT NULL THEN 3.0 ELSE 0.0 END + {_RANK_SQL.replace("severity", "e.severity")} + 1.0 / f.n AS score
 FROM evidence e JOIN f ON f.analysis_id = e.analysis_id AND f.fingerprint IS NOT DISTINCT FROM e.fingerprint LEFT JOIN b ON b.analysis_id = e.analysis_id AND b.trace_id = e.trace_id)
SELECT analysis_id, id, round(CAST(score AS DOUBLE), 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY round(CAST(score AS DOUBLE), 6) DESC, id) AS place FROM s) WHERE place <= 500"""


@query(_STATIC_SQL)
def priority_selection(spark, d):
    """Top rows of each analysis by span, identity, severity and rarity of the fingerprint."""
    e = table(spark, d, "evidence")
    n = e.groupBy("analysis_id", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    bridge = rollup.bridges(e, "trace_id").select(F.col("analysis_id").alias("_a"), F.col("value").alias("_v"))
    have = lambda c: blank_to_null(F.col(c)).isNotNull()
    j = e.alias("e").join(n.alias("n"), (F.col("e.analysis_id") == F.col("n.analysis_id")) & F.col("e.fingerprint").eqNullSafe(F.col("n.fingerprint"))).join(bridge, (F.col("e.analysis_id") == F.col("_a")) & (F.col("e.trace_id") == F.col("_v")), "left")
    score = F.when(have("span_id") | have("parent_span_id"), 5.0).otherwise(0.0) + F.when(F.col("_v").isNotNull(), 4.0).when(have("trace_id") | have("request_id"), 3.0).otherwise(0.0) + rollup.severity_rank(F.col("severity")) + 1.0 / F.col("n")
    s = j.select(F.col("e.analysis_id").alias("analysis_id"), "id", F.round(score, 6).alias("score"))
    return ranking.position(s, ["analysis_id"], [F.col("score").desc(), F.col("id")], name="place").filter("place <= 500")


@query("SELECT a.id, a.analysis_id FROM analysis_artifacts a WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.artifact_id = a.id)")
def artifacts_without_evidence(spark, d):
    return table(spark, d, "analysis_artifacts").select("id", "analysis_id").join(table(spark, d, "evidence").select(F.col("artifact_id").alias("id")), "id", "left_anti")


@query("SELECT analysis_id, artifact_id, fingerprint, min(id) AS id, CAST(sum(occurrence_count) AS BIGINT) AS occurrence_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM evidence GROUP BY 1, 2, 3")
def legacy_survivors(spark, d):
    return table(spark, d, "evidence").groupBy("analysis_id", "artifact_id", "fingerprint").agg(F.min("id").alias("id"), F.sum("occurrence_count").alias("occurrence_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query("SELECT artifact_id, count(*) AS pages, round(avg(ocr_confidence), 6) AS mean_confidence FROM scanned_pages GROUP BY 1")
def ocr_confidence(spark, d):
    return table(spark, d, "scanned_pages").groupBy("artifact_id").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("ocr_confidence"), 6).alias("mean_confidence"))


@query("SELECT analysis_id, CAST(sum(strlen(coalesce(representative_line, '')) + strlen(coalesce(diagnostic_attributes, ''))) AS BIGINT) AS text_bytes FROM evidence GROUP BY 1")
def text_bytes(spark, d):
    n = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return table(spark, d, "evidence").groupBy("analysis_id").agg(F.sum(n("representative_line") + n("diagnostic_attributes")).cast("bigint").alias("text_bytes"))


_OUTCOME_SQL = """SELECT a.id, a.analysis_id, o.original_filename AS duplicate_of, coalesce(n.c, 0) AS evidence_count, CASE WHEN a.status = 'unsupported' THEN 'unsupported' WHEN a.status = 'resource_limited' THEN 'resource_limited' WHEN a.status IN ('failed', 'processing_error') THEN 'processing_error'
 WHEN a.duplicate_of_artifact_id IS NOT NULL THEN 'duplicate' WHEN a.status <> 'processed' OR a.status IS NULL THEN 'pending' WHEN coalesce(n.c, 0) = 0 THEN 'no_evidence' ELSE 'processed' END AS outcome
 FROM analysis_artifacts a LEFT JOIN analysis_artifacts o ON o.id = a.duplicate_of_artifact_id LEFT JOIN (SELECT artifact_id, count(*) AS c FROM evidence GROUP BY 1) n ON n.artifact_id = a.id"""


@query(_OUTCOME_SQL)
def artifact_outcomes(spark, d):
    a = table(spark, d, "analysis_artifacts")
    n = table(spark, d, "evidence").groupBy(F.col("artifact_id").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    o = a.select(F.col("id").alias("duplicate_of_artifact_id"), F.col("original_filename").alias("duplicate_of"))
    j = a.select("id", "analysis_id", "status", "duplicate_of_artifact_id").join(o, "duplicate_of_artifact_id", "left").join(n, "id", "left").withColumn("evidence_count", F.coalesce("c", F.lit(0)))
    s = F.col("status")
    outcome = (
        F.when(s == "unsupported", "unsupported").when(s == "resource_limited", "resource_limited").when(s.isin("failed", "processing_error"), "processing_error").when(F.col("duplicate_of_artifact_id").isNotNull(), "duplicate")
        .when((s != "processed") | s.isNull(), "pending").when(F.col("evidence_count") == 0, "no_evidence").otherwise("processed")
    )
    return j.select("id", "analysis_id", "duplicate_of", "evidence_count", outcome.alias("outcome"))


@query("SELECT user_id, id FROM analyses WHERE user_id IN (SELECT user_id FROM analyses GROUP BY 1 HAVING count(*) > 1)")
def owned_analyses(spark, d):
    a = table(spark, d, "analyses").select("user_id", "id")
    many = a.groupBy("user_id").count().filter("count > 1").select("user_id")
    return a.join(many, "user_id", "left_semi")


@query("SELECT id FROM analysis_artifacts WHERE status IS NULL OR status NOT IN ('processed', 'unsupported', 'duplicate', 'failed')")
def dispatchable_artifacts(spark, d):
    return table(spark, d, "analysis_artifacts").filter(F.col("status").isNull() | ~F.col("status").isin("processed", "unsupported", "duplicate", "failed")).select("id")


@query("WITH s AS (SELECT id, regexp_extract(lower(original_filename), '(\\.[^./]+?)(?:\\.\\d+)?$', 1) AS suffix FROM analysis_artifacts) SELECT id, suffix, suffix IN ('.log', '.txt', '.json', '.jsonl', '.ndjson', '.har', '.out', '.err') AS text_suffix FROM s")
def effective_suffix(spark, d):
    from lumenlog.functions.detect import TEXT_SUFFIXES, effective_suffix as suffix

    s = table(spark, d, "analysis_artifacts").select("id", suffix(F.col("original_filename")).alias("suffix"))
    return s.withColumn("text_suffix", F.col("suffix").isin(*TEXT_SUFFIXES))


@query("SELECT analysis_id, list_sort(list_distinct(flatten(list(signals)))) AS signals_seen FROM correlation_edges GROUP BY 1")
def signals_seen(spark, d):
    """Union of the signal sets of each analysis."""
    x = table(spark, d, "correlation_edges").select("analysis_id", F.explode_outer("signals").alias("s"))
    return x.groupBy("analysis_id").agg(F.array_sort(F.collect_set("s")).alias("signals_seen"))


@query("SELECT artifact_id, service, count(*) AS n, grouping(artifact_id) AS g_artifact, grouping(service) AS g_service FROM evidence GROUP BY GROUPING SETS ((artifact_id, service), (service), ())")
def evidence_grouping_sets(spark, d):
    """Extension: subtotals in one pass."""
    table(spark, d, "evidence").createOrReplaceTempView("_evidence_gs")
    return spark.sql("SELECT artifact_id, service, count(*) AS n, CAST(grouping(artifact_id) AS BIGINT) AS g_artifact, CAST(grouping(service) AS BIGINT) AS g_service FROM _evidence_gs GROUP BY GROUPING SETS ((artifact_id, service), (service), ())")


@query("SELECT time_bucket(INTERVAL '1 hour', received_at) AS hour, service, count(*) AS n FROM parsed_events GROUP BY 1, 2")
def hourly_counts(spark, d):
    """Extension: tumbling windows."""
    e = table(spark, d, "parsed_events")
    return e.groupBy(F.date_trunc("hour", F.col("received_at")).cast("timestamp_ntz").alias("hour"), "service").agg(F.count(F.lit(1)).alias("n"))
