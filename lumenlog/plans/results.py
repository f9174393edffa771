"""Queries of statuses, contexts, result documents, frames and formats of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions import events
from lumenlog.operators import correlation, loglines, nested, results, rollup, times
from lumenlog.session import cut, table
from lumenlog.sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Rows and bytes of evidence that one analysis shows.
SHOWN_RECORDS, SHOWN_BYTES = 5_000, 20 * 1024 * 1024


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _ranked(spark, d):
    e = table(spark, d, "evidence")
    related = cut(correlation.relationships(e))
    return e, related, cut(correlation.ranked_causes(e, related))


@query()
def artifact_statuses(spark, d):
    e, _, ranked = _ranked(spark, d)
    return results.artifact_statuses(ranked, e)


@query()
def top_causes(spark, d):
    return results.top_causes(_ranked(spark, d)[2])


@query()
def fitting_components(spark, d):
    e, _, ranked = _ranked(spark, d)
    return results.fitting_components(ranked, e)


@query()
def component_documents(spark, d):
    e, related, ranked = _ranked(spark, d)
    return results.component_documents(ranked, e, related)


@query()
def simple_documents(spark, d):
    """The evidence of each analysis as it is shown: bounded only above 5,000 rows, then in bytes too."""
    e = table(spark, d, "evidence")
    large = e.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHOWN_RECORDS).select("analysis_id")
    bounded = rollup.bounded_selection(e.join(large, "analysis_id", "left_semi"), records=SHOWN_RECORDS, size=SHOWN_BYTES)
    return results.simple_documents(e.join(large, "analysis_id", "left_anti").select("analysis_id", "id").unionByName(bounded), e)


@query("SELECT id, CASE WHEN extract('microsecond' FROM first_seen) % 1000000 = 0 THEN strftime(first_seen, '%Y-%m-%dT%H:%M:%S') ELSE strftime(first_seen, '%Y-%m-%dT%H:%M:%S.%f') END AS first_seen_iso FROM evidence")
def iso_times(spark, d):
    return table(spark, d, "evidence").select("id", results.iso(F.col("first_seen")).alias("first_seen_iso"))


@query()
def fallback_contexts(spark, d):
    """Excerpts of the pages of scans, one text per page, within the budget of each scan."""
    p = table(spark, d, "scanned_pages").select(F.col("artifact_id").alias("analysis_id"), F.col("page_id").alias("artifact_id"), F.col("extracted_text").alias("text"))
    return results.fallback_contexts(p)


@query("SELECT doc_id, length(trim(text)) >= 8 AND coalesce(len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')), 0) <= greatest(4, length(text) // 20) AS usable FROM documents")
def text_fallback_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", events.control_ratio_ok(F.col("text")).alias("usable"))


@query("""WITH f AS (SELECT DISTINCT f.file AS file FROM (SELECT unnest(stack_frames) AS f FROM parsed_events)), s AS (SELECT DISTINCT source_file AS path FROM evidence WHERE nullif(source_file, '') IS NOT NULL),
a AS (SELECT file, array_to_string(list_slice(string_split(ltrim(file, './'), '/'), -k, -1), '/') AS suffix, k FROM (SELECT file, unnest(generate_series(1, len(string_split(ltrim(file, './'), '/')))) AS k FROM f)),
b AS (SELECT path, array_to_string(list_slice(string_split(path, '/'), -k, -1), '/') AS suffix FROM (SELECT path, unnest(generate_series(1, len(string_split(path, '/')))) AS k FROM s)),
h AS (SELECT file, k, count(DISTINCT path) AS n, min(path) AS path FROM a JOIN b USING (suffix) GROUP BY 1, 2)
SELECT file, path, CAST(k AS INTEGER) AS depth FROM h WHERE k = (SELECT max(k) FROM h g WHERE g.file = h.file) AND n = 1""")
def frame_sources(spark, d):
    """Each file named in a stack frame with the source file of its longest known ending."""
    f = table(spark, d, "parsed_events").select(F.explode("stack_frames").alias("f")).select(F.col("f.file").alias("frame_id"), F.col("f.file").alias("file")).distinct()
    s = table(spark, d, "evidence").select(F.col("source_file").alias("path")).filter("path is not null and path <> ''").distinct()
    return readers.match_frames(f, readers.path_endings(s)).withColumnRenamed("frame_id", "file")


@query()
def otlp_resources(spark, d):
    return nested.otlp_tables(table(spark, d, "otlp_exports"))["resources"].select("export_id", "res_pos", F.array_join(F.transform("label", lambda x: x.cast("string")), ".").alias("label"))


@query()
def otlp_attributes(spark, d):
    t = nested.otlp_tables(table(spark, d, "otlp_exports"))["resource_attributes"]
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ".")
    return t.select("export_id", text("label").alias("label"), text("parent_label").alias("parent_label"), "res_pos", "attr_pos", "attr_key", "attr_value")


@query()
def otlp_records(spark, d):
    t = nested.otlp_tables(table(spark, d, "otlp_exports"))["log_records"]
    return t.select("export_id", "res_pos", "scope_pos", "rec_pos", "trace_id", "span_id", "time_raw", "severity")


@query()
def otlp_spans(spark, d):
    """The spans of OTLP exports as canonical events."""
    return nested.spans_as_events(table(spark, d, "otlp_exports"))


@query()
def log_entries(spark, d):
    """Entries with all fields; the time of each as an instant, read in UTC where it names no zone."""
    e = loglines.parse_entries(table(spark, d, "raw_lines"))
    arrived = table(spark, d, "raw_lines").groupBy("artifact_id").agg(F.max("received_at").alias("received_at"))
    e = e.join(arrived, "artifact_id", "left")
    out = times.normalise_times(e, value="time_raw", source=F.col("artifact_id").cast("string"), host_zone=F.lit(None).cast("string"), received="received_at")
    return out.select("artifact_id", "first_line", "last_line", "time_raw", "utc_us", "level", "component", "message")


@query()
def json_log_events(spark, d):
    """The JSON lines among the container logs and what looks important of the others, as canonical events."""
    logs = table(spark, d, "docker_logs").select(F.col("container_id").alias("file"), F.col("log_id").alias("line_number"), F.col("log").alias("line"))
    return readers.json_lines(logs.filter("line is not null")).drop("message", "stack_frames")
