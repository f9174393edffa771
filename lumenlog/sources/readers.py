"""Readers of diagnostic files: text, JSON lines and documents, HTTP archives, CloudFront, OTLP, uploads, source trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumenlog.functions import detect, events
from lumenlog.functions.text import LEVEL_WORD, level, level_of_status
from lumenlog.operators import loglines, nested

#: Bytes of one record; longer lines are cut into fragments.
RECORD_BYTES = 1_048_576
# Folders and suffixes that hold no source text.
SKIP_FOLDERS = (".git", "node_modules", ".venv", "venv", "dist", "build", "coverage", "__pycache__")
BINARY_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".pdf", ".zip", ".tar", ".gz",
    ".bz2", ".7z", ".exe", ".dll", ".so", ".dylib", ".class", ".jar", ".woff", ".woff2",
    ".ttf", ".eot", ".mp4", ".mp3", ".wav", ".bin", ".lock", ".pyc",
)
# Members that hold a field of a JSON record, in order of preference.
ALIASES = {
    "exception_type": ("exception_type", "exception.type", "error.type", "error.name"),
    "exception_message": ("exception_message", "exceptionMessage", "exception.message", "error.message", "error", "exception"),
    "message": ("message", "msg", "log", "@message", "body", "body.stringValue", "event.message", "error.message", "exception.message"),
    "http_status": ("http_status", "status_code", "statusCode", "http.status_code", "http.response.status_code", "response.status", "response.statusCode", "elb_status_code", "target_status_code", "status"),
    "level": ("level", "severity", "severityText", "severity_text", "logLevel", "levelname"),
    "status_text": ("status", "state"),
    "stream": ("stream",),
    "time_raw": ("timestamp", "@timestamp", "time", "datetime", "ts", "eventTime", "observed_timestamp", "requestTimeEpoch", "request_time_epoch", "requestTime", "request_time", "requestContext.requestTimeEpoch", "requestContext.requestTime", "startedDateTime"),
    "trace_id": ("trace_id", "traceId", "trace.id"),
    "span_id": ("span_id", "spanId", "span.id"),
    "parent_span_id": ("parent_span_id", "parentSpanId", "span.parent_id"),
    "request_id": ("request_id", "requestId", "correlation_id", "correlationId", "x-request-id", "awsRequestId", "requestContext.requestId"),
    "service": ("service.name", "service_name", "service", "app", "component", "kubernetes.labels.app", "kubernetes.container_name"),
    "module": ("module", "logger", "logger_name", "scope.name"),
    "host": ("host.name", "hostname", "host", "serverIPAddress", "kubernetes.host"),
    "container": ("container.id", "container.name", "container_id", "container_name", "container", "kubernetes.container_name"),
    "pod": ("pod", "pod_name", "kubernetes.pod_name"),
    "endpoint": ("url.path", "endpoint", "route", "path", "url", "http.route", "request.url", "request.path", "requestContext.resourcePath", "resourcePath", "resource_path", "rawPath", "routeKey", "requestContext.http.path"),
}
FAILED = ("warn", "warning", "error", "failed", "failure", "fatal", "critical")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line): numbered lines, carriage returns removed.

    A file is one row until its lines are split, as line numbers need the
    whole file; lines above the record size become numbered fragments.
    """
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("k", "line"))
    line = F.regexp_replace("line", r"\r$", "")
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(line) - 1, F.lit(0)) / RECORD_BYTES).cast("int")), lambda n: F.substring(line, n * RECORD_BYTES + 1, F.lit(RECORD_BYTES)))
    return lines.select("file", (F.col("k") + 1).cast("bigint").alias("line_number"), F.explode(pieces).alias("line"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size_bytes, content_sha256, sample, text_like, supported, detected_format) of uploaded files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sample = F.substring(F.col("content"), 1, detect.SAMPLE_BYTES)
    none = F.lit(None).cast("string")
    text = F.decode(sample, "UTF-8")
    return f.select(F.col("path").alias("file"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_sha256"), detect.text_like(sample).alias("text_like"), detect.supported(sample, F.col("path"), none).alias("supported"), detect.detect_format(F.when(detect.text_like(sample), text), F.col("path")).alias("detected_format"))


def _pick(v: Column, field: str) -> Column:
    """The first member of a field's aliases that holds a plain value."""
    path = lambda name: "$" + "".join(f"['{part}']" for part in name.split("."))
    text = lambda name: F.try_variant_get(v, path(name), "string")
    return F.coalesce(*(F.when(~text(n).rlike(r"^\s*[\[{]|^\s*$"), text(n)) for n in ALIASES[field]))


def structured_event(v: Column) -> dict[str, Column]:
    """Canonical fields of a JSON record, by the usual names in order of preference.

    Without a stated level, a word for failure as status, the error stream, an
    exception and then the HTTP status tell it.
    """
    status = _pick(v, "http_status").try_cast("int")
    kind, told = _pick(v, "exception_type"), _pick(v, "exception_message")
    state = F.lower(_pick(v, "status_text"))
    failing = F.when(state.isin("failed", "failure"), "ERROR").when(state.isin(*FAILED), level(state))
    found = F.coalesce(level(_pick(v, "level")), failing, F.when((_pick(v, "stream") == "stderr") | kind.isNotNull() | told.isNotNull(), "ERROR"), level_of_status(status))
    plain = ("time_raw", "trace_id", "span_id", "parent_span_id", "request_id", "service", "module", "host", "container", "pod", "endpoint")
    return {**{k: _pick(v, k) for k in plain}, "level": found, "http_status": status, "exception_type": kind, "exception_message": told, "message": F.coalesce(_pick(v, "message"), told)}


def structured_gate(v: Column) -> Column:
    """Whether a JSON record may be worth keeping: a harmless level is not believed against signs of failure."""
    stated = level(_pick(v, "level"))
    status = _pick(v, "http_status").try_cast("int")
    signs = stated.isin("WARNING", "ERROR", "CRITICAL") | _pick(v, "exception_type").isNotNull() | _pick(v, "exception_message").isNotNull() | (_pick(v, "stream") == "stderr") | F.lower(_pick(v, "status_text")).isin(*FAILED) | (status >= 400)
    doubtful = F.when(stated.isNotNull(), False).when(status.isNull(), True).otherwise(_pick(v, "message").rlike(LEVEL_WORD))
    return F.coalesce(signs, F.lit(False)) | doubtful


def json_lines(lines: DataFrame) -> DataFrame:
    """Canonical events of (file, line_number, line); what is no JSON is parsed as text if it looks important."""
    v = F.try_parse_json(F.regexp_replace("line", "^﻿", ""))
    rows = lines.withColumn("_v", v)
    good = rows.filter("_v is not null").select("file", "line_number", *(c.alias(k) for k, c in structured_event(F.col("_v")).items()))
    t = events.text_event(rows.filter("_v is null").filter(events.may_be_important(F.col("line"))).select("file", "line_number", "line"), "line")
    bad = t.withColumnRenamed("line", "message").drop("stack_frames")
    return good.unionByName(bad, allowMissingColumns=True)


#: Member under which the records of a JSON document lie.
WRAPPERS = ("log.entries", "logEvents", "records", "Records", "logs")


def json_documents(documents: DataFrame) -> DataFrame:
    """Canonical events of (file, value) JSON documents, HTTP archives included."""
    v = documents.withColumn("_v", F.try_parse_json(F.regexp_replace("value", "^﻿", ""))).filter("_v is not null")
    inner = F.coalesce(*(F.try_variant_get("_v", f"$.{w}", "variant") for w in WRAPPERS), F.col("_v"))
    items = F.coalesce(F.try_variant_get(inner, "$", "array<variant>"), F.array(inner))
    rows = v.select("file", F.posexplode(items).alias("k", "_i"))
    return rows.select("file", (F.col("k") + 1).cast("bigint").alias("line_number"), *(c.alias(k) for k, c in structured_event(F.col("_i")).items()))


def cloudfront(lines: DataFrame) -> DataFrame:
    """Canonical events of tab-separated rows, each under the last header before it in its file."""
    w = Window.partitionBy("file").orderBy("line_number")
    header = F.when(F.col("line").rlike("(?i)^﻿?#fields:"), F.split(F.trim(F.regexp_replace(F.lower("line"), "^﻿?#fields:", "")), r"\s+"))
    rows = lines.withColumn("_h", F.last(header, ignorenulls=True).over(w)).filter(~F.col("line").startswith("#") & F.col("_h").isNotNull())
    cells = F.split("line", "\t")
    cells = F.when(F.size(cells) > 1, cells).otherwise(F.split("line", r"\s+"))
    ok = rows.withColumn("_c", cells).filter(F.size("_c") == F.size("_h"))
    return ok.select("file", "line_number", *(c.alias(k) for k, c in events.cloudfront_row(F.col("_c"), F.col("_h")).items()))


def otlp(documents: DataFrame) -> dict[str, DataFrame]:
    """Tables of (file, value) OTLP documents; see nested.otlp_tables."""
    return nested.otlp_tables(documents.select(F.xxhash64("file").alias("export_id"), F.col("value").alias("payload")))


def otlp_spans(documents: DataFrame) -> DataFrame:
    """Canonical events of the spans of (file, value) OTLP documents."""
    return nested.spans_as_events(documents.select(F.xxhash64("file").alias("export_id"), F.col("value").alias("payload")))


def log_entries(lines: DataFrame) -> DataFrame:
    """Entries with fields of (file, line_number, line)."""
    ids = lines.select(F.xxhash64("file").alias("artifact_id"), "line_number", F.col("line").alias("raw_line"))
    return loglines.parse_entries(ids)


def source_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, depth): every path ending of every source file, longest first."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    parts = F.split("path", "/")
    keep = ~F.arrays_overlap(parts, F.array(*(F.lit(x) for x in SKIP_FOLDERS))) & ~F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1).isin(*BINARY_SUFFIXES)
    return path_endings(f.filter(keep))


def path_endings(paths: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    n = F.size(parts)
    ends = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, n - k + 1, k), "/").alias("suffix")))
    return paths.select("path", F.explode(ends).alias("e")).select("path", "e.suffix", "e.depth")


def match_frames(frames: DataFrame, endings: DataFrame) -> DataFrame:
    """(frame_id, path, depth): each (frame_id, file) with the one source file of its longest known ending.

    The longest ending that any source file has decides; if several files have
    it the frame has no match.
    """
    parts = F.split(F.regexp_replace(F.regexp_replace("file", r"\\\\", "/"), r"^(?:\./|/)+", ""), "/")
    n = F.size(parts)
    ends = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "/"))
    asked = frames.select("frame_id", F.posexplode(ends).alias("k", "suffix"))
    hits = asked.join(endings, "suffix").groupBy("frame_id", "k").agg(F.countDistinct("path").alias("files"), F.min("path").alias("path"))
    best = hits.groupBy("frame_id").agg(F.max(F.struct("k", "files", "path")).alias("b"))
    return best.filter("b.files = 1").select("frame_id", "b.path", (F.col("b.k") + 1).alias("depth"))


def context(lines: Column, at: Column, around: int = 15) -> Column:
    """Lines around a place in an array of lines."""
    start = F.greatest(at - around, F.lit(1))
    return F.slice(lines, start, F.least(at + around, F.size(lines)) - start + 1)
