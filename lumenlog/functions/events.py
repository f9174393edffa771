"""Fields of diagnostic text: identifiers, exceptions, frames, endpoints and per-format heads."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumenlog.functions.text import EXCEPTION, blank_to_null, first_level, level_of_status

# Spellings of field names (lower case, without - and _) and the field they stand for.
FIELD_ALIASES = {
    "traceid": "trace_id", "spanid": "span_id", "parentspanid": "parent_span_id", "requestid": "request_id", "correlationid": "request_id", "xrequestid": "request_id",
    "service": "service", "servicename": "service", "app": "service", "component": "service", "module": "module", "logger": "module",
    "host": "host", "hostname": "host", "node": "host", "container": "container", "containerid": "container", "containername": "container",
    "pod": "pod", "podname": "pod", "status": "http_status", "statuscode": "http_status", "httpstatus": "http_status",
    "endpoint": "endpoint", "route": "endpoint", "path": "endpoint", "url": "endpoint",
}
FIELDS = tuple(dict.fromkeys(FIELD_ALIASES.values()))
# Patterns of the data format.
FIELD = r"\b([A-Za-z][A-Za-z0-9_-]*)\b[\"']?\s*(?:=|:)\s*[\"']?([A-Za-z0-9_./:@?&={}-]+)"
SPACED = r"(?i)\b(parent[_-]?span[_-]?id|trace[_-]?id|span[_-]?id|request[_-]?id|correlation[_-]?id|x-request-id|service(?:[_-]?name)?|app|component|module|logger|host(?:name)?|node|container(?:[_-]?(?:id|name))?|pod(?:[_-]?name)?|status(?:[_-]?code)?|http[_-]?status|endpoint|route|path|url)\s+([A-Za-z0-9_./:@?&={}-]+)"
REQUEST = r"(?i)\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(\S+)"
PYTHON_FRAME = r'(?md)^\s*File "([^"]+)", line (\d+), in (.+)$(?=\s*\S)'
JAVA_FRAME = r"(?md)^\s*at\s+(?:(.+?)\()?([^():]+):(\d+)\)?$"
NODE_FRAME = r"(?md)^\s*at\s+(?:(.+?)\s+\()?([^():]+):(\d+):\d+\)?$"
PLACE = r"(?i)([\w./\\-]+\.[A-Za-z][A-Za-z0-9]{0,9}):(?:line\s+)?(\d+)(?::(\d+))?"
LOOSE_FRAME = r"(?i)File\s*\"[^\"]+\"\s*,?\s*line\s+\d+|(?:^|[^A-Za-z0-9_])at\s+\S+\([^()]*:\d+\)"
IMPORTANT_MARKS = ("warn", "error", "err", "severe", "fatal", "critical", "alert", "emerg", "exception", "failure", "traceback", "panic:", "segmentation fault", "slow query")
IMPORTANT_STATUS = r"(?i)(?:\bstatus(?:[_-]?code)?[\s=:\"']+[45]\d{2}\b|\"\s+[45]\d{2}\s)"
PAGE_LEVELS = ("CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARNING", "INFO", "INFO", "DEBUG")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _pairs(text: Column, pattern: str) -> Column:
    """array<struct<k, v>>: known fields and their values in the order of the text."""
    table = F.create_map(*(F.lit(x) for kv in FIELD_ALIASES.items() for x in kv))
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), 1),
        F.regexp_extract_all(text, F.lit(pattern), 2),
        lambda k, v: F.struct(F.element_at(table, F.regexp_replace(F.lower(k), "[_-]", "")).alias("k"), F.regexp_replace(v, r"[.,;)]+$", "").alias("v")),
    )
    return F.filter(found, lambda p: p["k"].isNotNull() & (p["v"] != ""))


def fields(text: Column) -> Column:
    """struct of the known fields: the first value in key=value or key: value form, else in spaced form."""
    none = F.array().cast("array<struct<k:string,v:string>>")
    plain = F.when(text.rlike("[=:]"), _pairs(text, FIELD)).otherwise(none)
    spaced = F.when(text.rlike(SPACED), _pairs(text, SPACED)).otherwise(none)
    first = lambda every, f: F.try_element_at(F.filter(every, lambda p: p["k"] == f), F.lit(1))["v"]
    return let(F.concat(plain, spaced), lambda every: F.struct(*(first(every, f).alias(f) for f in FIELDS)))


def exception_type(text: Column, last: Column | None = None) -> Column:
    """Type of the first exception named (of the last, where ``last`` holds), without its packages."""
    names = F.regexp_extract_all(text, F.lit(EXCEPTION), 1)
    name = F.try_element_at(names, F.when(last, -1).otherwise(1) if last is not None else F.lit(1))
    return F.regexp_extract(name, r"([^.]+)$", 1)


def exception_message(text: Column, last: Column | None = None) -> Column:
    parts = F.regexp_extract_all(text, F.lit(EXCEPTION), 2)
    return blank_to_null(F.trim(F.try_element_at(parts, F.when(last, -1).otherwise(1) if last is not None else F.lit(1))))


def endpoint(text: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(text, r"(?i)(?:\b(?:endpoint|route|path|url)[\s=:\"']+)(https?://[^\s\"']+|/[^\s\"']*)", 1)), blank_to_null(F.regexp_extract(text, REQUEST, 1)))


def stack_frames(text: Column) -> Column:
    """array<struct<file, line, function>> of Python, Node and Java frames, else of file:line places.

    Each pattern is only tried where a cheap mark of it is found.
    """
    kind = "array<struct<file:string,line:int,function:string>>"
    none = F.array().cast(kind)

    def frames(pattern: str, file: int, line: int, function: int) -> Column:
        g = lambda n: F.regexp_extract_all(text, F.lit(pattern), n)
        place = F.zip_with(g(file), g(line), lambda a, b: F.struct(a.alias("f"), b.alias("l")))
        names = g(function) if function else g(line)
        name = (lambda n: blank_to_null(n)) if function else (lambda n: F.lit(None).cast("string"))
        return F.zip_with(place, names, lambda x, n: F.struct(x["f"].alias("file"), x["l"].try_cast("int").alias("line"), name(n).alias("function"))).cast(kind)

    python = F.when(text.contains('File "'), frames(PYTHON_FRAME, 1, 2, 3)).otherwise(none)
    called = text.rlike(r"(?md)^\s*at\s")
    calls = F.when(called, F.concat(frames(NODE_FRAME, 2, 3, 1), frames(JAVA_FRAME, 2, 3, 1))).otherwise(none)
    places = F.when(text.rlike(r"\.[A-Za-z]\w{0,9}:(?:line\s+)?\d"), frames(PLACE, 1, 2, 0)).otherwise(none)
    return let(F.concat(python, calls), lambda named: F.when(F.size(named) > 0, named).otherwise(places))


def contains_frame(text: Column) -> Column:
    """A stack frame of any of the known shapes, also one that lost a blank."""
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in (PYTHON_FRAME, JAVA_FRAME, NODE_FRAME, PLACE, LOOSE_FRAME)))


def may_be_important(text: Column) -> Column:
    """Cheap test before parsing: a marked word, a failing status or a stack frame."""
    low = F.lower(text)
    words = reduce(lambda a, b: a | b, (low.contains(m) for m in IMPORTANT_MARKS))
    return words | (low.contains("status") & text.rlike(IMPORTANT_STATUS)) | contains_frame(text)


def text_event(df: DataFrame, column: str, default_level: Column | None = None, prefix: str = "") -> DataFrame:
    """Add the canonical fields of a text record under ``prefix``.

    The level is the first level word, else ERROR if an exception is named,
    WARNING for slow queries, else by the status. Of a record with several
    lines the last exception counts. The parts are read once per record.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    many = text.contains("\n")
    parts = F.struct(fields(text).alias("f"), exception_type(text, many).alias("kind"), exception_message(text, many).alias("message"), endpoint(text).alias("endpoint"), stack_frames(text).alias("frames"))
    read = df.select("*", F.explode(F.array(parts)).alias("_parts"))
    f = lambda c: F.col(f"_parts.f.{c}")
    low = F.lower(text)
    status = f("http_status").try_cast("int")
    kind = F.col("_parts.kind")
    found = F.coalesce(default_level if default_level is not None else F.lit(None).cast("string"), first_level(text), F.when(kind.isNotNull() | low.contains("panic:") | low.contains("segmentation fault"), "ERROR"), F.when(low.contains("slow query"), "WARNING"), level_of_status(status))
    out = {c: f(c) for c in FIELDS if c not in ("http_status", "endpoint")}
    out |= {"level": found, "exception_type": kind, "exception_message": F.col("_parts.message"), "http_status": status, "endpoint": F.coalesce(f("endpoint"), F.col("_parts.endpoint")), "stack_frames": F.col("_parts.frames")}
    return read.withColumns({f"{prefix}{k}": v for k, v in out.items()}).drop("_parts")


def syslog_level(priority: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in PAGE_LEVELS)), F.pmod(F.coalesce(priority, F.lit(7)), F.lit(8)).cast("int") + 1)


def cri_line(text: Column) -> dict[str, Column]:
    p = r"^(\d{4}-\d{2}-\d{2}T\S+)\s+(stdout|stderr)\s+([FP])\s([\s\S]*)$"
    g = lambda n: blank_to_null(F.regexp_extract(text, p, n))
    return {"time_raw": g(1), "stream": g(2), "flag": g(3), "body": F.regexp_extract(text, p, 4)}


def cloudfront_row(columns: Column, names: Column) -> dict[str, Column]:
    """Canonical fields of a tab-separated row under its header; '-' is missing."""
    row = F.map_from_arrays(names, F.transform(columns, lambda x: F.nullif(x, F.lit("-"))))
    at = lambda k: F.try_element_at(row, F.lit(k))
    status = at("sc-status").try_cast("int")
    query = at("cs-uri-query")
    return {"time_raw": F.concat(at("date"), F.lit("T"), at("time"), F.lit("Z")), "http_status": status, "level": level_of_status(status), "endpoint": F.when(query.isNotNull(), F.concat(at("cs-uri-stem"), F.lit("?"), query)).otherwise(at("cs-uri-stem")), "host": F.coalesce(at("x-host-header"), at("cs(host)")), "request_id": at("x-edge-request-id"), "service": F.lit("cloudfront")}


def ocr_text(c: Column) -> Column:
    """Full-width punctuation, blanks and a misread 'line 13' brought to plain form."""
    plain = F.translate(c, "：；，。（）［］＂＇", ":;,.()[]\"'")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"(?i)\b1ine (?=\d)", "line "), r"(?m)^ +| +$", "")


def control_ratio_ok(c: Column) -> Column:
    """Long enough and nearly free of control characters."""
    bad = F.regexp_count(c, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))
    return (F.length(F.trim(c)) >= 8) & (bad <= F.greatest(F.lit(4), F.floor(F.length(c) / 20)))
