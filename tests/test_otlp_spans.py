"""Spans of OTLP payloads come out as canonical events."""

import json

import __spark_entry__ as entry
from lumenlog.sources import readers

V = lambda k, v: {"key": k, "value": {"stringValue": v}}
SPAN = {"traceId": "t", "spanId": "s", "parentSpanId": "p", "name": "GET /a", "startTimeUnixNano": "17", "status": {"code": "STATUS_CODE_ERROR", "message": "broken"}, "attributes": [V("http.route", "/a"), {"key": "http.status_code", "value": {"intValue": 502}}]}
RAISED = {"spanId": "x", "events": [{"name": "log"}, {"name": "Exception", "attributes": [V("exception.type", "KeyError"), V("exception.message", "missing")]}]}
DOC = {"resourceLogs": [], "resourceSpans": [{"scopeSpans": [{"scope": {"name": "m"}, "spans": [SPAN, RAISED, {}]}], "resource": {"attributes": [V("service.name", "svc"), V("host.id", "h")]}}]}


def test_spans_as_events(spark):
    snake = json.dumps(DOC)
    for a, b in (("resourceSpans", "resource_spans"), ("scopeSpans", "scope_spans"), ("traceId", "trace_id"), ("parentSpanId", "parent_span_id"), ("spanId", "span_id")):
        snake = snake.replace(a, b)
    df = spark.createDataFrame([("a", json.dumps(DOC)), ("b", snake), ("c", "{"), ("d", None)], "file string, value string")
    rows = readers.otlp_spans(df).collect()
    got = sorted((r["span_pos"], r["level"], r["trace_id"], r["parent_span_id"], r["time_raw"], r["service"], r["host"], r["module"], r["endpoint"], r["http_status"], r["exception_type"], r["message"]) for r in rows)
    one = [(0, "ERROR", "t", "p", "17", "svc", "h", "m", "/a", 502, None, "broken"), (1, "ERROR", None, None, None, "svc", "h", "m", None, None, "KeyError", "missing"), (2, "INFO", None, None, None, "svc", "h", "m", None, None, None, "OpenTelemetry span: unnamed")]
    assert got == sorted([*one, *one])


def test_every_span_of_the_tables(spark, small):
    want = 0
    for r in spark.read.parquet(f"{small}/otlp_exports.parquet").select("payload").collect():
        try:
            doc = json.loads((r["payload"] or "").lstrip("﻿"))
            doc = json.loads(doc) if isinstance(doc, str) else doc
        except ValueError:
            continue
        resources = doc.get("resourceSpans") or doc.get("resource_spans") or []
        want += sum(len(s.get("spans") or []) for x in resources for s in x.get("scopeSpans") or x.get("scope_spans") or [])
    assert want > 0 and entry.queries()["otlp_spans"](spark, small).count() == want
