"""Format detection of a text sample: the first format whose marks are found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

SAMPLE_BYTES = 65_536
# Suffixes, content types and marks of the formats.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp")
IMAGE_TYPES = ("image/png", "image/jpeg", "image/webp")
TEXT_SUFFIXES = (".log", ".txt", ".json", ".jsonl", ".ndjson", ".har", ".out", ".err")
TEXT_TYPES = ("text/plain", "application/json", "application/x-ndjson", "application/jsonlines")
OTLP_MARKS = ('"resourcelogs":', '"resourcespans":', '"resource_logs":', '"resource_spans":')
STACK_MARKS = ("traceback (most recent call last)", "exception in thread", "caused by:", "segmentation fault", "panic:", "core dumped", "crash report", "fatal signal")
CI_MARKS = ("##[error]", "##[warning]", "github_actions", "gitlab-runner", "jenkins", "build failed", "deployment failed")
DATABASE_MARKS = ("query_time:", "slow query", "sqlstate[", "deadlock detected", "ora-", "postgresql:", "mysql, version")
BROKER_MARKS = ("kafka", "rabbitmq", "amqp", "consumer group", "rebalance", "broker id")
LAMBDA_MARKS = ("START RequestId:", "END RequestId:", "REPORT RequestId:")
LAMBDA_JSON_MARKS = ('"logstream":', '"loggroup":', '"logevents":', '"@message":')
GATEWAY_MARKS = ("api gateway", "cloudfront", "elasticloadbalancing", " elb ")
SYSLOG = r"(?md)^<\d{1,3}>(?:\d+\s+(?:\d{4}-\d{2}-\d{2}T|-\s+)|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
ACCESS = r'(?md)^\S+\s+\S+\s+\S+\s+\[[^\]]+\]\s+"(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+\S+\s+HTTP/\d(?:\.\d)?"\s+\d{3}\s+'
CRI = r"(?md)^\d{4}-\d{2}-\d{2}T\S+\s+(?:stdout|stderr)\s+[FP]\s+"
NGINX = r"(?mdi)^\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\s+\[(?:warn|error|crit|alert|emerg)\]"
APACHE = r"(?mdi)^\[[A-Z][a-z]{2}\s+[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?\s+\d{4}\]\s+\[[^\]]*:(?:warn|error|crit|alert|emerg)\]"
FRAME = r"(?md)^\s+at\s+.*[^\s:]:\d+(?::\d+)?\)?$"
BALANCER = r"(?md)^(?:http|https|h2|grpc|grpcs)\s+\d{4}-\d{2}-\d{2}T\S+\s+\S+\s+"
JSON_HEAD = r'^[{\[]\s*(?:[}\]]|"[^"]+"\s*:|[{\[])'


def effective_suffix(name: Column) -> Column:
    """Lower-case suffix; a number behind another suffix is a rotation mark."""
    return F.regexp_extract(F.lower(name), r"(\.[^./]+?)(?:\.\d+)?$", 1)


def _any(c: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(m) for m in marks))


def looks_like_json(text: Column) -> Column:
    """The text opens with a bracket and its first line or its head is JSON."""
    head = F.ltrim(text)
    first = F.trim(F.regexp_extract(head, r"^\s*([^\n\r]+)", 1))
    return head.rlike(r"^[{\[]") & (F.try_parse_json(first).isNotNull() | head.rlike(JSON_HEAD))


def cloudfront_fields(text: Column) -> Column:
    """A field header that names date, time, status and path and an edge field."""
    line = F.lower(F.regexp_extract(text, r"(?mdi)^﻿?#fields:([^\n]*)", 1))
    names = F.split(F.trim(line), r"\s+")
    need = F.array(*(F.lit(x) for x in ("date", "time", "sc-status", "cs-uri-stem")))
    edge = F.array(*(F.lit(x) for x in ("x-edge-location", "x-edge-request-id", "x-edge-result-type")))
    return (F.size(F.array_except(need, names)) == 0) & F.arrays_overlap(names, edge)


def detect_format(sample: Column, name: Column | None = None, mime: Column | None = None) -> Column:
    """Format of a sample; NULL samples are generic."""
    text = F.coalesce(sample, F.lit(""))
    low = F.lower(text)
    tight = F.regexp_replace(low, r"\s+", "")
    suffix = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"(\.[^./]+)$", 1) if name is not None else F.lit("")
    kind = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1))) if mime is not None else F.lit("")
    json = looks_like_json(text)
    opens = F.ltrim(text).rlike(r"^[{\[]")
    return (
        F.when(suffix.isin(*IMAGE_SUFFIXES) | kind.isin(*IMAGE_TYPES), "image")
        .when(json & _any(tight, OTLP_MARKS), "opentelemetry")
        .when(json & (tight.contains('"kubernetes":') | (tight.contains('"log":') & _any(tight, ('"stream":', '"container_id":')))), "container")
        .when(json & tight.contains('"entries":') & (low.contains('"starteddatetime"') | tight.contains('"request":')), "browser")
        .when(cloudfront_fields(text), "cloud_gateway")
        .when(text.rlike(SYSLOG), "syslog")
        .when(text.rlike(CRI), "container")
        .when(text.rlike(ACCESS) | text.rlike(NGINX) | text.rlike(APACHE), "web_server")
        .when(_any(low, STACK_MARKS) | text.rlike(FRAME), "stack_trace")
        .when(_any(low, CI_MARKS), "ci_cd")
        .when(_any(low, DATABASE_MARKS), "database")
        .when(_any(low, BROKER_MARKS), "message_broker")
        .when(_any(text, LAMBDA_MARKS) | (json & tight.contains('"awsrequestid":')) | (json & _any(tight, LAMBDA_JSON_MARKS)), "serverless")
        .when(_any(low, GATEWAY_MARKS) | (json & _any(tight, ('"requestcontext":', '"elb_status_code":'))) | text.rlike(BALANCER), "cloud_gateway")
        .when(json, "json")
        .when((suffix == ".har") & opens, "browser")
        .when(kind.isin("application/json", "application/x-ndjson") & opens, "json")
        .otherwise("generic")
    )


def text_like(content: Column) -> Column:
    """Bytes that are not empty, valid UTF-8 and free of NUL."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.coalesce((F.octet_length(content) > 0) & text.isNotNull() & ~text.contains("\0"), F.lit(False))


def supported(content: Column, name: Column, mime: Column) -> Column:
    """Whether an upload is taken: an image, text by suffix or type, or text of a known format."""
    suffix = effective_suffix(F.coalesce(name, F.lit("")))
    kind = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    known = ~detect_format(F.try_validate_utf8(content.cast("string")), name, mime).isin("generic", "image")
    return suffix.isin(*IMAGE_SUFFIXES) | kind.isin(*IMAGE_TYPES) | (text_like(content) & (suffix.isin(*TEXT_SUFFIXES) | kind.isin(*TEXT_TYPES) | known))
