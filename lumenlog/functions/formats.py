"""Gates and defaults per diagnostic format, and a registry for further ones.

A gate is a cheap test whether a record may be worth keeping, a set of
defaults what the layout of a record says before its text is searched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumenlog.functions import events
from lumenlog.functions.text import blank_to_null, level, level_of_status

Defaults = dict[str, Column]

IMPORTANT = ("WARNING", "ERROR", "CRITICAL")
# Patterns of the data formats.
ACCESS = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)(?:\s+HTTP/[^\"]+)?"\s+(\d{3})\s+'
WEB_ERROR = r"(?i)^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[([^\]]+)\]"
APACHE_ERROR = r"(?i)^\[([A-Z][a-z]{2}\s+[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?\s+\d{4})\]\s+\[[^\]]*:([^\]]+)\]"
SYSLOG_5424 = r"^<(\d{1,3})>\d+\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+.*$"
SYSLOG_3164 = r"^<(\d{1,3})>([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\[]+)(?:\[\d+\])?:\s*.*$"
CRI = r"^(\S+)\s+(stdout|stderr)\s+([FP])\s+([\s\S]*)$"
LIFECYCLE = r"(?i)^(?:START|END|REPORT)\s+RequestId:\s*(\S+)"
APPLICATION = r"(?i)^(\d{4}-\d{2}-\d{2}T\S+)\s+([A-Za-z0-9-]+)\s+(TRACE|DEBUG|INFO|NOTICE|WARNING|WARN|ERROR|ERR|SEVERE|FATAL|CRITICAL|ALERT|EMERG(?:ENCY)?)\b"
EXPLICIT_SERVICE = r"(?i)\b(?:service(?:[_-]?name)?|app|component)[\s=:\"']+"
SCHEMES = ("http", "https", "h2", "grpc", "grpcs")
CI_ERRORS = ("##[error]", "build failed", "deployment failed")
CRASH_MARKS = ("crash report", "core dumped", "fatal signal")


def _any(low: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (low.contains(m) for m in marks))


def _group(text: Column, pattern: str, k: int) -> Column:
    return blank_to_null(F.regexp_extract(text, pattern, k))


def _kept(found: Column) -> Column:
    return F.coalesce(found.isin(*IMPORTANT), F.lit(False))


def gateway_fields(text: Column) -> Column:
    """The fields of a load balancer line, quotes taken off; NULL for other lines."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r'("[^"]*"|\S+)'), 1), lambda x: F.regexp_replace(x, '^"|"$', ""))
    return events.let(parts, lambda p: F.when((F.size(p) > 12) & F.lower(F.get(p, F.lit(0))).isin(*SCHEMES), p))


def _web(text: Column) -> Defaults:
    status = _group(text, ACCESS, 5).try_cast("int")
    stated = F.coalesce(_group(text, WEB_ERROR, 2), _group(text, APACHE_ERROR, 2))
    time = F.coalesce(_group(text, ACCESS, 2), _group(text, WEB_ERROR, 1), _group(text, APACHE_ERROR, 1))
    return {"time_raw": time, "host": _group(text, ACCESS, 1), "endpoint": _group(text, ACCESS, 4), "http_status": status, "level": F.coalesce(level_of_status(status), events.let(stated, level))}


def _web_gate(text: Column) -> Column:
    return events.let(_web(text)["level"], lambda found: F.when(found.isNotNull(), _kept(found)).otherwise(events.may_be_important(text)))


def _syslog(text: Column) -> Defaults:
    both = lambda a, b: F.coalesce(_group(text, SYSLOG_5424, a), _group(text, SYSLOG_3164, b))
    priority = both(1, 1).try_cast("int")
    return {"time_raw": both(2, 2), "level": F.when(priority.isNotNull(), events.syslog_level(priority)), "host": both(3, 3), "service": both(4, 4)}


def _syslog_gate(text: Column) -> Column:
    return events.let(_syslog(text)["level"], lambda found: F.when(found.isNotNull(), _kept(found)).otherwise(events.may_be_important(text)))


def _container(text: Column) -> Defaults:
    """Standard error means ERROR unless the body states a level; a body that is JSON gives its own fields."""
    body = _group(text, CRI, 4)
    v = F.try_parse_json(F.when(body.rlike(r"^\s*\{"), body))
    pick = lambda *names: F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names))
    stated = events.let(pick("level", "severity", "log_level", "lvl", "severityText"), level)
    own = F.coalesce(stated, F.when(v.isNull(), events.let(body, events.first_level)))
    return {"time_raw": _group(text, CRI, 1), "level": F.coalesce(own, F.when(_group(text, CRI, 2) == "stderr", "ERROR")), "service": pick("service", "service.name", "app"), "trace_id": pick("trace_id", "traceId"), "request_id": pick("request_id", "requestId")}


def _gateway(text: Column) -> Defaults:
    at = lambda k: events.let(gateway_fields(text), lambda p: F.get(p, F.lit(k)))
    status = at(8).try_cast("int")
    return {"time_raw": at(1), "http_status": status, "level": level_of_status(status), "endpoint": _group(F.coalesce(at(12), F.lit("")), r"^\S+\s+(\S+)", 1)}


def _gateway_gate(text: Column) -> Column:
    """A line whose status is no number stays."""
    whole = gateway_fields(text)
    status = events.let(whole, lambda p: F.get(p, F.lit(8))).try_cast("int")
    return F.when(whole.isNull(), events.may_be_important(text)).otherwise(F.coalesce(status >= 400, F.lit(True)))


def _broker(text: Column) -> Defaults:
    low = F.lower(text)
    named = F.when(low.contains("rabbitmq") | low.contains("amqp"), "rabbitmq").when(low.contains("kafka"), "kafka").otherwise("message-broker")
    return {"service": F.when(~text.rlike(EXPLICIT_SERVICE), named)}


def _serverless(text: Column) -> Defaults:
    cycle = _group(text, LIFECYCLE, 1)
    return {
        "time_raw": F.when(cycle.isNull(), _group(text, APPLICATION, 1)), "request_id": F.coalesce(cycle, _group(text, APPLICATION, 2)),
        "level": F.when(cycle.isNotNull(), "INFO").otherwise(events.let(_group(text, APPLICATION, 3), level)), "service": F.when(~text.rlike(EXPLICIT_SERVICE), "aws-lambda"),
    }


def _serverless_gate(text: Column) -> Column:
    stated = events.let(_group(text, APPLICATION, 3), level)
    return F.when(text.rlike(LIFECYCLE), False).when(stated.isNotNull(), _kept(stated)).otherwise(events.may_be_important(text))


def _ci(text: Column) -> Defaults:
    low = F.lower(text)
    return {"level": F.when(_any(low, CI_ERRORS), "ERROR").when(low.contains("##[warning]"), "WARNING")}


def _database(text: Column) -> Defaults:
    return {"level": F.when(_any(F.lower(text), ("slow query", "query_time:")), "WARNING")}


def _stack(text: Column) -> Defaults:
    return {"level": F.when(_any(F.lower(text), CRASH_MARKS), "ERROR")}


def _none(text: Column) -> Defaults:
    return {}


@dataclass(frozen=True)
class Format:
    gate: Callable[[Column], Column]
    defaults: Callable[[Column], Defaults] = _none


FORMATS: dict[str, Format] = {
    "generic": Format(events.may_be_important),
    "web_server": Format(_web_gate, _web),
    "syslog": Format(_syslog_gate, _syslog),
    "container": Format(lambda t: t.contains(" stderr ") | events.may_be_important(t), _container),
    "cloud_gateway": Format(_gateway_gate, _gateway),
    "message_broker": Format(events.may_be_important, _broker),
    "serverless": Format(_serverless_gate, _serverless),
    "ci_cd": Format(lambda t: _any(F.lower(t), (*CI_ERRORS, "##[warning]")), _ci),
    "stack_trace": Format(lambda t: _any(F.lower(t), CRASH_MARKS[:2]) | events.may_be_important(t), _stack),
    "database": Format(lambda t: F.lit(True), _database),
}


def register_format(name: str, gate: Callable[[Column], Column], defaults: Callable[[Column], Defaults] = _none) -> None:
    """Add or replace a format: records of this source format pass the gate and take the defaults."""
    FORMATS[name] = Format(gate, defaults)


def gate(source_format: Column, text: Column) -> Column:
    """Whether a record may be worth keeping; those of formats without a gate are. NULL texts are not."""
    found = None
    for name, f in FORMATS.items():
        found = F.when(source_format == name, f.gate(text)) if found is None else found.when(source_format == name, f.gate(text))
    return F.coalesce(found.otherwise(text.isNotNull()), F.lit(False))


def defaults(source_format: Column, text: Column) -> Defaults:
    """What the layouts of the formats say, by field."""
    fields: dict[str, Column] = {}
    for name, f in FORMATS.items():
        for field, value in f.defaults(text).items():
            here = F.when(source_format == name, value)
            fields[field] = F.coalesce(fields[field], here) if field in fields else here
    return fields


def normalise(df: DataFrame, text: str, source_format: str, *, gated: bool = True) -> DataFrame:
    """Canonical fields of text records of any format.

    Records that the gate of their format turns away are left out where
    ``gated``. What the layout says goes before what the text says; a record
    without level that holds a stack frame is an ERROR.
    """
    if gated:
        df = df.filter(gate(F.col(source_format), F.col(text)))
    said = defaults(F.col(source_format), F.col(text))
    df = df.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in said.items())))).alias("_said"))
    read = events.text_event(df, text, F.col("_said.level"))
    frames = F.when(events.contains_frame(F.col(text)), "ERROR")
    out = {k: F.coalesce(F.col(f"_said.{k}"), F.col(k)) for k in said if k not in ("level", "time_raw")}
    return read.withColumns({**out, "level": F.coalesce("level", frames), "time_raw": F.col("_said.time_raw")}).drop("_said")
