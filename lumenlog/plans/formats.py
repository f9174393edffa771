"""Queries of the per-format gates and defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions import events, formats
from lumenlog.plans.parsing import _marks, _re
from lumenlog.plans.relational import level_sql
from lumenlog.session import table

_FRAMES = " OR ".join(f"regexp_matches(t, '{_re(p)}')" for p in (events.JAVA_FRAME, events.NODE_FRAME, events.PLACE, events.LOOSE_FRAME))
_GENERIC = f"({_marks('l', events.IMPORTANT_MARKS)} OR (contains(l, 'status') AND regexp_matches(t, '{_re(events.IMPORTANT_STATUS)}')) OR {_FRAMES})"
_group = lambda p, k, c="t": f"nullif(regexp_extract({c}, '{_re(p)}', {k}), '')"
_SYSLOG_LEVEL = "CASE CAST({p} AS INT) % 8 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'WARNING' WHEN 5 THEN 'INFO' WHEN 6 THEN 'INFO' ELSE 'DEBUG' END"
_STATUS_LEVEL = "CASE WHEN {s} >= 500 THEN 'ERROR' WHEN {s} >= 400 THEN 'WARNING' WHEN {s} IS NOT NULL THEN 'INFO' END"
_KEPT = "coalesce({l} IN ('WARNING', 'ERROR', 'CRITICAL'), false)"

_status = f"try_cast({_group(formats.ACCESS, 5)} AS INT)"
_stated = f"coalesce({_group(formats.WEB_ERROR, 2)}, {_group(formats.APACHE_ERROR, 2)})"
_web_level = f"coalesce({_STATUS_LEVEL.format(s=_status)}, {level_sql(_stated)})"
_either = lambda a, b: f"coalesce({_group(formats.SYSLOG_5424, a)}, {_group(formats.SYSLOG_3164, b)})"
_pri = _either(1, 1)
_sys_level = f"CASE WHEN {_pri} IS NOT NULL THEN {_SYSLOG_LEVEL.format(p=_pri)} END"
_first = level_sql("nullif(regexp_extract({c}, '(?i)(?:^|[^A-Za-z])(TRACE|DEBUG|INFO|NOTICE|WARNING|WARN|ERROR|ERR|SEVERE|FATAL|CRITICAL|ALERT|EMERG(?:ENCY)?)(?:[^A-Za-z]|$)', 1), '')").replace("{c}", _group(formats.CRI, 4))
_cri_level = f"coalesce({_first}, CASE WHEN {_group(formats.CRI, 2)} = 'stderr' THEN 'ERROR' END)"
_parts = "list_transform(regexp_extract_all(t, '(\"[^\"]*\"|\\S+)', 1), lambda x: regexp_replace(x, '^\"|\"$', '', 'g'))"
_fields = f"CASE WHEN len({_parts}) > 12 AND lower({_parts}[1]) IN ({', '.join(repr(x) for x in formats.SCHEMES)}) THEN {_parts} END"
_gw_status = f"try_cast(({_fields})[9] AS INT)"
_application = level_sql(_group(formats.APPLICATION, 3))
_explicit = f"regexp_matches(t, '{_re(formats.EXPLICIT_SERVICE)}')"

#: format -> its columns in SQL; ``kept`` is the gate.
_SQL = {
    "generic": {"kept": _GENERIC},
    "web_server": {"kept": f"CASE WHEN {_web_level} IS NOT NULL THEN {_KEPT.format(l=_web_level)} ELSE {_GENERIC} END", "time_raw": f"coalesce({_group(formats.ACCESS, 2)}, {_group(formats.WEB_ERROR, 1)}, {_group(formats.APACHE_ERROR, 1)})", "host": _group(formats.ACCESS, 1), "endpoint": _group(formats.ACCESS, 4), "http_status": _status, "level": _web_level},
    "syslog": {"kept": f"CASE WHEN {_sys_level} IS NOT NULL THEN {_KEPT.format(l=_sys_level)} ELSE {_GENERIC} END", "time_raw": _either(2, 2), "level": _sys_level, "host": _either(3, 3), "service": _either(4, 4)},
    "container": {"kept": f"(contains(t, ' stderr ') OR {_GENERIC})", "time_raw": _group(formats.CRI, 1), "level": _cri_level},
    "cloud_gateway": {"kept": f"CASE WHEN {_fields} IS NULL THEN {_GENERIC} ELSE coalesce({_gw_status} >= 400, true) END", "time_raw": f"({_fields})[2]", "http_status": _gw_status, "level": _STATUS_LEVEL.format(s=_gw_status), "endpoint": f"nullif(regexp_extract(coalesce(({_fields})[13], ''), '^\\S+\\s+(\\S+)', 1), '')"},
    "message_broker": {"kept": _GENERIC, "service": f"CASE WHEN NOT {_explicit} THEN CASE WHEN contains(l, 'rabbitmq') OR contains(l, 'amqp') THEN 'rabbitmq' WHEN contains(l, 'kafka') THEN 'kafka' ELSE 'message-broker' END END"},
    "serverless": {"kept": f"CASE WHEN regexp_matches(t, '{_re(formats.LIFECYCLE)}') THEN false WHEN {_application} IS NOT NULL THEN {_KEPT.format(l=_application)} ELSE {_GENERIC} END", "time_raw": f"CASE WHEN {_group(formats.LIFECYCLE, 1)} IS NULL THEN {_group(formats.APPLICATION, 1)} END", "request_id": f"coalesce({_group(formats.LIFECYCLE, 1)}, {_group(formats.APPLICATION, 2)})", "level": f"CASE WHEN {_group(formats.LIFECYCLE, 1)} IS NOT NULL THEN 'INFO' ELSE {_application} END", "service": f"CASE WHEN NOT {_explicit} THEN 'aws-lambda' END"},
    "ci_cd": {"kept": _marks("l", (*formats.CI_ERRORS, "##[warning]")), "level": f"CASE WHEN {_marks('l', formats.CI_ERRORS)} THEN 'ERROR' WHEN contains(l, '##[warning]') THEN 'WARNING' END"},
    "stack_trace": {"kept": f"({_marks('l', formats.CRASH_MARKS[:2])} OR {_GENERIC})", "level": f"CASE WHEN {_marks('l', formats.CRASH_MARKS)} THEN 'ERROR' END"},
    "database": {"kept": "true", "level": f"CASE WHEN {_marks('l', ('slow query', 'query_time:'))} THEN 'WARNING' END"},
}


def _of(name: str):
    def run(spark, d):
        """Gate and defaults of one format over every line of the files."""
        f, text = formats.FORMATS[name], F.col("raw_line")
        said = {k: c for k, c in f.defaults(text).items() if k in _SQL[name]}
        lines = table(spark, d, "raw_lines").filter("raw_line is not null")
        return lines.select("artifact_id", "line_number", f.gate(text).alias("kept"), *(c.alias(k) for k, c in said.items()))

    return run


def format_gates(spark, d):
    e = table(spark, d, "parsed_events").filter("raw_line is not null")
    return e.select("event_id", formats.gate(F.col("source_format"), F.col("raw_line")).alias("kept"))


def format_events(spark, d):
    """Canonical fields of every event that its format's gate lets pass."""
    e = table(spark, d, "parsed_events").select("event_id", "raw_line", "source_format")
    return formats.normalise(e, "raw_line", "source_format").withColumn("frames", F.size("stack_frames")).drop("raw_line", "stack_frames")


QUERIES = {f"format_{n}": _of(n) for n in _SQL} | {"format_gates": format_gates, "format_events": format_events}
ORACLES = {f"format_{n}": f"SELECT artifact_id, line_number, {', '.join(f'{e} AS {c}' for c, e in sql.items())} FROM (SELECT artifact_id, line_number, raw_line AS t, lower(raw_line) AS l FROM raw_lines WHERE raw_line IS NOT NULL)" for n, sql in _SQL.items()}
ORACLES["format_gates"] = f"SELECT event_id, CASE source_format {' '.join(f'WHEN {n!r} THEN {sql["kept"]}' for n, sql in _SQL.items())} ELSE true END AS kept FROM (SELECT event_id, source_format, raw_line AS t, lower(raw_line) AS l FROM parsed_events WHERE raw_line IS NOT NULL)"
