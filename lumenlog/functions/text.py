"""Column builders for levels, identifiers, messages and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NONE = "__none__"
MAX_FINGERPRINT = 255

# Fixed values of the data format: level spellings and their canonical level.
LEVEL_ALIASES = {
    "WARN": "WARNING",
    "WARNING": "WARNING",
    "ERR": "ERROR",
    "ERROR": "ERROR",
    "SEVERE": "CRITICAL",
    "FATAL": "CRITICAL",
    "CRITICAL": "CRITICAL",
    "ALERT": "CRITICAL",
    "EMERG": "CRITICAL",
    "EMERGENCY": "CRITICAL",
    "NOTICE": "INFO",
}

# Patterns of the data format.
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
NUMBER = r"(?U)\b\d+\b"
LEVEL_WORD = (
    r"(?i)(?<![A-Za-z])(TRACE|DEBUG|INFO|NOTICE|WARNING|WARN|ERROR|ERR|SEVERE|FATAL|CRITICAL|ALERT|EMERG(?:ENCY)?)(?![A-Za-z])"
)
EXCEPTION = r"\b([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception|Failure))\b(?::[^\S\n]*([^\n]*))?"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def level(c: Column) -> Column:
    """Canonical level of a level text or number; NULL for NULL and blank."""
    up = F.upper(strip(c.cast("string")))
    num = F.when(up.rlike(r"^\d{1,18}$"), up.try_cast("bigint"))
    aliased = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LEVEL_ALIASES.items() for x in kv)), up), up)
    by_number = F.when(num >= 50, "CRITICAL").when(num >= 40, "ERROR").when(num >= 30, "WARNING").when(num >= 20, "INFO").otherwise("DEBUG")
    return F.when(num.isNotNull(), by_number).otherwise(blank_to_null(aliased))


def otel_level(c: Column) -> Column:
    """Level of an OpenTelemetry severity number or text."""
    text = strip(c.cast("string"))
    num = F.when(text.rlike(r"^\d{1,18}$"), text.try_cast("bigint"))
    by_number = (
        F.when(num <= 0, F.lit(None).cast("string"))
        .when(num >= 21, "CRITICAL")
        .when(num >= 17, "ERROR")
        .when(num >= 13, "WARNING")
        .when(num >= 9, "INFO")
        .when(num >= 5, "DEBUG")
        .otherwise("TRACE")
    )
    return F.when(num.isNotNull(), by_number).otherwise(level(c))


def level_of_status(status: Column) -> Column:
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").when(status.isNotNull(), "INFO")


def first_level(c: Column) -> Column:
    """The first level word of a text, canonical."""
    return level(blank_to_null(F.regexp_extract(c, LEVEL_WORD, 1)))


def normalize_message(c: Column) -> Column:
    """Message with UUIDs and whole numbers masked, lower case, stripped."""
    return strip(F.lower(F.regexp_replace(F.regexp_replace(c, UUID, "<uuid>"), NUMBER, "<number>")))


def bounded_fingerprint(c: Column) -> Column:
    return F.when(F.length(c) <= MAX_FINGERPRINT, c).otherwise(
        F.concat(F.substring(c, 1, MAX_FINGERPRINT - 65), F.lit(":"), F.sha2(c, 256))
    )


def fingerprint(exception_type: Column, exception_message: Column, level_: Column, raw: Column) -> Column:
    """Fingerprint of an event: exception type and message, else level and line."""
    by_exception = F.concat(F.lower(exception_type), F.lit(":"), F.coalesce(normalize_message(exception_message), F.lit("")))
    by_line = F.concat(F.coalesce(blank_to_null(level_), F.lit("event")), F.lit(":"), normalize_message(raw))
    return bounded_fingerprint(F.when(exception_type.isNotNull(), by_exception).otherwise(by_line))


def same_fingerprint(c: Column) -> Column:
    """One spelling for stored fingerprints.

    Masks, case and blanks are brought to the form that ``fingerprint`` would
    have stored: the type and the message are parted by a bare colon and runs
    of blanks are one.
    """
    masked = normalize_message(F.regexp_replace(c, r"(?i)<\s*(uuid|number)\s*>", "<$1>"))
    one = F.regexp_replace(masked, r"(?U)\s+", " ")
    return blank_to_null(F.regexp_replace(one, r"^([^:\s]*)\s*:\s*", "$1:"))


def present_id(c: Column) -> Column:
    """An identifier in lower case without surrounding blanks; NULL if missing."""
    v = F.lower(strip(c))
    return F.when((v != "") & (v != NONE), v)


def correlation_key(trace: Column, request: Column, span: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(x, F.lit(NONE)) for x in (trace, request, span))), 256)


def same_key(key: Column, trace: Column, request: Column, span: Column) -> Column:
    """One spelling of a stored correlation key; rebuilt from the ids if missing."""
    digest = blank_to_null(F.regexp_extract(F.lower(F.coalesce(key, F.lit(""))), r"([0-9a-f]{64})", 1))
    return F.coalesce(digest, correlation_key(present_id(trace), present_id(request), present_id(span)))
