"""Retention, rollup, identity and bounded selection of diagnostic events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenlog.functions.text import NONE, blank_to_null, correlation_key, fingerprint, level
from lumenlog.operators.ranking import position
from lumenlog.session import cut

IMPORTANT = ("WARNING", "WARN", "ERROR", "CRITICAL")
# How many characters a stored column holds.
WIDTHS = {"event_type": 100, "severity": 50, "trace_id": 255, "request_id": 255, "span_id": 255, "service": 255, "module": 255, "host": 255, "pod": 255, "endpoint": 500, "source_format": 50}
#: Bytes of a representative line.
LINE_BYTES = 65_535


def worth_keeping(level_: Column, exception_type: Column, frames: Column, status: Column, fmt: Column, trace: Column, span: Column) -> Column:
    """Whether a parsed record is evidence; unknown counts as no."""
    told = F.coalesce(level_.isin(*IMPORTANT), F.lit(False)) | exception_type.isNotNull() | F.coalesce(F.size(frames) > 0, F.lit(False)) | F.coalesce(status >= 400, F.lit(False))
    return told | (F.coalesce(fmt == "opentelemetry", F.lit(False)) & (trace.isNotNull() | span.isNotNull()))


def canonical_events(events: DataFrame) -> DataFrame:
    """``parsed_events`` with canonical level, blank texts missing and a fingerprint."""
    texts = ("trace_id", "request_id", "span_id", "service", "module", "host", "pod", "endpoint", "exception_type", "exception_message", "source_format")
    e = events.withColumns({c: blank_to_null(F.col(c)) for c in texts} | {"level": level(F.col("level"))})
    return e.withColumn("fingerprint", fingerprint(F.col("exception_type"), F.col("exception_message"), F.col("level"), F.col("raw_line")))


def retained(events: DataFrame) -> DataFrame:
    """Canonical events that are evidence."""
    e = canonical_events(events)
    return e.filter(worth_keeping(*(F.col(c) for c in ("level", "exception_type", "stack_frames", "http_status", "source_format", "trace_id", "span_id"))))


def _bounded(c: str, width: int) -> Column:
    return F.substring(F.col(c), 1, width)


def rollup(events: DataFrame, *, time: str = "received_at") -> DataFrame:
    """One row per (analysis, artifact, fingerprint, trace, request, span).

    Counts, first and last time and line, and of every other column the first
    value that is not missing in the order of line number and event id. The
    key texts are cut to their stored width before they are compared. All
    aggregates are associative, so map tasks combine before the exchange.
    """
    order = F.struct("line_number", "event_id")
    first = lambda c, width=None: F.min(F.when(c.isNotNull(), F.struct(order.alias("o"), (F.substring(c, 1, width) if width else c).alias("v"))))["v"]
    keys = {"analysis_id": F.col("analysis_id"), "artifact_id": F.col("artifact_id"), "fingerprint": _bounded("fingerprint", 255)} | {c: _bounded(c, 255) for c in ("trace_id", "request_id", "span_id")}
    return (
        events.groupBy(*(e.alias(k) for k, e in keys.items()))
        .agg(
            F.count(F.lit(1)).alias("occurrence_count"),
            F.min(time).alias("first_seen"),
            F.max(time).alias("last_seen"),
            F.min("line_number").alias("first_line_number"),
            F.max("line_number").alias("last_line_number"),
            first(F.col("exception_type"), 100).alias("event_type"),
            first(F.col("level"), 50).alias("severity"),
            *(first(F.col(c), WIDTHS[c]).alias(c) for c in ("service", "module", "host", "pod", "endpoint", "source_format")),
            first(F.col("http_status")).alias("http_status"),
            first(F.col("raw_line")).alias("representative_line"),
        )
        .withColumn("correlation_key", correlation_key(F.col("trace_id"), F.col("request_id"), F.col("span_id")))
        .withColumn("representative_line", bounded_bytes(F.col("representative_line"), LINE_BYTES))
    )


def merge_rollups(batches: DataFrame) -> DataFrame:
    """Merge rollups of several batches (a ``batch`` column orders them).

    Counts add up, times and lines widen, missing values are filled from later
    batches. The result equals one rollup over all events.
    """
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.struct("first_line_number", "batch").alias("o"), F.col(c).alias("v"))))["v"]
    keys = ["analysis_id", "artifact_id", "fingerprint", "trace_id", "request_id", "span_id", "correlation_key"]
    return batches.groupBy(*keys).agg(
        F.sum("occurrence_count").alias("occurrence_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min("first_line_number").alias("first_line_number"), F.max("last_line_number").alias("last_line_number"),
        *(first(c).alias(c) for c in ("event_type", "severity", "service", "module", "host", "pod", "endpoint", "source_format", "http_status", "representative_line")),
    )


def identity(evidence: DataFrame) -> DataFrame:
    """(id, identity, match_type, strength): by trace, else by request, else by row."""
    trace, request = blank_to_null(F.col("trace_id")), blank_to_null(F.col("request_id"))
    by_trace, by_request = trace.isNotNull() & (trace != NONE), request.isNotNull() & (request != NONE)
    return evidence.select(
        "id",
        F.when(by_trace, F.concat(F.lit("trace:"), trace)).when(by_request, F.concat(F.lit("request:"), request)).otherwise(F.concat(F.lit("unresolved:"), F.col("id").cast("string"))).alias("identity"),
        F.when(by_trace, "trace_id").when(by_request, "request_id").otherwise("unresolved").alias("match_type"),
        F.when(by_trace, 1.0).when(by_request, 0.9).otherwise(0.0).alias("strength"),
    )


def bounded_bytes(c: Column, limit: int) -> Column:
    """Longest prefix of whole characters within so many UTF-8 bytes.

    One character has at most four bytes, so of the cut bytes at most three
    at the end are an unfinished character.
    """
    raw = F.substring(F.encode(c, "UTF-8"), 1, limit)
    tries = [F.try_validate_utf8(F.substring(F.encode(c, "UTF-8"), 1, limit - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.coalesce(*tries, F.when(raw.isNotNull(), F.lit(""))))


def duplicate_artifacts(artifacts: DataFrame) -> DataFrame:
    """(id, canonical_id): artifacts whose bytes came before in the same analysis."""
    w = Window.partitionBy("analysis_id", "content_sha256").orderBy("file_position", "id")
    known = artifacts.filter(F.col("content_sha256").isNotNull() & (F.col("content_sha256") != ""))
    return known.select("id", "analysis_id", F.first("id").over(w).alias("canonical_id")).filter("id <> canonical_id")


def bridges(evidence: DataFrame, column: str) -> DataFrame:
    """(analysis_id, value, artifacts): identifiers found in several artifacts."""
    rows = evidence.select("analysis_id", blank_to_null(F.col(column)).alias("value"), "artifact_id").filter("value is not null")
    return rows.groupBy("analysis_id", "value").agg(F.countDistinct("artifact_id").alias("artifacts")).filter("artifacts > 1")


def severity_rank(c: Column) -> Column:
    up = F.upper(F.coalesce(c, F.lit("")))
    return F.when(up.isin("CRITICAL", "FATAL"), 4).when(up == "ERROR", 3).when(up.isin("WARNING", "WARN"), 2).otherwise(0)


def selection_priority(evidence: DataFrame) -> list[Column]:
    """Order of evidence for a bounded context: severity, count, time, id."""
    return [severity_rank(F.col("severity")).desc(), F.coalesce("occurrence_count", F.lit(0)).desc(), F.col("first_seen").asc_nulls_first(), F.col("id")]


def round_robin(evidence: DataFrame) -> DataFrame:
    """Add turn (the row's place within its artifact) and place (order over all turns)."""
    turned = position(evidence, ["analysis_id", "artifact_id"], selection_priority(evidence), name="turn")
    return position(turned, ["analysis_id"], [F.col("turn"), F.col("artifact_id"), F.col("id")], name="place")


def greedy_fill(rows: list[tuple[int, int, int]], records: int, size: int) -> list[int]:
    """Ids taken from (artifact, id, bytes) in turn order.

    A row that does not fit is passed over and its artifact leaves the
    rotation; at least one row is taken.
    """
    taken: list[int] = []
    used, out, last_turn = 0, set(), {}
    for artifact, ident, n in rows:
        if artifact in out:
            continue
        if len(taken) >= records or used >= size:
            break
        if taken and used + n > size:
            out.add(artifact)
            continue
        taken.append(ident)
        used += n
    return taken


def bounded_selection(evidence: DataFrame, *, records: int = 200, size: int = 2 * 1024 * 1024) -> DataFrame:
    """(analysis_id, id): bounded evidence of each analysis, artifacts taking turns.

    Rows beyond place ``records`` of the turns can only be reached when
    earlier rows were passed over for their size; each analysis sends its
    places in order to one greedy pass, which stops at its bounds. Analyses
    within both bounds keep all their rows and take no part in the pass.
    """
    rows = evidence.withColumn("_bytes", F.coalesce(F.octet_length("representative_line"), F.lit(0)))
    totals = rows.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("_bytes").alias("_b"))
    within = totals.filter((F.col("_n") <= records) & (F.col("_b") <= size)).select("analysis_id")
    small = rows.join(within, "analysis_id", "left_semi").select("analysis_id", "id")
    placed = cut(round_robin(rows.join(within, "analysis_id", "left_anti")).select("analysis_id", "artifact_id", "id", "_bytes", "place"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        ids = greedy_fill(list(zip(pdf["artifact_id"], pdf["id"], pdf["_bytes"], strict=True)), records, size)
        return pd.DataFrame({"analysis_id": [key[0]] * len(ids), "id": ids})

    kinds = f"analysis_id {evidence.schema['analysis_id'].dataType.simpleString()}, id {evidence.schema['id'].dataType.simpleString()}"
    return small.unionByName(placed.groupBy("analysis_id").applyInPandas(run, kinds))


def fold_attributes(leaves: list[tuple[str, object]], budget: int, important: frozenset[str]) -> dict[str, object]:
    """Attributes within a byte budget; important ones push out the others.

    A newcomer that does not fit removes less important ones, oldest first,
    and these stay out even if it then does not fit either.
    """
    kept: dict[str, tuple[int, int, object]] = {}
    used = 0
    for path, value in leaves:
        rank = 2 if any(w in path.lower() for w in important) else 1
        cost = len(path.encode()) + len(str(value).encode()) + 6
        if used + cost > budget:
            for other in [k for k, (r, _, _) in kept.items() if r < rank]:
                if used + cost <= budget:
                    break
                used -= kept.pop(other)[1]
        if used + cost <= budget and path not in kept:
            kept[path] = (rank, cost, value)
            used += cost
    return {k: v for k, (_, _, v) in kept.items()}


def scalar_leaves(data: object, prefix: str = "", depth: int = 0, deepest: int = 4) -> Iterator[tuple[str, object]]:
    """Dotted paths of scalar members; lists and deeper objects are left out."""
    if isinstance(data, dict) and depth <= deepest:
        for k, v in data.items():
            path = f"{prefix}.{k}" if prefix else str(k)
            if isinstance(v, dict):
                yield from scalar_leaves(v, path, depth + 1, deepest)
            elif v is not None and not isinstance(v, list):
                yield path, v
