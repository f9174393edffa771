"""Best representative of each duplicate group (problem 1).

Every group of rows that record the same occurrence becomes one row, built
field by field: for each attribute the maximum of the composite
(filled, source priority, time, value) wins, all in a single aggregation, so
that partial aggregation runs before the shuffle and a group with a third of
all rows arrives as one partial row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenlog.functions.text import same_fingerprint, same_key
from lumenlog.session import free


#: Trust in a format, more is better: records with named fields, lines of a fixed layout, free text; what was read off a picture has none.
TRUST = {
    3: ("opentelemetry", "json", "container", "browser", "serverless", "cloud_gateway"),
    2: ("syslog", "web_server", "database", "message_broker"),
    1: ("generic", "stack_trace", "ci_cd"),
}


def source_trust(source_format: Column) -> Column:
    """Trust in the source of a row; unknown, missing and pictured sources have 0."""
    c = F.lower(F.trim(F.coalesce(source_format, F.lit(""))))
    found = None
    for trust, formats in TRUST.items():
        found = F.when(c.isin(*formats), trust) if found is None else found.when(c.isin(*formats), trust)
    return found.otherwise(0)


def filled(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    kind = df.schema[name].dataType.simpleString()
    return c.isNotNull() & (c != "") if kind == "string" else c.isNotNull()


def completeness(df: DataFrame, columns: Sequence[str]) -> Column:
    """How many of the columns are neither null nor an empty string."""
    return sum((filled(df, c).cast("int") for c in columns), F.lit(0))


def survivors(
    df: DataFrame,
    keys: dict[str, Column],
    *,
    row_id: str,
    time: str,
    priority: Column | None = None,
    count: str | None = None,
    least: Sequence[str] = (),
    greatest: Sequence[str] = (),
) -> DataFrame:
    """One surviving record per key.

    keys: name -> expression; rows with a null key stay alone (they share
    nothing with another row). priority: larger is more trusted; by default
    the completeness of the row. count: column of occurrence counts; copies
    of one occurrence repeat the same count, hence the largest is kept rather
    than the sum. least/greatest: columns for which the extreme value is the
    right one. Result columns: the keys, ``best_id`` (id of the most complete
    row; ties: latest time, then smallest id), ``copies`` and every other
    column's surviving value under its own name. Repeated rows count as
    copies; an empty table gives an empty result. Input columns named like
    results get a trailing underscore.
    """
    df = free(df, "best_id", "copies", "_best", "_alone", "_filled", "_priority", *keys, *(f"_k_{k}" for k in keys))
    priority = completeness(df, df.columns) if priority is None else priority
    work = df.withColumns({"_filled": completeness(df, df.columns), "_priority": priority.cast("double")})
    work = work.withColumns({f"_k_{k}": e for k, e in keys.items()})
    alone = None
    for k in keys:
        missing = F.col(f"_k_{k}").isNull()
        alone = missing if alone is None else alone | missing
    work = work.withColumn("_alone", F.when(alone, F.col(f"`{row_id}`")))
    aggregates = [
        F.max(F.struct(F.col("_filled"), F.col(f"`{time}`"), (-F.col(f"`{row_id}`")).alias("i"))).alias("_best"),
        F.count(F.lit(1)).alias("copies"),
    ]
    special = {*least, *greatest, *([count] if count else []), row_id}
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name in least:
            aggregates.append(F.min(c).alias(name))
        elif name in greatest or name == count:
            aggregates.append(F.max(c).alias(name))
        elif name not in special:
            rank = F.struct(filled(df, name).alias("f"), F.col("_priority").alias("p"), F.col(f"`{time}`").alias("t"), c.alias("v"))
            aggregates.append(F.max(rank)["v"].alias(name))
    grouped = work.groupBy(*(F.col(f"_k_{k}") for k in keys), "_alone").agg(*aggregates)
    rest = [c for c in df.columns if c != row_id]
    return grouped.select(
        *(F.col(f"_k_{k}").alias(k) for k in keys), (-F.col("_best.i")).alias("best_id"), "copies", *(F.col(f"`{c}`") for c in rest)
    )


def evidence_survivors(evidence: DataFrame) -> DataFrame:
    """Survivors of ``evidence``: same analysis, same fingerprint, same identity.

    Adds same_fingerprint and same_key. A value is trusted by the format it
    came from, then by how complete its row is. first_seen is the earliest, last_seen the latest, occurrence_count the
    largest of the copies.
    """
    return survivors(
        evidence,
        {
            "same_analysis": F.col("analysis_id"),
            "same_fingerprint": same_fingerprint(F.col("fingerprint")),
            "same_key": same_key(*(F.col(c) for c in ("correlation_key", "trace_id", "request_id", "span_id"))),
        },
        row_id="id",
        time="last_seen",
        priority=source_trust(F.col("source_format")) * 1000 + completeness(evidence, evidence.columns),
        count="occurrence_count",
        least=("first_seen", "first_line_number"),
        greatest=("last_seen", "last_line_number"),
    )


def duplicate_representatives(evidence: DataFrame) -> DataFrame:
    """(evidence_id): the most complete row of each group of two or more."""
    return evidence_survivors(evidence).filter("copies > 1").select(F.col("best_id").cast("bigint").alias("evidence_id"))
