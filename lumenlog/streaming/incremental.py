"""Incremental ingestion: idempotent rollup batches, progress, pair windows and open entries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lumenlog.operators import rollup

EVENT_KEYS = ["analysis_id", "artifact_id", "fingerprint", "trace_id", "request_id", "span_id", "correlation_key"]


def write_batch(path: str):
    """A foreachBatch function that keeps the rollup of each micro-batch in its own folder.

    A batch that is run again replaces its folder, so counts never add twice;
    ``current`` merges the folders.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        part = rollup.rollup(rollup.retained(batch)).withColumn("batch", F.lit(batch_id).cast("bigint"))
        part.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def current(spark, path: str) -> DataFrame:
    """The evidence of all batches so far; equals one rollup over all their events."""
    return rollup.merge_rollups(spark.read.parquet(path))


def start_rollup(events: DataFrame, path: str, checkpoint: str):
    """Run the rollup of a stream of events as far as there is data."""
    return events.writeStream.foreachBatch(write_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monotone_progress(progress: DataFrame) -> DataFrame:
    """(analysis_id, seq, progress) without steps that fall behind an earlier one."""
    w = Window.partitionBy("analysis_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return progress.withColumn("top", F.max("progress").over(w)).filter(F.col("progress") == F.col("top")).drop("top")


def windowed_counts(events: DataFrame, *, time: str = "event_time", width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per service and tumbling window of a stream; rows later than ``late`` may be left out by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "service").agg(F.count(F.lit(1)).alias("n"))


def pair_window(left: DataFrame, right: DataFrame, *, seconds: int = 5, late: str = "1 minute") -> DataFrame:
    """Stream-stream join of rows of one analysis at most ``seconds`` apart."""
    l = left.withWatermark("event_time", late).alias("l")
    r = right.withWatermark("event_time", late).alias("r")
    near = F.col("r.event_time").between(F.col("l.event_time"), F.col("l.event_time") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return l.join(r, (F.col("l.analysis_id") == F.col("r.analysis_id")) & (F.col("l.event_id") != F.col("r.event_id")) & near)


def fold_lines(kept: tuple | None, lines: Iterable[tuple[int, str]], starts: Callable[[str], object]) -> tuple[tuple | None, list[tuple]]:
    """Add (number, line) pairs to the open entry (first, last, text); gives the open and the finished entries."""
    done: list[tuple] = []
    for n, line in lines:
        if kept is None or starts(line):
            if kept is not None:
                done.append(kept)
            kept = (int(n), int(n), line)
        else:
            kept = (kept[0], int(n), f"{kept[2]}\n{line}")
    return kept, done


ENTRY = "artifact_id bigint, first_line bigint, last_line bigint, text string"


def open_entries(lines: DataFrame, head: str, *, idle_ms: int = 60_000) -> DataFrame:
    """Entries of a stream of (artifact_id, line_number, raw_line).

    The open entry of a file is kept as state until the next head arrives, or
    until the file is idle. Lines must arrive in order within a file and batch.
    """
    import re

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    starts = re.compile(head)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        kept = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *kept)], columns=["artifact_id", "first_line", "last_line", "text"])
            return
        for pdf in batches:
            kept, done = fold_lines(kept, pdf.sort_values("line_number")[["line_number", "raw_line"]].itertuples(index=False), starts.match)
            out.extend((key[0], *e) for e in done)
        state.update(kept)
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["artifact_id", "first_line", "last_line", "text"])

    return lines.groupBy("artifact_id").applyInPandasWithState(run, ENTRY, "first_line bigint, last_line bigint, text string", "append", GroupStateTimeout.ProcessingTimeTimeout)
