"""Filling fixed-capacity windows with texts (problem 8).

Bounded-space online packing: every partition keeps a fixed number of open
windows; an item goes to the window it fills best, and when it fits none the
fullest window is closed and a fresh one opened. What is still open at the end
of the partitions is merged: its items are packed again, level by level with 32
partitions to one, until one partition is left, whose last open items are
packed by falling size. Only items larger than the capacity are split.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumenlog.session import cut

# Fixed value: the published GPT-2 splitting pattern.
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN_WINDOWS = 64
FAN_IN = 32
#: Open windows of the last pass, over the items of OPEN_WINDOWS windows.
FINAL_WINDOWS = 1_000_000


def token_count(text: Column) -> Column:
    """Pieces of the splitting pattern (white space and letters as in Unicode)."""
    return F.regexp_count(text, F.lit(f"(?U){GPT2_PATTERN}"))


class Packer:
    """Open windows of one capacity, best fit, fullest out."""

    def __init__(self, capacity: int, limit: int, name: str) -> None:
        self.capacity, self.limit, self.name = capacity, limit, name
        self.room: list[tuple[int, int]] = []
        self.held: dict[int, list[tuple]] = {}
        self.opened = 0

    def add(self, size: int, item: tuple) -> list[tuple[str, int, list[tuple]]]:
        """Place one item; gives the windows that closed: (id, tokens, items)."""
        closed = []
        k = bisect_left(self.room, (size, -1))
        if k < len(self.room):
            room, w = self.room.pop(k)
        else:
            if len(self.room) >= self.limit:
                closed.append(self._close(0))
            room, w = self.capacity, self.opened
            self.opened += 1
            self.held[w] = []
        self.held[w].append(item)
        room -= size
        insort(self.room, (room, w))
        if room == 0:
            closed.append(self._close(bisect_left(self.room, (0, w))))
        return closed

    def _close(self, k: int) -> tuple[str, int, list[tuple]]:
        room, w = self.room.pop(k)
        return f"{self.name}-{w}", self.capacity - room, self.held.pop(w)

    def rest(self) -> list[tuple[str, int, list[tuple]]]:
        return [self._close(0) for _ in range(len(self.room))]


def _pack(df: DataFrame, level: int, parts: int, open_windows: int, decreasing: bool = False) -> DataFrame:
    """Rows (window_name, capacity, item, size) to rows with window, window_tokens, closed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packers: dict[str, Packer] = {}
        out: list[tuple] = []
        columns = ["window_name", "capacity", "item", "size", "window", "window_tokens", "closed"]

        def emit(name: str, capacity: int, windows: list, closed: bool) -> None:
            for w, tokens, items in windows:
                out.extend((name, capacity, item, size, w, tokens, closed) for item, size in items)

        for pdf in batches:
            for name, capacity, item, size, part in zip(pdf["window_name"], pdf["capacity"], pdf["item"], pdf["size"], pdf["part"], strict=True):
                p = packers.get((name, part))
                if p is None:
                    p = packers[name, part] = Packer(int(capacity), open_windows, f"{name}-{level}-{part}")
                emit(name, capacity, p.add(int(size), (item, size)), True)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        for (name, _), p in packers.items():
            emit(name, p.capacity, p.rest(), False)
        yield pd.DataFrame(out, columns=columns)

    spread = df.withColumn("part", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(parts)).cast("int"))
    spread = spread.repartition(parts, "part").sortWithinPartitions("part", *([F.col("size").desc()] if decreasing else []), F.xxhash64("item"), "item", "window_name")
    return spread.mapInPandas(run, "window_name string, capacity int, item string, size int, window string, window_tokens int, closed boolean")


def pack(items: DataFrame, windows: DataFrame, *, per_part: int = 50_000, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(window_name, capacity, id, piece, tokens, window, window_tokens, fill).

    items: (id, size); rows without size or with size 0 take no room and are
    left out. windows: (window_name, capacity); capacities below 1 are left
    out. An item larger than the capacity is cut to pieces of the capacity,
    its last piece is packed like an item. Repeated rows are packed as often
    as they come; their pieces are numbered on. The number of partitions
    follows from the number of items, so that a partition holds about
    ``per_part``.
    """
    ws = windows.select("window_name", F.col("capacity_tokens").cast("int").alias("capacity")).filter("capacity > 0").distinct()
    rows = items.select("id", "size").filter(F.col("size") > 0)
    # the few named windows are the stated set; every item is packed once for each
    every = rows.join(F.broadcast(ws), F.lit(True))
    pieces = every.select(
        "window_name", "capacity", "id", F.posexplode(F.transform(F.sequence(F.lit(0), ((F.col("size") - 1) / F.col("capacity")).cast("int")), lambda k: F.least(F.col("capacity"), F.col("size") - k * F.col("capacity")).cast("int"))).alias("piece", "size"),
    )
    keyed = pieces.withColumn("item", F.concat_ws(":", F.col("id").cast("string"), F.col("piece").cast("string")))
    parts = max(1, -(-rows.count() // per_part))
    left = keyed.select("window_name", "capacity", "item", "size")
    settled: list[DataFrame] = []
    level, last = 0, False
    while True:
        packed = cut(_pack(left, level, parts, FINAL_WINDOWS if last else open_windows, decreasing=last))
        settled.append(packed if last else packed.filter("closed"))
        if last:
            break
        left = packed.filter("not closed").select("window_name", "capacity", "item", "size")
        last = parts == 1
        level, parts = level + 1, -(-parts // FAN_IN)
    whole = reduce(DataFrame.unionByName, settled)
    return whole.select(
        "window_name", "capacity", F.substring_index("item", ":", 1).cast(items.schema["id"].dataType).alias("id"), F.substring_index("item", ":", -1).cast("int").alias("piece"),
        F.col("size").alias("tokens"), "window", "window_tokens", (F.col("window_tokens") / F.col("capacity")).alias("fill"),
    )


def document_sizes(documents: DataFrame) -> DataFrame:
    """(id, size): n_tokens, counted where it is null; a null text has no size."""
    return documents.filter("text is not null").select(F.col("doc_id").alias("id"), F.coalesce(F.col("n_tokens"), token_count(F.col("text"))).cast("int").alias("size"))
