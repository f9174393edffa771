"""Positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenlog.session import cut

#: Rows of one group that a single task sorts; larger groups are ranked by range partitions.
ONE_TASK = 2_000_000


def position(df: DataFrame, keys: list[str], order: list[Column], *, name: str = "pos", size: str | None = None, limit: int = ONE_TASK) -> DataFrame:
    """Add the position (from 1) of each row in its group, and the group's size if asked.

    The order must be total within a group. While no group exceeds ``limit``
    rows a window does it. Otherwise the rows are range-partitioned by keys
    and order, each piece is numbered on its own, and the sizes of the pieces
    before it, one row per group and piece, are added: no task then holds
    more than a piece of a group.
    """
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = groups.agg(F.max("_n")).first()[0] or 0
    w = Window.partitionBy(*keys)
    if largest <= limit:
        out = df.withColumn(name, F.row_number().over(w.orderBy(*order)).cast("bigint"))
        return out.withColumn(size, F.count(F.lit(1)).over(w)) if size else out
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = cut(df.repartitionByRange(parts, *(F.col(k) for k in keys), *order).withColumn("_piece", F.spark_partition_id()))
    numbered = pieces.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order)))
    sizes = pieces.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_piece", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(w).alias("_t"))
    same = [numbered[k].eqNullSafe(offsets[k]) for k in keys] + [numbered["_piece"] == offsets["_piece"]]
    joined = numbered.join(offsets, same).select(*(numbered[c] for c in df.columns), (F.col("_at") + F.col("_o")).cast("bigint").alias(name), *([F.col("_t").alias(size)] if size else []))
    return joined
