"""Session helpers shared by every operator: table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder named in spark.checkpoint.dir.

    Only where neither the setting nor a directory exists and the session
    runs on one machine (tests) a temporary folder is set; on a cluster, where
    no executor could read it, that is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not shared:
        shared = os.path.join(tempfile.gettempdir(), "lumenlog-checkpoints")
    spark.sparkContext.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in reliable shared storage and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free(df: DataFrame, *names: str) -> DataFrame:
    """Make room for result columns: input columns of these names get a trailing underscore."""
    have = {c.lower() for c in df.columns}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = c
            while new.lower() in have:
                new += "_"
            have.add(new.lower())
            df = df.withColumnRenamed(c, new)
    return df
