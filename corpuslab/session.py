"""Session settings shared by the library, its bench and its tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpuslab")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local run may make its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="corpuslab-checkpoint-")
    context.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy.

    The written rows survive the loss of executors, and everything derived from
    them sees the same rows however often it is recomputed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_laid_out(df: DataFrame, *keys: str) -> DataFrame:
    """Write a table that has been written already once more, shuffled and sorted by ``keys``.

    Joins on just these keys then leave it where it is and move only the other side. A written copy
    keeps its layout only if the plan that wrote it was not adaptive, so that is off for this one
    plan, which has no more than the shuffle and the sort.
    """
    conf = df.sparkSession.conf
    parts, adaptive = int(conf.get("spark.sql.shuffle.partitions")), conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df.repartition(parts, *keys).sortWithinPartitions(*keys))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)
