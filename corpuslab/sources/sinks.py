"""Sinks for prepared corpora, generated texts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, only_if_absent: bool = False) -> None:
    """A table as CSV files with a header and no index column."""
    mode = "ignore" if only_if_absent else "overwrite"
    df.write.mode(mode).options(header="true", quote='"', escape='"').csv(path)


def write_splits(df: DataFrame, folder: str) -> None:
    """Each split into a folder of its own, in one pass over the data."""
    df.write.mode("overwrite").options(header="true", quote='"', escape='"').partitionBy(
        "split"
    ).csv(folder)


def write_generated(df: DataFrame, folder: str) -> None:
    """Generated texts ``(run, prompt, sample_no, output)``, one folder per run.

    Only the runs that are written are replaced.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run"
    ).parquet(folder)


def append_metrics(df: DataFrame, folder: str) -> None:
    """Add metric rows to a history of JSON lines."""
    df.write.mode("append").json(folder)


def log_lines(epochs: DataFrame) -> DataFrame:
    """Epoch rows as the text lines of a training log."""
    return epochs.select(
        F.format_string(
            "epoch %d - val-ppl: %.1f, train-ppl: %.1f, elapsed_time=%.2fs",
            "epoch", "val_ppl", "train_ppl", "seconds",
        ).alias("value")
    )


def append_log(epochs: DataFrame, folder: str) -> None:
    """Add epoch rows to a training log."""
    log_lines(epochs).write.mode("append").text(folder)
