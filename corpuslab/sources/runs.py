"""Results of runs: generated texts, training logs, metric histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators.evaluate import perplexity_of
from corpuslab.operators.ordinal import running_offsets
from corpuslab.sources.corpus import read_lines
from corpuslab.sources.tweets import CSV

# The lines of a training log.
START_LINE = (
    r"^Starting run (\S+) with model='([^']*)' tokenization='([^']*)' "
    r"epochs=(\d+) num_hiddens=(\d+) device=(\S+)"
)
NUMBER = r"([0-9.]+(?:e[+-]?[0-9]+)?|inf|nan)"
EPOCH_LINE = rf"^epoch (\d+) - val-ppl: {NUMBER}, train-ppl: {NUMBER}, elapsed_time={NUMBER}s$"


def read_generated(spark: SparkSession, folder: str) -> DataFrame:
    """Generated texts ``(run, prompt, output)``; a file's name is its run."""
    return (
        spark.read.schema("row int, prompt string, output string")
        .options(**CSV)
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
        .select(
            F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "").alias("run"),
            "prompt",
            "output",
        )
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Training logs as one row per epoch, with the settings of its run.

    A file may hold several runs of one name, some cut short; a run is known by
    its file and the line it starts on. Sample lines and result lists are skipped,
    so only start and epoch lines are ever moved.
    """
    def part(pattern: str, group: int):
        return F.regexp_extract("text", pattern, group)

    def number(group: int):
        return part(EPOCH_LINE, group).cast("double")  # reads inf and nan, too

    is_start = F.col("text").rlike(START_LINE)
    lines = read_lines(spark, path).filter(is_start | F.col("text").rlike(EPOCH_LINE))
    lines = lines.withColumn("starts", is_start.cast("long"))
    lines = running_offsets(lines, "line_no", "starts", ["file"], carry=["text"])
    lines = lines.withColumn("run_no", F.col("offset") + F.col("starts"))
    runs = lines.filter(is_start).select(
        "file",
        "run_no",
        F.col("line_no").alias("start_line"),
        part(START_LINE, 1).alias("run"),
        part(START_LINE, 2).alias("model"),
        part(START_LINE, 3).alias("tokenizer"),
        part(START_LINE, 4).cast("int").alias("planned_epochs"),
        part(START_LINE, 5).cast("int").alias("hidden_units"),
        part(START_LINE, 6).alias("device"),
    )
    epochs = lines.filter(~is_start).select(
        "file",
        "run_no",
        part(EPOCH_LINE, 1).cast("int").alias("epoch"),
        number(2).alias("val_ppl"),
        number(3).alias("train_ppl"),
        number(4).alias("seconds"),
    )
    return runs.join(epochs, ["file", "run_no"]).drop("run_no")


METRICS_SCHEMA = """
    epoch double, learning_rate double, loss double, step long, eval_loss double,
    eval_runtime double, eval_samples_per_second double, eval_steps_per_second double
"""


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric histories as one row per run and epoch, with the perplexity.

    Training and evaluation write separate objects for the same epoch; they are
    merged here. The folder a file is in is its run.
    """
    raw = (
        spark.read.schema(METRICS_SCHEMA)
        .option("multiLine", "true")
        .json(path)
        .withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    )
    values = [c for c in raw.columns if c not in ("run", "epoch")]
    merged = raw.groupBy("run", "epoch").agg(*[F.max(c).alias(c) for c in values])
    return merged.withColumn("perplexity", perplexity_of(F.col("eval_loss")))
