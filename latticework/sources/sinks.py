"""Sinks: snapshots, incremental progress, generations and metrics. Nothing is pickled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as ``folder/name``, replacing what was there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_snapshot(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def process_incrementally(todo: DataFrame, done_folder: str, key: str, work, out_folder: str) -> int:
    """Work on the rows of ``todo`` whose key is not recorded yet, append the results and record the keys.

    Returns how many keys were new. A run that fails before the keys are recorded repeats its rows.
    """
    spark = todo.sparkSession
    try:
        done = spark.read.parquet(done_folder).select(key).distinct()
        new = todo.join(done, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = todo
    keys = new.select(key).distinct()
    n = keys.count()
    if n:
        work(new).write.mode("append").parquet(out_folder)
        keys.write.mode("append").parquet(done_folder)
    return n


def write_generations(df: DataFrame, folder: str, step: str = "step") -> None:
    """JSON lines under ``step=N``, UTF-8 as it is."""
    df.write.mode("append").partitionBy(step).json(folder)


def write_lines(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_dataset(df: DataFrame, folder: str, example: bool = True) -> None:
    """Parquet, with one row as JSON beside it."""
    df.write.mode("overwrite").parquet(f"{folder}/data")
    if example:
        df.limit(1).write.mode("overwrite").json(f"{folder}/example")


def append_metrics(spark: SparkSession, metrics: dict[str, float], step: int, folder: str) -> None:
    """(step, metric, value) rows appended to the metrics table."""
    spark.createDataFrame([(step, k, float(v)) for k, v in metrics.items()], "step int, metric string, value double").write.mode("append").parquet(folder)


def add_columns(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """A column store's partial write: new columns for the keys that have them, null elsewhere."""
    return base.join(extra, key, "left")


def graph_frames(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables as a drawing tool wants them."""
    return nodes.select("id", F.col("name").alias("label"), F.col("level").alias("group")), edges.select(F.col("cur").alias("from"), F.col("next").alias("to"), F.col("move").alias("label"))


def append_batch(df: DataFrame, folder: str, batch: int) -> None:
    """What one training batch adds to a growing data set, under ``batch=N``; writing a batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def grown_dataset(spark: SparkSession, base: DataFrame, folder: str, before: int | None = None) -> DataFrame:
    """``base`` and the rows appended to it so far, or by batches below ``before``; columns that one side lacks are null."""
    try:
        more = spark.read.option("mergeSchema", "true").parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return base
    return base.unionByName((more if before is None else more.where(F.col("batch") < before)).drop("batch"), allowMissingColumns=True)
