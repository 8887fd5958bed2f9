"""Sinks: appended labels and log rounds, saved state, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_labels(labels: DataFrame, path: str) -> None:
    """Add (doc_id, idx, label) rows; rows already there stay as they are."""
    labels.write.mode("append").parquet(path)


def new_labels(labels: DataFrame, written: DataFrame, keys: tuple[str, ...] = ("doc_id", "idx")) -> DataFrame:
    """Rows that are not yet written: makes a repeated append harmless."""
    return labels.join(written.select(*keys), list(keys), "left_anti")


def append_rounds(rounds: DataFrame, path: str) -> None:
    """One JSON object a line; letters of any script stay as they are, nulls are left out."""
    rounds.select(F.to_json(F.struct(*rounds.columns)).alias("value")).write.mode("append").text(path)


def save_state(vault: DataFrame, path: str, round_no: int | None = None) -> None:
    """Replace the saved state; with a round number, that round's snapshot only."""
    if round_no is None:
        vault.write.mode("overwrite").json(path)
    else:
        vault.withColumn("round", F.lit(round_no)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").json(path)


def statistics_csv(pivot: DataFrame, path: str) -> None:
    pivot.write.mode("overwrite").csv(path, header=True)


def reset(spark: SparkSession, *paths: str) -> None:
    """Delete saved state, logs and labels."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def back_up(spark: SparkSession, folder: str, into: str, keep: tuple[str, ...] = ()) -> list[str]:
    """Move everything in a folder but the files to keep; names of what was moved."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = hadoop.Path(folder), hadoop.Path(into)
    system = source.getFileSystem(conf)
    system.mkdirs(target)
    names = [s.getPath().getName() for s in system.listStatus(source)]
    moved = sorted(n for n in names if n not in keep)
    for name in moved:
        system.rename(hadoop.Path(source, name), hadoop.Path(target, name))
    return moved
