"""Session defaults and table access shared by every query."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that results do not depend on; a cluster's own values win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(app: str = "loomline", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    settings = DEFAULTS | {
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(n),
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


def is_local(spark: SparkSession) -> bool:
    """One JVM and one machine. A "local-cluster" has executors of its own."""
    return re.match(r"local(\[.*\])?$", spark.sparkContext.master) is not None


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: from the driver's folder on one machine, else from an archive that every executor fetches."""
    env = spark.sparkContext.environment
    if "LOOMLINE_SHIPPED" in env:
        return spark
    root = Path(__file__).resolve().parent.parent
    if is_local(spark):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (str(root), env.get("PYTHONPATH", "")) if x)
    else:
        folder = tempfile.mkdtemp(prefix="loomline-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/loomline", "zip", root, "loomline"))
    env["LOOMLINE_SHIPPED"] = "1"
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one if there is one machine only, else an error, as executors would not see
    each other's files."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    held = spark.sparkContext.environment.get("LOOMLINE_SHARED")
    if not held:
        held = tempfile.mkdtemp(prefix="loomline-")
        atexit.register(shutil.rmtree, held, True)
        spark.sparkContext.environment["LOOMLINE_SHARED"] = held
    return f"file://{held}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Catalyst prunes columns and pushes filters down to it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
