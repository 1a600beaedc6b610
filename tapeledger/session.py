"""Session for tests, bench and local runs; a cluster brings its own."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "tapeledger", memory: str = "16g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder all executors see: the cluster's checkpoint folder, else (tests) a fresh one on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tapeledger-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; never handed out twice."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df):
    """Cut lineage through a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def staged(df, path: str):
    """Write ``df`` to a path of the shared folder and read it back: computed once, and its readers take the columns they need."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder that nothing reads any more."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished stages, whose frames are out of scope."""
    for _ in range(2):  # the cleaner works on its own time
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def estimated_bytes(df) -> int | None:
    """Catalyst's size estimate of a plan; None where the session does not expose it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a Connect session has no plan object here
        return None


def spread_small_input(df, key: str, limit_bytes: int = 1 << 30):
    """Spread a small table that lies in fewer files than there are cores over all cores.

    A large table, or one in many files, is returned as it is: its scan is parallel already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    if size is None or size > limit_bytes or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, key)
