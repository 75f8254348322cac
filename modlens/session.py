"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", memory: str = "12g", app: str = "modlens") -> SparkSession:
    """A local session for tests and benchmarks."""
    parts = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.scheduler.mode", "FAIR")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the one the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing on a local master (one machine, as in tests), a temporary folder
    stands in for the life of the application; on a cluster the job stops with a message.
    """
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINT_DIR)
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    return _stand_in(sc.applicationId)


@functools.cache
def _stand_in(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"modlens-{application}-")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for this application below the shared folder, removed when the program ends."""
    sc = spark.sparkContext
    top = f"{shared_dir(spark).rstrip('/')}/modlens-{sc.applicationId}"
    if top not in _made:
        _made.add(top)
        atexit.register(_remove, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


_made: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    # Through Hadoop's file systems, as the shared folder may be in any store.
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder, its lineage cut."""
    spark = df.sparkSession
    path = run_dir(spark, "table")
    df.write.parquet(path)
    return spark.read.parquet(path)


def dealt(df: DataFrame, *keys: str, per_core: int = 4) -> DataFrame:
    """The frame's rows dealt over ``per_core`` tasks for each core by a hash of their keys.

    A file can be split at its row groups only, so a table of few large ones keeps few cores busy
    however many there are. For map work that costs much more than a shuffle of its rows.
    """
    spark = df.sparkSession
    # As many tasks as other shuffles have, if those are more: they grow with the table.
    n = max(per_core * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
