"""Spark session settings the library relies on.

Everything here is configuration, not execution: the library itself only builds
lazy DataFrames.  ``configure`` is idempotent and safe to call on a session that a
cluster launcher already created; it never overrides a value the cluster set
(``spark.checkpoint.dir`` in particular).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that change results, not just speed.  They are always applied.
SEMANTIC_CONF = {
    # Dates are civil dates; bookings carry no zone.  Pin UTC so casts of
    # timestamp columns to DATE do not move across midnight.
    "spark.sql.session.timeZone": "UTC",
    # A time-entry row may repeat a cell name; the reference keeps the last one.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Budget exports are often Windows-1252; Spark 4 needs this to accept it.
    "spark.sql.legacy.javaCharsets": "true",
}

# Performance defaults; applied only where the session has no value yet.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Folders are listed by so many tasks, each with many of them; as many tasks as
    # folders, up to 10,000, cost the driver more time and memory than the listing.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
    # Plan, budget and dictionary sides are bounded by the budget file (one row
    # per milestone), not by the bookings; 64 MB is well above that and far
    # below executor memory.
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    conf = spark.conf
    for key, value in SEMANTIC_CONF.items():
        if conf.get(key, None) != value:
            conf.set(key, value)
    for key, value in SCALE_CONF.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    On a cluster this comes from ``spark.checkpoint.dir``; there a missing setting
    is an error, since executors don't see each other's folders.  A session in one
    process (master ``local[..]``) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="bonusledger-ckpt-")
        sc.setCheckpointDir(current)
    return current


def run_folder(spark: SparkSession) -> str:
    """Where this application lands its intermediate tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/bonusledger-{spark.sparkContext.applicationId}"


def cleanup(spark: SparkSession) -> bool:
    """Removes what this application has landed, once no lazy result needs it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "bonusledger") -> SparkSession:
    """Session for tests and the benchmark (local mode, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("BONUSLEDGER_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**SEMANTIC_CONF, **SCALE_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def materialize(df, name: str):
    """Writes ``df`` as parquet under the shared checkpoint folder and reads it
    back: one computation, lineage cut, and the read side has exact sizes for
    AQE and broadcast decisions.  Used for intermediate results that several
    outputs read (the prepared budget lines)."""
    import uuid

    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def concurrently(*thunks):
    """Runs independent builders (each may land a table, i.e. run a Spark job)
    from a small thread pool and returns their results in order.  Spark
    schedules jobs submitted from several driver threads side by side, so
    independent inputs of one report are landed at the same time."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max(1, len(thunks))) as pool:
        futures = [pool.submit(t) for t in thunks]
    return [f.result() for f in futures]
