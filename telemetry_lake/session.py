"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

# Sensor timestamps carry no zone once their "Z" is dropped, and hourly windows must not
# start at half past, so every plan assumes UTC.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A region can be all digits; never let the reader turn it into a number.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}

# A small object is opened in a fraction of the time that reading the default (4 MB) takes, which would put
# 32 objects into a task; and a batch of many files is looked up in so many tasks, not in 10,000.
SMALL_FILES = {
    "spark.sql.files.openCostInBytes": "64k",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
}


def for_small_files(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one that reads many small files in a task. Files are dealt by the settings
    of the session that named them, so the other tables keep theirs."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.get(key, None) != value:
            own.conf.set(key, value)
    for key, value in SMALL_FILES.items():
        own.conf.set(key, value)
    return own


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "telemetry-lake") -> SparkSession:
    """A session for tests and the bench; on a cluster use `configure` on the given session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="telemetry-lake-")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    The cluster names that folder in `spark.checkpoint.dir`. Where it is unset, a single-JVM
    session (tests, a laptop) gets a temporary folder; on a cluster that is an error, because the
    executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
