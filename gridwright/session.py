"""Session helpers: a tuned local session for tests and benches, table loading,
and the shared checkpoint folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "gridwright", event_log_dir: str | None = None) -> SparkSession:
    """Local session with the settings the library is tested under.

    On a cluster the session is created by the platform; only
    ``configure(spark)`` is meant to be applied there.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    if event_log_dir:  # stage and task times without the web UI
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every job of the library relies on.

    * AQE re-plans joins, coalesces small partitions and splits skewed ones.
    * Duplicate map keys keep the last value (header binding, map merge),
      matching Python ``dict`` assignment.
    * Arrow batches of at most 1000 rows (the HTML scan's pages can be large).
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    # Arrow batches for the HTML scan: pages can be large, keep a batch small.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def size_for(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 << 20,
             min_partitions: int = 200) -> int:
    """Shuffle sizing from the input volume: about ``input / 256 MB`` initial
    shuffle partitions, which AQE then coalesces toward the same advisory size,
    and file splits of 256 MB. Returns the partition count (about 400,000 for
    100 TB; raise the target for fewer, larger partitions)."""
    n = max(min_partitions, -(-input_bytes // target_partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_partition_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_partition_bytes))
    return n


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only when it is unset
    (tests, local runs) a scratch folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="gridwright-ckpt-")  # local runs and tests only
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for written intermediates."""
    base = checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (one parquet file or folder per table)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
