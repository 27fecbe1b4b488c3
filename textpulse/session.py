"""Session helpers: building a local session for tests/bench, and locating shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "textpulse") -> SparkSession:
    """A local session configured the way tests and the bench expect (UTC, AQE, Arrow, no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TEXTPULSE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is always used as is. Only when it is
    unset a fresh scratch folder is created and registered in the session, in local mode only; on
    a cluster an unset folder is an error.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()  # set directly on the context
        if current:
            return current
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster ({master})")
        root = tempfile.mkdtemp(prefix="textpulse-ckpt-")  # tests / local runs only
        try:
            spark.conf.set(CHECKPOINT_CONF, root)
        except Exception:  # a session that rejects core settings still gets the context dir
            pass
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint root for a written intermediate."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that nothing will read again."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df):
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    Used where a plan reads one nondeterministic shuffle (range partitioning samples its
    bounds anew on every execution) through two consumers: after the checkpoint both see the
    same rows in the same partitions, and a lost executor re-reads the files instead of
    recomputing a different partitioning.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20, cores: int = 8000) -> dict[str, str]:
    """Session settings sized for an input of ``input_bytes`` on a cluster with ``cores`` cores.

    Initial shuffle partitions are set so a partition of the input's size stays near
    ``target_partition_bytes`` (and at least 2 waves of the cluster's cores); AQE then
    coalesces small partitions toward the same advisory size and splits skewed ones in joins.
    Scan splits use the same target so a task's input fits comfortably in executor memory.
    """
    partitions = max(2 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
