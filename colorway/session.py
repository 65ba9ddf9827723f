"""Session helpers: settings for local runs, and lineage cuts that survive
executor loss (reliable checkpoints in the cluster's shared folder)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    # Checkpoint files of RDDs that are gone are removed with them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = "*", app: str = "colorway", **conf: str) -> SparkSession:
    """Session for tests and the local benchmark. On a cluster, use the
    session the platform gives; nothing here is required by the jobs."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**LOCAL_CONF, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder: the session's ``spark.checkpoint.dir``; a scratch
    folder is set only where the session names none (tests, local runs)."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's setting applies
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        import tempfile  # local runs only: one machine, so a local folder is shared
        configured = tempfile.mkdtemp(prefix="colorway-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def lineage_cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder (never a
    local checkpoint: a lost executor must not lose the data)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder under the checkpoint directory for job outputs that must be
    shared by all executors."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


# Target bytes per range partition (sorts of one task stay in memory).
RANGE_PARTITION_BYTES = 256 * 1024 * 1024
# Spark's size of a source that has no statistics (rows made in memory).
UNKNOWN_SIZE = 1 << 62


def range_partitions(df: DataFrame, minimum: int | None = None, bytes_each: int = RANGE_PARTITION_BYTES) -> int:
    """Partition count for a range sort of ``df``: the size of the tables it
    reads (a metadata read on the driver) over ``bytes_each``, and at least
    ``spark.sql.shuffle.partitions``. The sizes of the scans are added up;
    Catalyst's own estimate above a join is the product of its inputs. AQE can
    merge range partitions but not split them, so the count must be large
    enough up front."""
    base = minimum or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(base, source_bytes(df) // bytes_each + 1)


def source_bytes(df: DataFrame) -> int:
    """The size of the tables that ``df`` reads, as often as it reads them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN_SIZE)
