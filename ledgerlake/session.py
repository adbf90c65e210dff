"""Session helpers: recommended settings and lineage cutting.

Nothing here changes a session that is already configured; the cluster's own
settings win. ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the
session and only falls back to a fresh local folder when the master is local
(tests, laptop runs).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings we rely on at scale: runtime re-planning, skew-join splitting and
# partition coalescing. Broadcasts stay behind AQE's measured-size threshold.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}


# For the per-account state of ``post_stream`` at scale, set
# spark.sql.streaming.stateStore.providerClass =
#   org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
# so the state lives off-heap and checkpoints incrementally.
STATEFUL_STREAMING = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlake") -> SparkSession:
    """A local session for tests and the benchmark (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for k, v in RECOMMENDED.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Uses ``spark.checkpoint.dir`` (or a directory already set on the context);
    only a local master may fall back to a new temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlake-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) before iterative operators run")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows up to which a side of a join may be broadcast: some 10 MB on the driver.
BROADCAST_ROWS = 100_000


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: it is joined by shuffle, however small its files are.

    Spark broadcasts a side whose estimated size is below its threshold, and estimates columns read from Parquet by the
    bytes of the files. Sorted numbers and flags take one byte a row there and some 80 in the driver's hash table.
    """
    return df.hint("merge")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``shuffled``, if ``df`` has many rows."""
    return df if rows <= BROADCAST_ROWS else shuffled(df)


def counted(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join with so many rows, counted before: broadcast if they are few, otherwise ``shuffled``."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else shuffled(df)


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_to_files``, and the number of rows."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    rows = back.count()
    return sized(back, rows), rows


def cut_to_files(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, by Parquet files in the shared checkpoint folder.

    A checkpoint keeps the size that its plan was estimated at. Estimates of joins multiply, so over many steps, each
    joined to the one before, they grow to numbers that take longer to multiply than the rows to join. Files have a
    size, but a compressed one: with many rows the frame, and what is filtered, selected or grouped from it, is ``shuffled``.
    """
    return cut_and_count(df)[0]


def cluster_settings(input_bytes: int, total_cores: int, target_partition_bytes: int = 192 << 20) -> dict[str, str]:
    """Shuffle and scan sizing for a run over ``input_bytes`` on ``total_cores`` cores.

    Aim for shuffle partitions of roughly ``target_partition_bytes`` (so a task's sort and window
    buffers fit in executor memory and spill rarely), never fewer than 2 per core, and let AQE
    coalesce the small ones. Scan splits follow the same target. At 100 TB over 8,000 cores this
    gives about 550,000 shuffle partitions before coalescing; the example in the README uses 8.
    """
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        **RECOMMENDED,
    }


# Bytes of a batch of rows on its way to a Python worker. Spark's own limit is 64 MB; a task holds a batch several times
# (JVM, pipe, Python), and rows may be whole documents.
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a limit of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ledgerlake`` importable on the Python workers (once per application).

    Operators that run Python on executors (``mapInPandas``, ``applyInPandasWithState``) refer to
    functions of this package; workers do not share the driver's ``sys.path``. On a cluster, install
    the package on the executors or pass it with ``--py-files``; this ships a zip of the package
    through ``SparkContext.addPyFile``, which distributes it to every executor.
    """
    import os
    import zipfile

    bound_batches(spark)
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="ledgerlake-pyfiles-"), "ledgerlake.zip")
    with zipfile.ZipFile(out, "w") as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
