"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# One fallback folder per local application, see scratch_root().
_local_roots: dict[str, str] = {}


# Settings that can change while a session runs; the jobs rely on the first for their results.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # The JVM leaves methods over 8,000 bytes of code to its interpreter. A wide projection such as
    # the cleaning job exceeds that as one fused stage; with this limit Spark generates it as
    # several small methods instead, which more than halves its time.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Stream state on local disk instead of the executor heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A micro-batch stores its changes to the state, not the state as a whole.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that was built elsewhere."""
    for name, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def build_session(app_name: str = "staylens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs are planned for.

    AQE stays on: it coalesces small shuffle partitions, splits skewed join partitions and
    turns sort-merge joins into broadcast joins when the measured size allows it.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):  # one JVM does the work of all executors
            builder = builder.config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return configure(builder.getOrCreate())


def scratch_root(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder; on a cluster a machine-local folder would be lost with
    its executor, so the setting is required there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="staylens-")
    return _local_roots[context.applicationId]


def scratch_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables, under the scratch folder."""
    return f"{scratch_root(spark)}/staylens/{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path in the application's folder that nothing else uses."""
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete the application's intermediate tables; for the end of a job, when its results are stored elsewhere.

    Frames that the library has returned may still read them, so nothing is deleted before.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def use_checkpoints(spark: SparkSession) -> None:
    """Let checkpoints go to the shared folder, unless the context has one already."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def stored(df, label: str):
    """Write to the shared folder as Parquet and read back: later jobs neither recompute it nor depend on an executor."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
