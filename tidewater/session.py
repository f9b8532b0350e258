"""Session construction and cluster-safe defaults.

On a cluster the session is built by the platform; ``configure`` only fills
settings that are unset.  ``get_or_create`` is for tests and ``bench.py``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC session time (storage is UTC, local time is
# derived per feature), AQE for runtime coalescing and skew-join splitting.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


JIT_FLAGS = "-XX:-DontCompileHugeMethods"


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers do not see the driver's ``sys.path``; Spark's own file distribution
    (``addPyFile``) makes the package importable wherever a task runs.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    target = os.path.join(tempfile.mkdtemp(prefix=f"{name}-ship-"), f"{name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    out.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def get_or_create(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "tidewater") -> SparkSession:
    master = master or os.environ.get("TIDEWATER_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TIDEWATER_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        # Wide projections (33-column voyage cleaning) generate methods above the
        # JVM's 8 KB JIT limit; without this flag they run interpreted (~3x slower).
        .config("spark.driver.extraJavaOptions", JIT_FLAGS)
        .config("spark.executor.extraJavaOptions", JIT_FLAGS)
    )
    for key, value in _REQUIRED.items():
        builder = builder.config(key, value)
    if not os.environ.get("TIDEWATER_CHECKPOINT_DIR") is None:
        builder = builder.config("spark.checkpoint.dir", os.environ["TIDEWATER_CHECKPOINT_DIR"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; we never replace it.  Only when it is
    unset and the master is local (driver and tasks share one machine) do we
    create a scratch folder for this session; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tidewater-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a materialised stage."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


# Spark's setting by which a query's exchange files go when it ends, not when its plan is collected as garbage.
FREE_EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is neither run nor planned again by later jobs.

    ``free`` removes the exchange files of the write as soon as it ends.
    """
    spark = df.sparkSession
    path = scratch_table_path(spark, f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(FREE_EXCHANGES, None)
    if free:
        spark.conf.set(FREE_EXCHANGES, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(FREE_EXCHANGES) if before is None else spark.conf.set(FREE_EXCHANGES, before)
    return spark.read.schema(df.schema).parquet(path)
