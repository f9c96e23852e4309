"""Session defaults, the shared scratch folder and lineage cutting."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan relies on. They are only filled in where the
# cluster left them unset, so an operator's own values always win.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # vector aggregates keep one buffer per key; let the hash map grow past
    # the default of 128 keys before it falls back to sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # long sequences make heavy rows: bound Arrow batches by rows and by bytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}


def build_session(app: str = "geneloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **RUNTIME_DEFAULTS,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so tasks can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="geneloom-py-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def tune(spark: SparkSession) -> SparkSession:
    """Ship the package and fill in runtime SQL settings that were not set by whoever built the session."""
    ship(spark)
    explicit = dict(spark.sparkContext.getConf().getAll())
    for key, value in RUNTIME_DEFAULTS.items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark


SCRATCH = "_scratch_path"  # on a frame that ``materialize`` returned


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="geneloom-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    path = os.path.join(scratch_root(spark), f"geneloom-{label}-{uuid.uuid4().hex}")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def scratch_folder(spark: SparkSession, label: str) -> str | None:
    """A new scratch folder as a path of the operating system; None where the shared folder is not one that a process can open."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, label))
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file":
        return None
    path = jvm_path.toUri().getPath()
    os.makedirs(path, exist_ok=True)
    files.deleteOnExit(jvm_path)
    return path


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts the lineage (a lost executor re-reads files instead
    of recomputing an iterative plan) and gives the planner real sizes for the
    following joins.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, SCRATCH, path)
    return out


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the scratch tables behind ``frames``, which nothing reads any more, and let Spark drop the shuffle files of finished steps.

    Shuffle files go once the driver has collected the plans that made them.
    A long chain of large steps would otherwise keep all of them to its end.
    """
    for df in frames:
        path = getattr(df, SCRATCH, None)
        if path:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy plan one task per core when its input has fewer splits.

    A large input already has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
