"""Session helpers: shared scratch space, reliable checkpoints, sizing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Sides up to this many estimated bytes may be broadcast; anything larger is left to the
# optimizer's shuffle joins.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "tallyfield", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; ``conf`` keys use ``__`` for dots.

    Call-site capture of every Column call is switched off: it is a static setting, and plans here
    are built from many expressions.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder the cluster shares between driver and executors (``spark.checkpoint.dir``).

    Only a local-mode session without the setting gets a folder of its own.
    """
    ctx = spark.sparkContext
    current = ctx._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not ctx.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tallyfield-")
    ctx.setCheckpointDir(configured)
    return ctx._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for tables written and read back."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage there.

    The files outlive executors, so a lost executor never forces the upstream plan to re-run
    with different task-local decisions.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` as a file below the shared folder, which cuts its lineage as ``checkpointed`` does, but is packed by column.

    Rows come back in no order, and on as many tasks as their bytes give.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession) -> int:
    """How many value ranges ranking is split into; follows the cluster's shuffle width."""
    return max(8, min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that has fewer splits than cores before heavy per-row work.

    A file of one row group is read by one task. Large inputs have many splits and pass unchanged, so
    no text is shuffled there. Only for plain scans: asking for the partition count plans, but
    does not run, them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only when ``rows * row_bytes`` stays under the size bound."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark context."""
    import os
    import zipfile

    ctx = spark.sparkContext
    if getattr(ctx, "_tallyfield_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tallyfield-pkg-"), "tallyfield.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("tallyfield", os.path.relpath(full, root)))
    ctx.addPyFile(archive)
    ctx._tallyfield_shipped = True
