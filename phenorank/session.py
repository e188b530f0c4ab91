"""Session settings, table access, and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes (uncompressed, as Spark estimates them) up to which a side may be broadcast on purpose.
BROADCAST_BYTES = 8 * 1024 * 1024


def build_session(app: str = "phenorank", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("PHENORANK_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder that is removed at exit;
    any other session must name one, since a machine-local folder would be lost with its machine.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="phenorank-")
        atexit.register(shutil.rmtree, own, True)
        shared_dir.own = own
    return f"file://{own}"


_live: set[str] = set()


@atexit.register
def _clean_up() -> None:
    """Remove what is still there of this process's tables, as far as the session is still up."""
    spark = SparkSession.getActiveSession()
    if spark is not None and _live:
        try:
            discard(spark, *_live)
        except Exception:  # noqa: BLE001, S110
            pass


def written(df: DataFrame, label: str = "step", partitions: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: a lineage cut that no lost executor can undo.

    Returns the table and its path; hand the path to :func:`discard` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    out = df.coalesce(partitions) if partitions else df
    out.write.mode("overwrite").parquet(path)
    _live.add(path)
    return spark.read.schema(df.schema).parquet(path), path


def written_counting(df: DataFrame, label: str = "step", **counts: Column) -> tuple[DataFrame, str, dict[str, int]]:
    """:func:`written`, with aggregates of the rows that the write itself works out, so that they need no job of their own."""
    seen = Observation()
    out, path = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()]), label)
    return out, path, {k: v or 0 for k, v in seen.get.items()}


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by :func:`written`."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    _live.difference_update(paths)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint where its estimated size is within ``limit``; else unhinted, to be shuffled."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df
