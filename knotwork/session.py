"""Session, shared folder and plan helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while its measured size stays under this bound.
BROADCAST_BYTES = 8 << 20
#: The bound where only Catalyst's estimate is at hand.
SOURCE_BYTES = 2 << 20


def local_session(cores: int | str = 8, shuffle: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("knotwork")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session may leave it unset; it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="knotwork_")
        spark.sparkContext.setCheckpointDir(f"file://{found}")
    return found.rstrip("/")


#: Folders made in this process and not yet deleted, with their file systems; results still read them, so they go when it ends.
_left: dict[str, tuple] = {}


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/knotwork_{name}_{uuid.uuid4().hex}"
    if not _left:
        atexit.unregister(_sweep)
        atexit.register(_sweep)
    _left[path] = _fs(spark, path)
    return path


def _sweep() -> None:
    """Delete what results still read when the process ended; a JVM that is gone already leaves it to :func:`clean`."""
    for p, fs in list(_left.values()):
        try:
            fs.delete(p, True)
        except Exception:  # noqa: BLE001
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which outlives executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._knotwork_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written`, once everything that reads them has been written itself."""
    for df in tables:
        path = getattr(df, "_knotwork_path", None)
        if path:
            remove(df.sparkSession, path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)
    _left.pop(path, None)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where it does not exist."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def clean(spark: SparkSession) -> None:
    """Delete all tables that this library left in the shared folder; results not yet read are lost."""
    root = shared_dir(spark)
    for name in listed(spark, root):
        if name.startswith("knotwork_"):
            remove(spark, f"{root}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy per row: one of fewer splits than cores is spread over all of them.

    Only a table of a few splits is moved; one with a split per core or more is scanned as it lies.
    """
    scan, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def col(name: str) -> Column:
    """A column by its dotted path; each step is quoted, so odd names do not parse as SQL."""
    return F.col(".".join(f"`{p}`" for p in name.split(".")))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, which starts from the source files; no job runs."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def small(df: DataFrame, bound: int = SOURCE_BYTES) -> DataFrame:
    """Hint a broadcast only if the estimate is small; else Catalyst and AQE decide.

    The estimate counts compressed files and no exploded rows, so the bound is far under what a
    broadcast may take: even tenfold it is 20 MB.
    """
    return F.broadcast(df) if estimated_bytes(df) <= bound else df


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df
