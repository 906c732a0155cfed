"""Session settings and the few helpers that touch the cluster: reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What every session of this library runs with; all may be overridden by the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; `conf` keys may use underscores for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per context; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._millrace_shipped = True


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only on one machine does a temporary folder serve instead.

    On a cluster each executor would write to its own disk and a later read would find a part of the rows, so a
    missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is not set, and the executors of {master} share no other folder")
        named = os.path.join(tempfile.gettempdir(), "millrace-checkpoints")
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder, with no lineage behind them."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, least: int = 2) -> DataFrame:
    """Rows dealt over the cores when the source has fewer partitions than that (one small file, say)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * least < cores else df


#: Folders written by this driver that are still there, with the session to delete them by.
_WRITTEN: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def kept_until_release(spark: SparkSession, kind: str) -> str:
    """The path of a new folder in the shared one, which `release` deletes."""
    if not _WRITTEN:
        atexit.unregister(_release_at_exit)
        atexit.register(_release_at_exit)  # the last one registered runs first, while the JVM is still there
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def stored(df: DataFrame) -> DataFrame:
    """As `cut`, through a compressed table in the shared folder: smaller than a checkpoint where rows are wide."""
    path = kept_until_release(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of `stored` that nothing will read any more."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path and (spark := _WRITTEN.pop(path, None)):
            _delete(spark, path)


def release() -> None:
    """Deletes all that `stored` and the sources' scratch folders hold. For when no result built on them is needed any more."""
    for path, spark in list(_WRITTEN.items()):
        del _WRITTEN[path]
        if spark._jsc is not None and not spark._jsc.sc().isStopped():
            _delete(spark, path)


def _release_at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM may have ended before
        _WRITTEN.clear()


#: Bytes up to which a table is sent to every executor.
FEW = 16_000_000


def _width(c: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 24
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 8 + 24
    if isinstance(kind, T.StructType):
        return sum((_width(c.getField(f.name), f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def few_or_not(df: DataFrame, most: int = FEW) -> DataFrame:
    """The table marked for broadcast if its rows take at most `most` bytes, else as it is; meant for stored tables, which are cheap to measure."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16)).cast("long")
    size = df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row, however often later steps use it.

    A projection would be merged into every filter and expression that names the column; a generator of one
    element is not, and stays in the JVM.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
