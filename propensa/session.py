"""Session helpers: a local session for tests, shared scratch space, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
# By application: temporary folders of local masters, tables that are kept, results that are remembered.
_local_roots: dict[str, str] = {}
_held: dict[str, list[DataFrame]] = {}
_remembered: dict[str, dict] = {}


def local_session(app: str, cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor reaches: spark.checkpoint.dir of the session.

    Only a local master may go without the setting; it then gets one temporary
    folder per application.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="propensa-")
    return _local_roots[sc.applicationId]


def _scratch(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/propensa-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in this application's part of the shared folder that nothing has written to yet."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote below :func:`fresh_path`; call it when results are out.

    Results remembered by path are forgotten and tables that are kept are released with it.
    """
    release(spark)
    _remembered.pop(spark.sparkContext.applicationId, None)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table_state(spark: SparkSession, paths: Sequence[str]) -> str:
    """Size and time of change of every file below the paths, as one text."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(out))


def remembered(spark: SparkSession, name: str, paths: Sequence[str], make: Callable[[], T]) -> T:
    """What ``make`` returned for these tables before, or now.

    It is made anew when a file of the tables has changed or the application's scratch space is gone.
    """
    kept = _remembered.setdefault(spark.sparkContext.applicationId, {})
    key = (name, table_state(spark, paths))
    if key not in kept:
        kept[key] = make()
    return kept[key]


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the table to the shared folder and read it back.

    Later jobs start from the stored rows, so neither repeated use nor a lost executor runs the
    steps before it again; unlike an RDD checkpoint the rows are computed once.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(df: DataFrame) -> DataFrame:
    """Keep a table that several jobs read; a plan that is already kept is not kept twice.

    The application owns it until :func:`release`.
    """
    level = df.storageLevel
    if level.useMemory or level.useDisk:
        return df
    _held.setdefault(df.sparkSession.sparkContext.applicationId, []).append(df)
    return df.persist()


def release(spark: SparkSession) -> int:
    """Let go of every table kept by :func:`cached`; the number of those that were still kept."""
    frames = _held.pop(spark.sparkContext.applicationId, [])
    kept = [df for df in frames if df.storageLevel.useMemory or df.storageLevel.useDisk]
    for df in kept:
        df.unpersist()
    return len(kept)
