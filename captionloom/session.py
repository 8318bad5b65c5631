"""Session helpers: a tuned session for scripts and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL_SCRATCH: dict[str, str] = {}
_WRITTEN: list[str] = []


def build_session(app: str = "captionloom", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench, with a scratch folder of its own; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix=f"{app}-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process, as in tests, a temporary folder is chosen; on a
    cluster each executor would write to its own disk, so there the folder must be named.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not conf:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = _LOCAL_SCRATCH.setdefault("dir", "") or tempfile.mkdtemp(prefix="captionloom-")
        _LOCAL_SCRATCH["dir"] = conf
    return conf.rstrip("/")


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten there."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later steps
    neither recompute it nor depend on executors that may be lost."""
    path = new_shared_path(df.sparkSession, label)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whichever store the path names."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def file_stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files below a folder, in whichever store it is; empty if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return ()
    files, out = store.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def drop_intermediates(spark: SparkSession) -> None:
    """Removes what ``materialize`` has written in this process; frames read from it must no longer be in use."""
    while _WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few partitions (a single small file); larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: What opening a file counts in bytes, and the tasks that list folders, where files are many and small.
SMALL_OPEN, LISTERS = 64 << 10, 200


def small_files_session(spark: SparkSession) -> SparkSession:
    """A session of the same application, with the caller's settings, for reading very many small files; the caller's session
    stays as it is. Spark counts a file as 4 MB at least, so that 32 files are a task, and lists up to 10,000 folders in
    a task each; here a task takes files until their bytes and ``SMALL_OPEN`` each fill it."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.files.openCostInBytes", str(SMALL_OPEN))
    session.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(LISTERS))
    return session


def is_small(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows and ``max_bytes`` of text; stops reading after that many rows."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = F.sum(sum(text, F.lit(16).cast("bigint")))
    n, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return n <= max_rows and (total or 0) <= max_bytes
