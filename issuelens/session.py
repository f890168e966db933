"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COALESCE = "spark.sql.adaptive.coalescePartitions"
MOUNTED = "spark.issuelens.checkpointMounted"
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "issuelens", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and a UTC session time zone.

    Without ``shuffle_partitions`` exchanges start wide and adaptive execution
    merges small partitions towards 128 MB, so one setting serves both small
    and very large inputs. Streaming state lives in RocksDB, off the heap.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    else:
        builder = (builder.config(COALESCE + ".initialPartitionNum", "8192")
                   .config(COALESCE + ".parallelismFirst", "false"))
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Set some of the session's settings, and set them back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def path_exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The Parquet table at ``path``, or no rows when nothing was written yet."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one written table, under the cluster's shared folder.

    The folder is the one named in ``spark.checkpoint.dir``. A local folder is
    only made up when that is unset and the session runs on one machine; it
    goes with the process. All folders of an application have one parent,
    which ``clear_scratch`` removes.
    """
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/issuelens-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> bool:
    """Remove what this application has staged; frames read from it are lost with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For a narrow frame that several reports start from: the joins behind it
    run once, every report prunes columns, and no report depends on executor
    memory. The caller owns the folder.
    """
    return staged_at(df, scratch_path(df.sparkSession, name))


def staged_at(df: DataFrame, path: str) -> DataFrame:
    """``staged`` in a folder of the caller's, to be removed with ``discard``.

    What the write has shuffled goes once it has ended, not when the driver
    next collects its garbage.
    """
    spark = df.sparkSession
    with settings(spark, SHUFFLES_GO):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged folder that nothing reads any more."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def check_shared(root: str, one_machine: bool, mounted: bool = False) -> None:
    """Refuse a machine's own folder on a cluster, unless it is said to be mounted everywhere."""
    own = root.startswith("file:") or "://" not in root and root.startswith("/tmp")
    if own and not one_machine and not mounted:
        raise RuntimeError(f"{root} is a folder of one machine; set {MOUNTED}=true if all machines mount it")


def checkpoint_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    one_machine = context.master.startswith("local")
    if root is None:
        if not one_machine:
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="issuelens-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    check_shared(root, one_machine, spark.conf.get(MOUNTED, "false") == "true")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")
