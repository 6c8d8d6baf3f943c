"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_KEY = "spark.checkpoint.dir"
SHUFFLE_KEY = "spark.sql.shuffle.partitions"
# Input bytes per shuffle partition, and the most partitions one shuffle gets.
PARTITION_BYTES = 128 << 20
MAX_PARTITIONS = 100_000
# Bytes of sort keys that the sample of a range shuffle may bring to the driver.
SAMPLE_BYTES = 1 << 30
_SAMPLE_KEY = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
_SAMPLE_DEFAULT = 100
_sampling: dict[str, list[int]] = {}
_sampling_set: set[str] = set()
_sampling_lock = threading.Lock()


def build_session(app: str = "snapforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Nothing here is required for right results; a session built elsewhere works as well.
    Skewed join sides are split at run time by adaptive execution, and broadcasts are left to
    the size threshold instead of being forced.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # A map task that is run again and gives other rows (a random number over an unordered
        # input) makes its readers run again as well, so no row is lost or doubled.
        .config("spark.sql.shuffle.orderIndependentChecksum.enabled", "true")
        .config("spark.sql.shuffle.orderIndependentChecksum.enableFullRetryOnMismatch", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def partitions_for_bytes(size: int) -> int:
    """Shuffle partitions that keep each of them near ``PARTITION_BYTES``."""
    return max(1, min(MAX_PARTITIONS, -(-size // PARTITION_BYTES)))


def reads_files_only(df: DataFrame) -> bool:
    """Whether ``df`` is a projection or filter of one file table, a range or a local table.

    Only then is the planner's size estimate near the truth, and a second read cheap: the estimate of
    a join is the product of its sides, that of a database table or an RDD a default near 8 EB.
    """
    if not hasattr(df, "_jdf"):
        return False
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    if node.nodeName() == "LogicalRelation":
        return node.relation().getClass().getSimpleName() == "HadoopFsRelation"
    return node.nodeName() in ("LocalRelation", "Range")


def range_partitions(df: DataFrame) -> int | None:
    """Number of partitions for a full shuffle of ``df``, or None for the session's setting.

    The planner's size estimate of the input decides, see ``reads_files_only``. For inputs that the
    setting covers, None leaves it to adaptive execution to merge small partitions.
    """
    if not hasattr(df, "_jdf"):  # a remote session shows no estimates
        return None
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = partitions_for_bytes(estimate)
    return wanted if wanted > int(df.sparkSession.conf.get(SHUFFLE_KEY)) else None


@contextmanager
def range_samples(spark: SparkSession, rows: int) -> Iterator[None]:
    """Range shuffles run inside sample at most ``rows`` rows per partition (1 to the usual 100).

    The setting belongs to the session; of several threads at a time the smallest number holds.
    """
    session = str(spark._jsparkSession.hashCode()) if hasattr(spark, "_jsparkSession") else ""
    rows = max(1, min(_SAMPLE_DEFAULT, rows))

    def apply(active: list[int]) -> None:
        if active and min(active) < _SAMPLE_DEFAULT:
            spark.conf.set(_SAMPLE_KEY, str(min(active)))
            _sampling_set.add(session)
        elif session in _sampling_set:
            spark.conf.unset(_SAMPLE_KEY)
            _sampling_set.remove(session)

    with _sampling_lock:
        active = _sampling.setdefault(session, [])
        active.append(rows)
        apply(active)
    try:
        yield
    finally:
        with _sampling_lock:
            active.remove(rows)
            apply(active)


def _scratch_base(spark: SparkSession) -> str:
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    # Local mode: driver and executors are one machine, so a temporary folder is shared.
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="snapforge-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str:
    return f"{_scratch_base(spark)}/snapforge-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path for one intermediate table."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The result no longer depends on the plan that made it, so a lost executor costs a re-read
    and not a recomputation. It is also a file relation of known size, from which the planner
    decides by itself whether a later join may broadcast it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_frame(spark: SparkSession, rows: Iterable[Sequence], ddl: str) -> DataFrame:
    """A small frame from Python rows, such as catalog entries.

    Goes through Arrow, so it is a local relation of the plan: no job is needed to read it, and
    joins with an empty one are removed by the planner.
    """
    schema = T.StructType.fromDDL(ddl)
    names = schema.fieldNames()
    data = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow_schema(schema, timestamp_utc=True))
    return spark.createDataFrame(data, schema=schema)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop API for ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_path(spark, path)
    return fs.exists(target)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Recursive delete; a missing path is fine and returns False."""
    fs, target = hadoop_path(spark, path)
    return fs.delete(target, True) if fs.exists(target) else False


def create_exclusive(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file that must not exist yet; False if it does. Of several callers at a time one gets True.

    Local files are created by the operating system's exclusive open, others by the file system's create without
    overwriting, which HDFS and stores with conditional puts do as one step.
    """
    fs, target = hadoop_path(spark, path)
    if fs.getScheme() == "file":
        local = target.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(target, False)
    except Py4JJavaError as e:
        if fs.exists(target):
            return False
        raise OSError(f"cannot create {path}: {e.java_exception.getMessage()}") from e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def release_scratch(spark: SparkSession) -> bool:
    """Delete the intermediate tables of this application, once their readers are done."""
    return delete_path(spark, scratch_root(spark))
