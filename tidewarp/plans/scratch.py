"""Tables that cut lineage."""
import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master without
    that setting a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(at := tempfile.mkdtemp(prefix="tidewarp-"))
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before the interpreter; the folder is the cluster's scratch space
        pass


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables that are written inside are removed at its end, so a session of many queries does not fill the
    shared folder. What is read from them must be written or collected inside. Scopes nest."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _remove(spark, path)


def removed_later(spark: SparkSession, path: str) -> str:
    """path, which is removed at the end of the scope around the call, or without one when the interpreter ends."""
    if _scopes:
        _scopes[-1].append((spark, path))
    else:
        atexit.register(_remove, spark, path)
    return path


def materialized(df: DataFrame, label: str, **options) -> DataFrame:
    """df written once to the shared folder and read again. This cuts the lineage, survives lost
    executors, and unlike checkpoint() computes df only once. Removed as removed_later says. options are the
    writer's."""
    spark = df.sparkSession
    path = removed_later(spark, f"{shared_dir(spark)}/tidewarp-{label}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
