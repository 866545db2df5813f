"""Tables that the session writes, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset and all run on this machine, a temporary
    one; on a cluster that is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='mosaica-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/mosaica/{what}-{uuid.uuid4().hex}"
    _written.setdefault(spark, []).append(path)
    return path


def written(spark: SparkSession) -> list[str]:
    """Paths that this process has made in the shared folder and not released, in order."""
    return list(_written.get(spark, []))


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes what this process has written to the shared folder: these paths, or all."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mine = _written.get(spark, [])
    for path in paths or list(mine):
        if path in mine:
            mine.remove(path)
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


@atexit.register
def _release_all() -> None:
    for spark in list(_written):
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the JVM may have gone first
                release(spark)


#: Spark then deletes the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaning(spark: SparkSession):
    """Within, each statement's shuffle files go when it ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """df, written and read back: fixed from then on, with no lineage to recompute and no shuffle files."""
    path, schema, spark = new_path(df.sparkSession, what), df.schema, df.sparkSession
    with cleaning(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)
