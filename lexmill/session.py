"""Session factory and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lexmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `conf` keys use `_` for `.`.

    Anything that the cluster sets already (master, memory, shuffle partitions) is kept.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


_OWN: list[str] = []
_CUT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Where that is unset, a local master gets a folder of its own; on a cluster
    a folder of one machine would be lost to the others, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lexmill-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    spark.sparkContext.setCheckpointDir(_OWN[0])
    return _OWN[0]


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """`df` written to the shared folder and read again: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _CUT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_cuts(spark: SparkSession) -> int:
    """Deletes all that `cut` has written in this process and returns how many folders; call it once the results that read them are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_CUT)
    while _CUT:
        path = jvm.org.apache.hadoop.fs.Path(_CUT.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
