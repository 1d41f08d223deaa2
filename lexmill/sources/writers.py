"""Writers whose output is complete or absent, and the same for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_atomic(df: DataFrame, path: str, format: str = "parquet", **options: str) -> None:
    """Written beside `path` and renamed once complete: readers see the old table or the new one. An existing table is replaced."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.write.format(format).options(**options).save(staging)
    target, fs = _fs(spark, path)
    if fs.exists(target):
        fs.delete(target, True)
    source, _ = _fs(spark, staging)
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {staging} to {path}")


def write_jsonl_split(df: DataFrame, path: str, split: str, order: list[str]) -> None:
    """JSON lines in one folder per split, each file sorted by `order`."""
    df.repartition(F.col(split)).sortWithinPartitions(split, *order).write.partitionBy(split).mode("overwrite").json(path)


def write_jsonl_gzip(df: DataFrame, path: str, order: list[str], parts: int = 1) -> None:
    """Gzipped JSON lines whose rows lie in the same files in the same order for the same table: ranges of `order`, sorted."""
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "gzip").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled, nulls empty."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def import_parts(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """Several JSON-lines parts as one table with the `part` each row came from; a part without rows is an error of the manifest, not of the rows."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths).withColumn("part", F.input_file_name())


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """`(path, length, sha256)` of files, read by the executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest_violations(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """`(name, problem)` of files `(name, sha256)` that are missing, extra or differ from the manifest's."""
    a, b = found.select("name", F.col("sha256").alias("a")), wanted.select("name", F.col("sha256").alias("b"))
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").when(F.col("a") != F.col("b"), "differs")
    return a.join(b, "name", "full_outer").select("name", problem.alias("problem")).where("problem IS NOT NULL")
