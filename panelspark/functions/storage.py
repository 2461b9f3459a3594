"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set a local run gets a new folder, and a cluster is refused."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/panelspark/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written as Parquet and read back."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, key: str, files: int, order: str | None = None) -> DataFrame:
    """df in so many files bucketed by the key, read back: two of them with as many files join by the key, alone or with other
    columns, and windows and groups by it follow without a shuffle. A df that is so dealt already isn't shuffled here either.
    A bucket is one file, in the order of the key and then of order, if given."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = f"panelspark_{name}_{uuid.uuid4().hex[:12]}"
    df.repartition(files, key).write.bucketBy(files, key).sortBy(key, *([order] if order else [])).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that stored wrote and no later plan reads."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
