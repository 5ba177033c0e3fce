"""Tables written once to the folder that all executors share, to cut lineage.

They belong to the session that wrote them: results read them lazily, so they stay until its owner, who knows
when the results are done with, calls :func:`forget_stored` (as the benchmark does) or clears the folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, as the session names it; one of our own only on
    a single machine that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="memspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, with its schema."""
    spark = df.sparkSession
    path = own_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which :func:`forget_stored` deletes."""
    path = f"{shared_folder(spark)}/memspan-{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def forget_stored(spark: SparkSession) -> int:
    """Deletes all that this process has stored for the session so far; returns how many folders."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
    return len(paths)
