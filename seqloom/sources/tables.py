"""Parquet tables and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder; columns and filters are pushed into the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one is set only in local sessions that name none."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/seqloom-{uuid.uuid4().hex}"


def stage(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """`df` dealt over all shuffle partitions by its columns `by`. For rows that are few bytes but much work, which would else be put together in a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def discard(staged: DataFrame) -> None:
    """Remove the files of a staged table that no later step reads, to keep the shared folder small."""
    jvm = staged.sparkSession.sparkContext._jvm
    conf = staged.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        if "/seqloom-" in folder:  # only what stage() wrote
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
