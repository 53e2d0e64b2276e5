"""Folders and tables for partial states."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset and everything runs in this process, a folder of our own;
    on a cluster that would scatter a table over the machines, so it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder where the master is {master}")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="foldspark-"))
    return _own[0]


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the cluster has cores, dealt out to all of them; any other DataFrame as it is.

    One file with one row group is one task, however much work follows.  A
    large table has partitions enough and is never shuffled here.  A plan with
    exchanges has its own partitioning and is left alone.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan" or "Exchange" in plan.toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


def decode_batch(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of a batch of JSON lines in column ``value``; a bad record never loses its batch."""
    from pyspark.sql import functions as F

    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", options).alias("r"))
    good = parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")
    return good, parsed.where("r is null or r._bad is not null").select("value")
