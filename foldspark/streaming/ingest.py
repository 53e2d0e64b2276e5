"""Continuous ingest: a running total, or partial states staged a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import finish, merge_partials, partial
from ..plans.spec import AggSpec
from ..sources.staging import shared_path
from .metrics import Tally


def file_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A table's files as a stream; ``max_files`` bounds a batch, which is how the source is held back."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a stream watches folders only


def start_complete(stream: DataFrame, spec: AggSpec, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the states in the state store and write the whole result after each batch."""
    totals, tally = partial(stream, spec), Tally()

    def write(batch: DataFrame, n: int) -> None:
        tally.between(n)
        finish(batch, spec).write.mode("overwrite").parquet(out)

    writer = totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return tally.follow(writer.trigger(availableNow=True).start())


def start_partials(stream: DataFrame, spec: AggSpec, stage: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's partial states; a batch that runs again overwrites its own files."""
    tally = Tally()

    def write(batch: DataFrame, n: int) -> None:
        tally.between(n)
        partial(batch, spec).write.mode("overwrite").parquet(f"{stage}/batch={n}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return tally.follow(writer.trigger(availableNow=True).start())


def _no_states(stream: DataFrame, spec: AggSpec) -> DataFrame:
    """The partial table of no rows."""
    return partial(stream.sparkSession.createDataFrame([], stream.schema), spec)


def _read(spark: SparkSession, path: str, empty: DataFrame) -> DataFrame:
    """What batches wrote below ``path``; ``empty`` where no batch came.  Folders of batches are no columns."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return empty
    return spark.read.option("recursiveFileLookup", True).schema(empty.schema).parquet(path)


def run_complete(stream: DataFrame, spec: AggSpec) -> tuple[DataFrame, StreamingQuery]:
    """Ingest all that is there now; the result as a plain table, and the query that made it."""
    spark = stream.sparkSession
    out = shared_path(spark, "stream-out")
    query = start_complete(stream, spec, out, shared_path(spark, "stream-state"))
    query.awaitTermination()
    empty = finish(_no_states(stream, spec), spec)
    return _read(spark, out, empty), query


def run_partials(stream: DataFrame, spec: AggSpec) -> tuple[DataFrame, StreamingQuery]:
    """As ``run_complete``, over staged partial states: an epoch is a stage folder and drains by being left behind."""
    spark = stream.sparkSession
    stage = shared_path(spark, "stream-stage")
    query = start_partials(stream, spec, stage, shared_path(spark, "stream-state"))
    query.awaitTermination()
    return finish(merge_partials([_read(spark, stage, _no_states(stream, spec))], spec), spec), query


def socket_stream(spark: SparkSession, host: str, port: int, schema: str) -> DataFrame:
    """JSON lines from a socket as records; lines that cannot be read are null records and are left out."""
    from pyspark.sql import functions as F

    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def send_batches(batches: list[DataFrame], folder: str) -> None:
    """The sending side of a load test: each batch becomes new files of a watched folder, complete when they appear."""
    for batch in batches:
        batch.write.mode("append").parquet(folder)


def watched_stream(spark: SparkSession, folder: str, schema: str, max_files: int | None = None) -> DataFrame:
    """The receiving side: records of files as they come into a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def stop(query: StreamingQuery) -> None:
    """Take in what is there now, then stop; the checkpoint lets another query go on from here."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()
