"""Streams against batches, the wire format, and the senders and receivers of load tests."""

import socket
import threading

import pytest
from pyspark.sql import functions as F

from foldspark.plans.engine import aggregate
from foldspark.plans.spec import AggSpec, StateCol
from foldspark.sources import wire
from foldspark.sources.datagen import generate
from foldspark.sources.staging import shared_path
from foldspark.streaming import ingest, metrics

SCHEMA = "key string, count long"


def counts():
    return AggSpec({"key": F.col("key")}, (StateCol("count", F.col("count")),))


def as_dict(df):
    return {r["key"]: r["count"] for r in df.collect()}


@pytest.mark.parametrize("run", [ingest.run_complete, ingest.run_partials])
def test_stream_is_batch(spark, run):
    folder = shared_path(spark, "sent")
    batches = [generate(spark, 500, 30, 5, seed=n, slices=2) for n in range(3)]
    ingest.send_batches(batches, folder)
    result, query = run(ingest.watched_stream(spark, folder, SCHEMA, 2), counts())
    assert as_dict(result) == as_dict(aggregate(spark.read.parquet(folder), counts()))
    assert metrics.total_rows(spark, query).first()["total_rows"] == 1500
    assert len(metrics.progress(query)) == 3


def test_stage_goes_on_and_epochs_start_afresh(spark):
    """A query that starts again takes only what is new; another stage is another epoch."""
    folder, stage, state = (shared_path(spark, x) for x in ("sent", "stage", "state"))
    for n, want in ((1, 1), (5, 6)):
        ingest.send_batches([spark.createDataFrame([("a", n)], SCHEMA)], folder)
        ingest.start_partials(ingest.watched_stream(spark, folder, SCHEMA), counts(), stage, state).awaitTermination()
        held = spark.read.parquet(stage).groupBy("key").agg(F.sum("count").alias("count"))
        assert as_dict(held) == {"a": want}
    ingest.send_batches([spark.createDataFrame([("b", 2)], SCHEMA)], folder)
    second = shared_path(spark, "stage")
    ingest.start_partials(ingest.watched_stream(spark, folder, SCHEMA), counts(), second, state).awaitTermination()
    assert as_dict(spark.read.parquet(second)) == {"b": 2}


def test_socket(spark):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = server.accept()
        with peer:
            peer.sendall(b'{"key": "a", "count": 1}\n{broken\n{"key": "a", "count": 2}\n')
            done.wait(60)

    done = threading.Event()
    threading.Thread(target=serve, daemon=True).start()
    stream = ingest.socket_stream(spark, "127.0.0.1", server.getsockname()[1], SCHEMA)
    seen = []
    write = lambda batch, _: seen.extend((r["key"], r["count"]) for r in batch.collect())
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", shared_path(spark, "socket")).start()
    try:
        for _ in range(60):
            query.processAllAvailable()
            if sum(c or 0 for _, c in seen) == 3:
                break
            query.awaitTermination(1)
    finally:
        ingest.stop(query)
        done.set()
        server.close()
    assert [x for x in seen if x[0]] == [("a", 1), ("a", 2)]


def test_wire_format():
    records = [("", 0), ("a", 1), ("é" * 100, 4294967295), ("k" * 200, 300)]
    raw = b"".join(wire.encode_record(*r) for r in records)
    assert wire.decode_records(raw) == records
    assert wire.encode_record("test", 1) == b"\x08\n\x04test\x10\x01"
    extra = b"\x03\x18\x07\x20"
    for bad in (raw[:-1], b"\x05", b"\xff" * 11, b"\x02\x10\x01", b"\x01\x0f", extra):
        with pytest.raises(ValueError):
            wire.decode_records(bad)


def test_wire_batches(spark):
    rows = [("a", 1), ("b" * 300, 2), ("a", 4294967295), (None, 1)]
    made = wire.encode(spark.createDataFrame(rows, SCHEMA).coalesce(1), 2)
    assert made.count() == 2
    both = made.unionByName(spark.createDataFrame([(bytearray(b"\x05"),), (None,)], "batch binary"))
    decoded = wire.decode(both)
    assert sorted((r.key, r["count"]) for r in wire.accepted(decoded).collect()) == sorted(rows[:3])
    assert [bytes(r.rejected) for r in decoded.where("rejected is not null").collect()] == [b"\x05"]


def test_rows_are_counted_on_the_way(spark):
    df, seen = metrics.counted(spark.range(123), "passed")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 123}


@pytest.mark.parametrize("run", [ingest.run_complete, ingest.run_partials])
def test_total_rows_of_more_batches_than_the_query_remembers(spark, tmp_path, run):
    folder, kept = str(tmp_path / "in"), "spark.sql.streaming.numRecentProgressUpdates"
    ingest.send_batches([generate(spark, 10 + n, 3, 2, seed=n, slices=1) for n in range(5)], folder)
    spark.conf.set(kept, 3)
    try:
        _, query = run(ingest.watched_stream(spark, folder, SCHEMA, 1), counts())
        assert len(metrics.progress(query)) < 5
        assert metrics.total_rows(spark, query).first()["total_rows"] == 60
    finally:
        spark.conf.unset(kept)


@pytest.mark.parametrize("run", [ingest.run_complete, ingest.run_partials])
def test_streams_without_files(spark, tmp_path, run):
    (tmp_path / "in").mkdir()
    result, _ = run(ingest.watched_stream(spark, str(tmp_path / "in"), SCHEMA), counts())
    assert result.columns == ["key", "count"] and result.count() == 0


@pytest.mark.parametrize("run", [ingest.run_complete, ingest.run_partials])
def test_a_key_called_batch(spark, tmp_path, run):
    folder = str(tmp_path / "in")
    ingest.send_batches([spark.createDataFrame([("x", 1), ("y", 2)], SCHEMA), spark.createDataFrame([("x", 5)], SCHEMA)], folder)
    spec = AggSpec({"batch": F.col("key")}, (StateCol("count", F.col("count")),))
    result, _ = run(ingest.watched_stream(spark, folder, SCHEMA, 1), spec)
    assert {r["batch"]: r["count"] for r in result.collect()} == {"x": 6, "y": 2}
