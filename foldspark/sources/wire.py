"""Batches of records in the protobuf wire format: (key string = 1, count uint32 = 2), each after its length.

A batch is one binary value.  Lengths are varints, so records of any size keep
their batch in step.  A batch that cannot be read is set aside whole, as the
sender gets one answer for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field number times 8, plus the wire type (2 for bytes, 0 for a varint).
KEY_TAG, COUNT_TAG = 0x0A, 0x10
LIMIT = 1 << 32


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(raw: bytes, at: int) -> tuple[int, int]:
    """(number, place after it); ValueError where the bytes end or go on too long."""
    n = 0
    for shift in range(0, 70, 7):
        if at >= len(raw):
            break
        byte = raw[at]
        at += 1
        n |= (byte & 0x7F) << shift
        if byte < 0x80:
            return n, at
    raise ValueError("a varint does not end")


def encode_record(key: str, count: int) -> bytes:
    name = key.encode()
    body = bytes([KEY_TAG]) + put_varint(len(name)) + name + bytes([COUNT_TAG]) + put_varint(count % LIMIT)
    return put_varint(len(body)) + body


def decode_records(raw: bytes) -> list[tuple[str, int]]:
    """The records of a batch; fields it does not know are passed over, missing ones are an error."""
    out, at = [], 0
    while at < len(raw):
        size, at = get_varint(raw, at)
        end = at + size
        if end > len(raw):
            raise ValueError("a record is cut short")
        found: dict[int, bytes | int] = {}
        while at < end:
            tag, at = get_varint(raw, at)
            if tag & 7 == 2:
                n, at = get_varint(raw, at)
                found[tag], at = raw[at : at + n], at + n
            elif tag & 7 == 0:
                found[tag], at = get_varint(raw, at)
            elif tag & 7 in (1, 5):
                at += 8 if tag & 7 == 1 else 4
            else:
                raise ValueError("no such wire type")
        if at != end or KEY_TAG not in found or COUNT_TAG not in found:
            raise ValueError("a record does not hold a key and a count")
        out.append((found[KEY_TAG].decode(), found[COUNT_TAG] % LIMIT))
    return out


def encode(records: DataFrame, size: int = 100_000) -> DataFrame:
    """``records(key, count)`` as batches of at most ``size`` records, one binary ``batch`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode_record(k, c) for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(made[i : i + size]) for i in range(0, len(made), size)], pa.binary())], ["batch"])

    return records.where("key is not null and count is not null").select("key", "count").mapInArrow(run, "batch binary")


def decode(batches: DataFrame) -> DataFrame:
    """(key, count, rejected) of a column ``batch``; ``rejected`` is a batch that cannot be read, else null."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, counts, rejected = [], [], []
            for raw in part.column(0).to_pylist():
                try:
                    records = decode_records(raw or b"")
                except ValueError:
                    records = [(None, None)]
                    rejected.append(raw)
                else:
                    rejected += [None] * len(records)
                keys += [k for k, _ in records]
                counts += [c for _, c in records]
            columns = [pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(rejected, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "count", "rejected"])

    return batches.select("batch").mapInArrow(run, "key string, count long, rejected binary")


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("rejected").isNull()).select("key", "count")
