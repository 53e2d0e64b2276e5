"""Integer codecs: run lengths, deltas, bit packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType


LARGEST = (1 << 32) - 1


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body).getItem(0)


def rle_encode(values: Column) -> Column:
    """[v, n, v, n, ...] of an array; an empty array for an empty one."""

    def encode(a: Column) -> Column:
        starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(a, i - 1)), i)), lambda i: i.isNotNull())
        runs = lambda s: F.transform(s, lambda i, k: F.array(F.get(a, i), (F.coalesce(F.get(s, k + 1), F.size(a)) - i).cast("long")))
        return F.flatten(_let(starts, runs))

    return _let(F.transform(values, lambda x: x.cast("long")), encode)


def rle_decode(pairs: Column) -> Column:
    """The array that ``rle_encode`` made ``pairs`` of."""
    decode = lambda p: F.flatten(
        F.transform(F.filter(p, lambda _, i: i % 2 == 0), lambda v, i: F.array_repeat(v, F.get(p, 2 * i + 1).cast("int")))
    )
    return _let(pairs, decode)


def _so_far(w: Window) -> Window:
    """The rows up to this one; without this, rows of one order would add up together."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rle_table(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, run, value, n): runs of equal values within each key, in order; rows of one order lie by value."""
    w = Window.partitionBy(*keys).orderBy(order, value)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.select(*keys, order, value, new.alias("_new")).withColumn("run", F.sum("_new").over(_so_far(w)))
    return runs.groupBy(*keys, "run", value).agg(F.count("*").alias("n"))


def delta_table(df: DataFrame, keys: list[str], order: str | list[str], value: str) -> DataFrame:
    """Each value as its difference from the one before it within the key; the first as it is.

    Rows of one order lie by value.  ``undelta_table`` needs an order that is
    total within each key: give more columns where one does not tell rows apart.
    """
    columns = [order] if isinstance(order, str) else order
    w = Window.partitionBy(*keys).orderBy(*columns, value)
    return df.select(*keys, *columns, (F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))).alias("delta"))


def undelta_table(df: DataFrame, keys: list[str], order: str | list[str], delta: str) -> DataFrame:
    """Values from their differences, row by row in a total order."""
    columns = [order] if isinstance(order, str) else order
    w = Window.partitionBy(*keys).orderBy(*columns, delta)
    return df.select(*keys, *columns, F.sum(delta).over(_so_far(w)).alias("value"))


def nlz(c: Column) -> Column:
    """Leading zeros of a 32-bit number; 32 for 0."""
    x = c.cast("long")
    return F.when(x == 0, F.lit(32)).otherwise(F.lit(32) - F.length(F.bin(x))).cast("int")


def bit_width(c: Column) -> Column:
    """Bits a 32-bit number needs; 0 for 0."""
    return F.lit(32) - nlz(c)


def low_mask(k: Column) -> Column:
    """A number with its k lowest bits set, k up to 32."""
    return F.pow(F.lit(2), k).cast("long") - 1


def lz4_bound(n: Column) -> Column:
    """Most bytes that LZ4 makes of n bytes."""
    size = n.cast("long")
    return size + F.floor(size / 255).cast("long") + 16


def log26(x: Column) -> Column:
    return F.log(26.0, x)


def pack(values: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as deltas in fragments of the width that takes the fewest bits in all.

    Words, little-endian: width, bits used in the last word, then the fragments
    from the most significant bit on.  A delta's lowest bits come first; each
    fragment ends in a bit that tells whether the delta goes on in the next.
    """
    deltas = np.diff(values.astype(np.int64), prepend=0)
    if len(values) and ((deltas < 0).any() or values[-1] > LARGEST):
        raise ValueError("values must ascend and have 32 bits")
    need = np.maximum(1, np.frexp(deltas.astype(np.float64))[1])  # bits of each delta; exact, as they have 32 at most
    sizes, number = np.unique(need, return_counts=True)
    k = min(range(1, 33), key=lambda w: ((-(-sizes // w) * number).sum() * (w + 1), w)) if len(values) else 1
    each = -(-need // k)
    step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    part = (np.repeat(deltas, each) >> (k * step)) & ((1 << k) - 1)
    bits = np.empty((len(part), k + 1), np.uint8)
    bits[:, :k] = (part[:, None] >> np.arange(k - 1, -1, -1)[None, :]) & 1
    bits[:, k] = step < np.repeat(each, each) - 1
    flat = bits.reshape(-1)
    body = np.packbits(np.pad(flat, (0, -len(flat) % 32))).view(">u4").astype("<u4")
    return np.concatenate((np.array([k, len(flat) % 32], "<u4"), body)).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    """The numbers that ``pack`` was given; ValueError for anything that it cannot have made."""
    if len(raw) < 8 or len(raw) % 4:
        raise ValueError("no whole words")
    words = np.frombuffer(raw, "<u4")
    k, rest = int(words[0]), int(words[1])
    bits = np.unpackbits(words[2:].astype(">u4").view(np.uint8))
    used = len(bits) - (32 - rest if rest else 0)
    if not 1 <= k <= 32 or rest > 31 or used < 0 or used % (k + 1) or bits[used:].any():
        raise ValueError("the width does not fit the length")
    table = bits[:used].reshape(-1, k + 1)
    if not len(table):
        return np.zeros(0, np.int64)
    more = table[:, k].astype(bool)
    first = np.flatnonzero(np.concatenate(([True], ~more[:-1])))
    step = np.arange(len(table)) - np.repeat(first, np.diff(np.concatenate((first, [len(table)]))))
    if more[-1] or int(step.max()) * k >= 32:
        raise ValueError("a number does not end")
    part = table[:, :k].astype(np.int64) @ (np.int64(1) << np.arange(k - 1, -1, -1))
    values = np.cumsum(np.add.reduceat(part << (k * step), first))
    if values[-1] > LARGEST:
        raise ValueError("a number has more than 32 bits")
    return values


@F.arrow_udf(BinaryType())
def delta_pack(column: pa.Array) -> pa.Array:
    """Arrays of ascending 32-bit numbers to packed bytes; null for null."""
    return pa.array([None if x is None else pack(np.array(x, np.int64)) for x in column.to_pylist()], pa.binary())


@F.arrow_udf(ArrayType(LongType()))
def delta_unpack(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unpack(x).tolist() for x in column.to_pylist()], pa.list_(pa.int64()))
