"""Tables that cut lineage, in the folder the cluster shares, and what Python workers hold.

``spark.checkpoint.dir`` names that folder; it is read from the session.  A
written table survives the loss of any executor, and the files are compressed,
which ``checkpoint()`` files are not.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..sources.staging import discard, shared_path

#: Bytes of texts that a step of a worker takes at once; a longer text is taken alone.
STEP = 4 << 20
#: Bytes of results after which a step hands them on.
HAND_ON = 4 << 20
#: Bytes of a row group of a table.
ROW_GROUP = 16 << 20


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    # small row groups: a writer holds one in memory, and what is written is read by many tasks
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what ``table`` wrote, once no plan in use reads it."""
    for t in tables:
        discard(t.sparkSession, t.scratch_path)


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` over a partition, giving memory back when it ends: an idle worker lives on and keeps what it has."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return wrapped


def sliced(batches: Batches, column: str, most: int = STEP) -> Batches:
    """The batches in slices that hold at most ``most`` bytes of a text or binary column, one row at least."""
    for batch in batches:
        if not len(batch):
            yield batch
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def parts(spark: SparkSession) -> int:
    """Partitions for an explicit shuffle: what the session asks of its own shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, names: list[str]) -> Column:
    """Columns that only travel along, as one struct called row, so that no name can clash with ours."""
    return F.struct(*(df[c] for c in names)).alias("row")


def with_row(df: DataFrame, **fields: DataType) -> StructType:
    """The schema of ``df``'s row and other fields."""
    return StructType([df.schema["row"], *(StructField(n, t) for n, t in fields.items())])


def squeezed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a binary column compressed row by row, for texts that are about to be shuffled."""
    at = df.columns.index(column)

    def run(batches: Batches) -> Batches:
        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in sliced(batches, column):
            made = [pack(x.as_buffer().to_pybytes()) if x.is_valid else None for x in batch.column(at)]
            columns = [*batch.columns[:at], pa.array(made, pa.binary()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(lean(run), df.schema)


def unsqueezed(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a column that ``squeezed`` made, one at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    for x in column:
        yield unpack(x.as_buffer().to_pybytes()) if x.is_valid else None
