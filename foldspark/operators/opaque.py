"""Merges that only Python knows, with a combine before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

Merge = Callable[[dict, dict], dict]


def _fold(merge: Merge, key: str, names: list[str], schema: pa.Schema, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            rows = [{key: k, **s} for k, s in held.items()]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                k = row.pop(key)
                held[k] = merge(held[k], row) if k in held else row
                if len(held) > limit:  # partial states can be merged again, so it is safe to let go of them
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def _final(merge: Merge, key: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, at, state = False, None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                k = row.pop(key)
                if began and k == at:
                    state = merge(state, row)
                else:
                    if began:
                        done.append({key: at, **state})
                    began, at, state = True, k, row
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if began:
            yield pa.RecordBatch.from_pylist([{key: at, **state}], schema=schema)

    return run


def opaque_aggregate(states: DataFrame, key: str, merge: Merge, limit: int = 100_000) -> DataFrame:
    """Fold ``states`` (the key and state columns) by a commutative, associative Python ``merge(acc, x)``.

    Each partition folds what it has in a bounded dictionary; the partial
    states are shuffled and sorted by key and folded as they stream past, so
    neither step holds more than ``limit`` states or one key's running state.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([StructField(f.name, f.dataType, True) for f in states.schema])
    arrow = to_arrow_schema(schema)
    names = [c for c in states.columns if c != key]
    first = states.mapInArrow(_fold(merge, key, names, arrow, limit), schema)
    return first.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(_final(merge, key, arrow), schema)


def divide(states: DataFrame, column: str, pieces: int) -> DataFrame:
    """Each whole-number sum state as ``pieces`` states which add up to it again."""
    n = F.lit(pieces)
    share = F.floor(F.col(column) / n).cast("long")
    first = F.col(column) - share * (n - 1)
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, first).otherwise(share))
    return states.withColumn(column, F.explode(cut))
