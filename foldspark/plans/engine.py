"""The fold: partial states, merging of partial states at any level, finishing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import shared_path
from .spec import AggSpec


def partial(df: DataFrame, spec: AggSpec) -> DataFrame:
    """One row per key with its states, from raw rows; Spark combines before the shuffle."""
    keyed = df.withColumns({f"__key_{k}": c for k, c in spec.keys.items()})
    out = keyed.groupBy(*(F.col(f"__key_{k}") for k in spec.keys)).agg(*(s.first() for s in spec.states))
    return out.withColumnsRenamed({f"__key_{k}": k for k in spec.keys})


def partials_by(df: DataFrame, spec: AggSpec, batch: Column, batches: int) -> list[DataFrame]:
    """Partial tables of ``batches`` parts of ``df``, whose number (from 0) is the integer ``batch``, in one pass over it.

    The states of all parts are written as one table, small as they are folded
    already; each part is a filter of that.  Rows with a null number, or one out
    of range, are refused.
    """
    name = "_batch"
    while name in (*spec.keys, *(s.name for s in spec.states)):
        name += "_"
    number = F.when(batch.between(0, batches - 1), batch).otherwise(F.raise_error(F.lit("a row belongs to no batch")))
    inner = AggSpec({**spec.keys, name: number.cast("int")}, spec.states)
    states = partial(df, inner)
    path = shared_path(df.sparkSession, "batches")
    states.write.parquet(path)
    held = df.sparkSession.read.schema(states.schema).parquet(path)
    return [held.where(F.col(name) == n).drop(name) for n in range(batches)]


def merge_partials(parts: list[DataFrame], spec: AggSpec) -> DataFrame:
    """Fold partial tables into one; the result is a partial table again.

    Partial tables with other columns than the spec's are refused.
    """
    names = [*spec.keys, *(s.name for s in spec.states)]
    for p in parts:
        if set(p.columns) != set(names):
            raise ValueError(f"a partial table with columns {p.columns} does not fit {names}")
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy(*spec.keys).agg(*(s.again() for s in spec.states))


def finish(states: DataFrame, spec: AggSpec) -> DataFrame:
    """Outputs from states; the states themselves where the spec has no finish."""
    if not spec.finish:
        return states
    return states.select(*spec.keys, *(c.alias(n) for n, c in spec.finish.items()))


def aggregate(df: DataFrame, spec: AggSpec) -> DataFrame:
    """Group, fold and finish in one plan."""
    return finish(partial(df, spec), spec)


def distinct_keys(df: DataFrame, spec: AggSpec) -> DataFrame:
    return df.select(*(c.alias(k) for k, c in spec.keys.items())).distinct()


def reaggregate(parts: list[DataFrame], spec: AggSpec, fan_in: int) -> DataFrame:
    """Merge many partial tables level by level, ``fan_in`` at a time."""
    while len(parts) > 1:
        parts = [merge_partials(parts[i : i + fan_in], spec) for i in range(0, len(parts), fan_in)]
    return merge_partials(parts, spec)
