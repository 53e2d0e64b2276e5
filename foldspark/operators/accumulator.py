"""An accumulator of batches: insert, snapshot, cursor, pages in hash order, drain."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import engine_hash
from ..plans.engine import finish, merge_partials, partial
from ..plans.spec import AggSpec
from ..sources.staging import shared_path

HASH = "key_hash"
#: Ranges of hashes that are counted for pages.
RANGE_BITS = 20
RANGES = 1 << (32 - RANGE_BITS)


class Accumulator:
    """Folds any number of inserted batches by key.

    Batches become partial states at once (lazily, or as Parquet files when
    ``staged``), so what is kept grows with the keys of each batch and not
    with its rows.  ``fan`` partial tables of a level are merged into one of the
    next, which is written: after n inserts there are fewer than ``fan`` tables a
    level and log(n) levels, and no plan has more.  A read is a snapshot: later
    inserts do not show in it, so what it reads is not deleted.  Rows come back
    ordered by the 32-bit hash of the key, then by the key.
    """

    def __init__(self, spark: SparkSession, spec: AggSpec, staged: bool = False, fan: int = 8):
        if HASH in (*spec.keys, *(s.name for s in spec.states), *spec.finish):
            raise ValueError(f"{HASH} is the name of the hash in results")
        if fan < 2:
            raise ValueError("a level takes two tables at least")
        self.spark, self.spec, self.staged, self.fan = spark, spec, staged, fan
        self._schema = None
        self._levels: list[list[DataFrame]] = []
        self._walk: tuple[DataFrame, list[int]] | None = None

    @property
    def parts(self) -> list[DataFrame]:
        """The partial tables that are held."""
        return [x for level in self._levels for x in level]

    def insert(self, record: dict | Row) -> None:
        """Insert one record."""
        values = record.asDict() if isinstance(record, Row) else record
        self.bulk_insert(self.spark.createDataFrame([Row(**values)], self._schema))

    def bulk_insert(self, batch: DataFrame) -> None:
        """Insert a batch; batches of one accumulator have one schema."""
        kinds = [(f.name, f.dataType) for f in batch.schema]
        if self._schema is None:
            self._schema = batch.schema
        elif kinds != [(f.name, f.dataType) for f in self._schema]:
            raise ValueError(f"a batch of {batch.schema.simpleString()} does not fit {self._schema.simpleString()}")
        self.insert_states(partial(batch, self.spec))

    def insert_states(self, states: DataFrame) -> None:
        """Insert a partial table, such as another accumulator's or one of ``partials_by``."""
        self._put(0, self._written(states, "partials") if self.staged else states)

    def _written(self, states: DataFrame, label: str) -> DataFrame:
        path = shared_path(self.spark, label)
        states.write.parquet(path)
        return self.spark.read.schema(states.schema).parquet(path)

    def _put(self, level: int, states: DataFrame) -> None:
        self._walk = None
        if level == len(self._levels):
            self._levels.append([])
        self._levels[level].append(states)
        if len(self._levels[level]) == self.fan:
            full, self._levels[level] = self._levels[level], []
            self._put(level + 1, self._written(merge_partials(full, self.spec), f"level-{level + 1}"))

    def compact(self) -> None:
        """Merge what was inserted so far into one partial table."""
        if len(self.parts) > 1:
            merged = self._written(merge_partials(self.parts, self.spec), "compacted")
            self._levels = [[] for _ in self._levels[:-1]] + [[merged]]

    def snapshot(self) -> DataFrame | None:
        """All that was inserted, folded and finished; None before the first insert."""
        return finish(merge_partials(self.parts, self.spec), self.spec) if self.parts else None

    def hashed(self) -> DataFrame | None:
        """The snapshot with the hash of its (first) key."""
        df = self.snapshot()
        return None if df is None else df.withColumn(HASH, engine_hash(F.col(next(iter(self.spec.keys))).cast("string")))

    def _walked(self) -> tuple[DataFrame, list[int]]:
        """The snapshot written once in hash order, and how many rows each range of hashes has; kept until the next insert."""
        if self._walk is None:
            df = self.hashed().orderBy(HASH, *self.spec.keys)
            path = shared_path(self.spark, "pages")
            df.write.parquet(path)
            df = self.spark.read.schema(df.schema).parquet(path)
            sizes = [0] * RANGES
            for r in df.where(F.col(HASH).isNotNull()).groupBy(F.shiftright(HASH, RANGE_BITS).alias("range")).count().collect():  # RANGES rows at most
                sizes[r["range"]] = r["count"]
            self._walk = df, sizes
        return self._walk

    def read(self, limit: int | None = None, after: tuple | None = None) -> DataFrame | None:
        """Rows in hash order; at most ``limit``, and only those after (hash, keys...) of the last row of a page.

        Null keys have a null hash and come first.  The first page folds and
        takes the top rows.  From the second one on pages come from a snapshot
        that is written once in hash order, and read no more ranges of hashes
        than hold them.
        """
        if not self.parts:
            return None
        if after is not None:
            return self._page(limit, after)
        df = self.hashed().orderBy(HASH, *self.spec.keys)
        return df if limit is None else df.limit(limit)

    def _page(self, limit: int | None, after: tuple | None) -> DataFrame:
        order = [HASH, *self.spec.keys]
        df, sizes = self._walked()
        least = None if after is None else after[0]
        if after is not None:
            df = df.where(F.struct(*order) > F.struct(*(F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, after, strict=True))))
        if limit is not None:
            # rows of the range that the last page ended in may lie before it: they are read, and not counted on
            last, found = -1 if least is None else int(least) >> RANGE_BITS, 0
            while found < limit and last + 1 < RANGES:
                last += 1
                found += sizes[last]
            below = F.col(HASH) < (last + 1) << RANGE_BITS
            df = df.where(below if least is not None else below | F.col(HASH).isNull())
        df = (df if least is None else df.where(F.col(HASH) >= least)).orderBy(*order)
        return df if limit is None else df.limit(limit)

    def pages(self, size: int) -> Iterator[list[Row]]:
        """The rows of a snapshot taken now, in hash order, in pages of ``size``."""
        if not self.parts:
            return
        frozen = Accumulator(self.spark, self.spec, fan=self.fan)
        frozen._levels, after = [self.parts], None
        while page := frozen._page(size, after).collect():
            yield page
            after = (page[-1][HASH], *(page[-1][k] for k in self.spec.keys))

    def cursor(self) -> Iterator[Row]:
        """Every row of a snapshot taken now, in hash order, a partition at a time."""
        df = self.read()
        return iter(()) if df is None else df.toLocalIterator(prefetchPartitions=True)

    def drain(self) -> DataFrame | None:
        """The snapshot, leaving the accumulator empty for the next epoch."""
        df = self.snapshot()
        self.clear()
        return df

    def clear(self) -> None:
        self._levels, self._schema, self._walk = [], None, None


def partition_report(df: DataFrame) -> DataFrame:
    """(partition, elements) of a result: how evenly it lies."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("elements"))
