"""What an ingest did: rows in all, and rows a second."""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def progress(query: StreamingQuery) -> list[tuple[int, int, float]]:
    """(batch, rows, rows a second) of the batches the query still remembers."""
    return [(p["batchId"], p["numInputRows"], float(p.get("processedRowsPerSecond") or 0.0)) for p in query.recentProgress]


class Tally:
    """Rows of every batch of one query, also of those which the query no longer remembers.

    A batch's progress is taken in before the next batch is written, so none is
    dropped in between; a batch reported twice counts once.
    """

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.written: set[int] = set()
        self._query: StreamingQuery | None = None
        self._started = Event()

    def follow(self, query: StreamingQuery) -> StreamingQuery:
        """The query itself; ``total_rows`` finds the tally with it."""
        query.tally = self
        self._query = query
        self._started.set()
        return query

    def take(self, newest: dict | None) -> None:
        if newest is not None:
            self.rows[newest["batchId"]] = max(newest["numInputRows"], self.rows.get(newest["batchId"], 0))

    def between(self, batch: int) -> None:
        """To be called by each batch before it is written."""
        self.written.add(batch)
        if not self._started.wait(60):
            raise TimeoutError("a batch came before its query was known")
        self.take(self._query.lastProgress)


def total_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """(total_rows): all rows that this query inserted.

    Queries of ``ingest`` are counted over all their batches.  Of any other
    query only what it remembers is known: one that may have dropped batches,
    or a batch whose progress never came, is an error and not a smaller number.
    """
    known = query.recentProgress
    tally = getattr(query, "tally", None)
    if tally is None:
        tally = Tally()
        # Spark drops the oldest as soon as there are so many
        if len(known) + 1 >= int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")):
            raise ValueError("the query may have forgotten batches")
    for p in known:
        tally.take(p)
    if not tally.written <= tally.rows.keys():
        raise ValueError("batches without progress")
    return spark.range(1).selectExpr(f"cast({sum(tally.rows.values())} as bigint) AS total_rows")


def counted(df: DataFrame, name: str):
    """(df, observation): the rows that pass, counted on the way without another job."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
