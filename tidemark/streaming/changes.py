"""Change streams into an engine: each micro-batch is a batch of operations, applied once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.relational import trigger
from tidemark.plans.engine import Engine
from tidemark.sources.store import APPEND, Store, signed


def follow(engine: Engine, table: str, changes: DataFrame, checkpoint: str, once: bool = True, order: Sequence[str] = ("_seq",)) -> StreamingQuery:
    """Applies a stream of rows with the table's columns, _op and _seq. once: takes what is there and ends.

    order: the columns that say in what order changes apply; other than _seq, they make its numbers, batch by batch. The engine notes a batch's number in the
    same step as the batch itself, so a batch that is played again after a failure counts once, also in an engine that was reopened since.
    """
    stream = f"{table}<{checkpoint}"

    def take(batch: DataFrame, number: int) -> None:
        if tuple(order) != ("_seq",):  # places in that order, taken on all machines
            batch = batch.drop("_seq").orderBy(*order).withColumn("_seq", F.monotonically_increasing_id())
        engine.write_rows(table, batch, stream, number)

    writer = changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class NewKeys:
    """Calls event with the keys of each batch that no earlier batch had. Seen keys are stored, not held."""

    def __init__(self, key: str, event: Callable[[DataFrame], None], folder: str | None = None):
        self.key, self.event, self.folder = key, event, folder
        self.seen: Store | None = None

    def __call__(self, batch: DataFrame, number: int = 0) -> None:
        if self.seen is None:
            self.seen = Store(batch.select(self.key).limit(0), APPEND, folder=self.folder, own=True)
        new = self.seen.write(signed(trigger(batch, self.seen.rows, self.key))).select(self.key)
        self.seen.settle()
        if not new.isEmpty():
            self.event(new)


def windowed(stream: DataFrame, time: str, width: str, late: str, by: Sequence[str], slide: str | None = None) -> DataFrame:
    """Counts by window of event time and columns; rows later than late are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(w.alias("__w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *by, "n")
