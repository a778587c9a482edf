"""The poll: each batch of entries against the ledger, marked only after success."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.relational import first_per_group, new_entries
from lectern.sources import ledger

PER_RUN = 5


def handle(batch: DataFrame, path: str, process: Callable[[DataFrame], DataFrame], per_run: int = PER_RUN) -> None:
    """One batch: new entries, at most `per_run` of a feed in feed order, processed; those
    that `process` returns with ok = true are written to the ledger, last of all.

    A row that failed stays unseen and is met again with the next full snapshot.
    """
    spark = batch.sparkSession
    fresh = new_entries(batch.dropDuplicates(ledger.KEYS), ledger.read(spark, path), ledger.KEYS)
    done = process(first_per_group(fresh, "feed_url", ["entry_pos"], per_run).drop("place")).filter("ok")
    ledger.mark(spark, path, done)


def start(entries: DataFrame, path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], every: str | None = None, per_run: int = PER_RUN):
    """A streaming query over full snapshots of the feeds; every: a trigger interval, or one run."""
    writer = entries.writeStream.foreachBatch(lambda df, _: handle(df, path, process, per_run)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
