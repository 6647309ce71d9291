"""Reminder runs on a trigger, and the queue of pending files.

A run has its effect once through the reminders' key, not through offsets: what is in the
history isn't written again, so a repeated or retried batch is harmless.
"""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reminders import run_day

EVERY_MINUTES = 15
ZONE = "Asia/Ho_Chi_Minh"

log = logging.getLogger(__name__)


def reminder_cycle(read_docs: Callable[[], DataFrame], read_history: Callable[[], DataFrame], save: Callable[[DataFrame, DataFrame], None]) -> Callable[[dt.date], bool]:
    """One run of a business date: ``save`` gets the documents as they are now and the new reminders.

    A run that fails is logged and gives False; the next one does its work.
    """

    def run(day: dt.date) -> bool:
        try:
            docs, new, counts = run_day(read_docs(), read_history(), F.lit(day), F.current_timestamp())
            done = counts.first()
            save(docs, new)
        except Exception:
            log.exception("the reminder run of %s failed; the next one retries", day)
            return False
        log.info("reminder run of %s: %d overdue, %d created, %d there already", day, done.overdue, done.created, done.existing)
        return True

    return run


def reminder_batches(cycle: Callable[[dt.date], bool], zone: str = ZONE, clock: Callable[[ZoneInfo], dt.datetime] = dt.datetime.now):
    """A ``foreachBatch`` function: each batch of ticks is one run of the present business date.

    The ticks' own times don't count. After a downtime they catch up with days on which no
    run was made, and these are past: reminders are for today.
    """

    def run(ticks: DataFrame, batch_id: int) -> None:
        cycle(clock(ZoneInfo(zone)).date())

    return run


def start_reminders(spark: SparkSession, cycle: Callable[[dt.date], bool], checkpoint: str, minutes: int = EVERY_MINUTES, zone: str = ZONE) -> StreamingQuery:
    """Runs at once and then every ``minutes``; the checkpoint belongs on a shared file system."""
    if not 1 <= minutes <= 1440:
        raise ValueError("minutes are 1 to 1440")
    cycle(dt.datetime.now(ZoneInfo(zone)).date())
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(reminder_batches(cycle, zone)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{minutes} minutes").start()


def pending_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The queue of rows that wait for extraction, as a stream of a table's new files."""
    return spark.readStream.schema(schema).parquet(path).filter("extraction_status = 'Pending'")


def drain(stream: DataFrame, run, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; the next call goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
