"""Reminders by events: state and timers for each document, over a stream of its changes.

A business date is run when it begins. A batch run looks at every document on every date;
here each bucket of documents waits for the next date of any of them. A document has one
three days before its deadline, at the
deadline, each day after it, or the date after a change that has come in but isn't due
yet. Time is the changes' own, so a stream that is replayed, or that comes in late within
the watermark, ends in the same events as a run of each date over what was known before it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.reminders import DAYS_BEFORE, reminder_kind
from .reminders import ZONE

#: A change of a document; a null id only says how late it is.
CHANGES = "id string, deadline date, status string, assigned_to_staff_id string, at timestamp"
EVENTS = "incoming_document_id string, event string, recipient_staff_id string, reminder_kind string, reminder_date date"
#: Documents share state and timers by so many buckets.
BUCKETS = 1024
_EVENT = ["incoming_document_id", "event", "recipient_staff_id", "reminder_kind", "reminder_date"]
_STATE = pa.schema([("id", pa.string()), ("run", pa.date32()), ("ms", pa.int64()), ("deadline", pa.date32()), ("status", pa.string()), ("assigned_to_staff_id", pa.string())])
#: The provider that keeps timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = dt.timedelta(days=1)


class DeadlineEvents(StatefulProcessor):
    """Of a bucket of documents, for each: its facts as of the last date that was run, that date, and the changes since, by time.

    A call for state or timers is a message to Spark and back. A bucket makes as many of
    them for all of its documents as one document would.
    """

    def __init__(self, days_before: int = DAYS_BEFORE, zone: str = ZONE):
        self.days_before, self.zone = days_before, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "documents binary")

    def _begins(self, day: dt.date) -> int:
        return int(dt.datetime.combine(day, dt.time(), ZoneInfo(self.zone)).timestamp() * 1000)

    def _day(self, ms: int) -> dt.date:
        return dt.datetime.fromtimestamp(ms / 1000, ZoneInfo(self.zone)).date()

    def _first_run(self, ms: int) -> dt.date:
        """The first date that begins after a change."""
        return self._day(ms) + _DAY

    def _next_date(self, facts: tuple | None, after: dt.date | None) -> dt.date | None:
        """The next date at which the facts call for something."""
        if facts is None or facts[1] == "Completed" or facts[0] is None:
            return None
        calls = [facts[0] - dt.timedelta(days=self.days_before), facts[0]] if facts[2] is not None else []
        late = facts[0] + _DAY if after is None else max(facts[0] + _DAY, after + _DAY)
        if facts[2] is not None or facts[1] != "Overdue":
            calls.append(late)
        return min((d for d in calls if after is None or d > after), default=None)

    def _called(self, key: str, facts: tuple, day: dt.date) -> tuple[list[tuple], tuple]:
        deadline, status, staff = facts
        out = []
        if deadline < day and status != "Overdue":
            out.append((key, "overdue", None, None, day))
            facts = (deadline, "Overdue", staff)
        kind = "Overdue" if deadline < day else "DueDate" if deadline == day else "BeforeDeadline" if deadline == day + dt.timedelta(days=self.days_before) else None
        if staff is not None and kind:
            out.append((key, "reminder", staff, kind, day))
        return out, facts

    def _next(self, facts: tuple | None, run: dt.date | None, changes: list[tuple]) -> dt.date | None:
        """The next date that something is to be done for a document."""
        dates = (self._next_date(facts, run), min((self._first_run(c[0]) for c in changes), default=None))
        return min((d for d in dates if d is not None), default=None)

    def _read(self) -> dict[str, list]:
        """[facts, date of the last run, changes] by document."""
        documents: dict[str, list] = {}
        if (held := self.held.get()) is not None:
            table = pa.ipc.open_stream(held[0]).read_all()
            for key, run, ms, *facts in zip(*(column.to_pylist() for column in table.columns), strict=True):
                document = documents.setdefault(key, [None, None, []])
                if ms is None:
                    document[:2] = tuple(facts), run
                else:
                    document[2].append((ms, *facts))
        return documents

    def _keep(self, documents: dict[str, list]) -> None:
        """The bucket's state, a row of each document's facts and of each change that waits, and one timer, at the next date of any of them."""
        rows = []
        for key, (facts, run, changes) in documents.items():
            if facts is not None:
                rows.append((key, run, None, *facts))
            rows += [(key, None, *c) for c in changes]
        table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STATE, strict=True)], schema=_STATE) if rows else _STATE.empty_table()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _STATE) as writer:
            writer.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if (day := min((d for x in documents.values() if (d := self._next(*x)) is not None), default=None)) is not None:
            self.handle.registerTimer(self._begins(day))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        documents = self._read()
        for batch in rows:
            for name, *change in zip(*(batch[c].tolist() for c in ("id", "ms", "deadline", "status", "assigned_to_staff_id")), strict=True):
                if name is not None:
                    documents.setdefault(name, [None, None, []])[2].append(tuple(change))
        if documents:
            self._keep(documents)
        yield from ()

    def _run(self, key: str, facts: tuple | None, run: dt.date | None, changes: list[tuple], now: dt.date) -> tuple[list[tuple], list]:
        """A document's events up to a date, and what it holds then."""
        changes.sort(key=lambda c: (c[0], str(c[1:])))
        out: list[tuple] = []
        while (day := self._next(facts, run, changes[:1])) is not None and day <= now:
            while changes and self._first_run(changes[0][0]) <= day:
                facts = changes.pop(0)[1:]
            if facts[1] != "Completed" and facts[0] is not None:
                found, facts = self._called(key, facts, day)
                out += found
            run = day
        return out, [facts, run, changes]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        documents = self._read()
        now = self._day(timerValues.getCurrentWatermarkInMs())
        out: list[tuple] = []
        for name, document in documents.items():
            found, documents[name] = self._run(name, *document, now)
            out += found
        self._keep(documents)
        if out:
            yield pd.DataFrame(out, columns=_EVENT, dtype=object)

    def close(self) -> None:
        pass


def deadline_events(changes: DataFrame, delay: str = "1 day", days_before: int = DAYS_BEFORE, zone: str = ZONE, buckets: int = BUCKETS) -> DataFrame:
    """A stream of events (incoming_document_id, event, recipient_staff_id, reminder_kind, reminder_date) of a stream of changes.

    ``event`` is overdue where an open document's state becomes Overdue, and reminder where
    an assigned one calls for one; a key of document, event and date comes once. Changes
    may come late by up to ``delay``. Timers need the RocksDB state store. Documents share
    state and timers by ``buckets`` of their ids' hashes; a checkpoint keeps its number.
    """
    # The instant as a number: a timestamp in Python is a session's local time.
    keyed = changes.withWatermark("at", delay).withColumn("ms", F.unix_millis("at")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).groupBy("bucket")
    return keyed.transformWithStateInPandas(DeadlineEvents(days_before, zone), EVENTS, "Append", "EventTime")


def replayed(changes: DataFrame, until: Column, days_before: int = DAYS_BEFORE, zone: str = ZONE) -> DataFrame:
    """The same events from a table of all changes: each date up to ``until`` is run over the state that was known before it."""
    local = F.to_date(F.from_utc_timestamp(F.to_utc_timestamp("at", F.current_timezone()), zone))
    rows = changes.filter("id IS NOT NULL").withColumn("first", F.date_add(local, 1))
    after = Window.partitionBy("id").orderBy("at", F.struct("deadline", "status", "assigned_to_staff_id").cast("string"))
    rows = rows.withColumn("last", F.least(F.coalesce(F.date_sub(F.lead("first").over(after), 1), until), until)).filter("first <= last AND status <> 'Completed' AND deadline IS NOT NULL")
    # Only dates that call for something are made, so an open document costs nothing before its deadline.
    late = F.greatest("first", F.date_add("deadline", 1))
    days = F.array_distinct(
        F.filter(
            F.concat(F.array(F.date_sub("deadline", days_before), F.col("deadline")), F.when(late <= F.col("last"), F.sequence(late, "last")).otherwise(F.array().cast("array<date>"))),
            lambda d: d.between(F.col("first"), F.col("last")),
        )
    )
    calls = rows.withColumn("day", F.explode(days))
    overdue = calls.filter((F.col("day") == late) & (F.col("status") != "Overdue") & (F.col("day") > F.col("deadline")))
    none = F.lit(None).cast("string")
    marked = overdue.select(F.col("id").alias("incoming_document_id"), F.lit("overdue").alias("event"), none.alias("recipient_staff_id"), none.alias("reminder_kind"), F.col("day").alias("reminder_date"))
    kind = reminder_kind(F.col("deadline"), F.col("day"), days_before)
    sent = calls.withColumn("reminder_kind", kind).filter("assigned_to_staff_id IS NOT NULL AND reminder_kind IS NOT NULL")
    sent = sent.select(F.col("id").alias("incoming_document_id"), F.lit("reminder").alias("event"), F.col("assigned_to_staff_id").alias("recipient_staff_id"), "reminder_kind", F.col("day").alias("reminder_date"))
    return marked.unionByName(sent)


def replay_files(spark: SparkSession, path: str, out: str, checkpoint: str, delay: str = "1 day", files: int | None = None, days_before: int = DAYS_BEFORE, zone: str = ZONE, buckets: int = BUCKETS) -> DataFrame:
    """Run the stream over the files of changes that are there, and stop; the events so far. The next call goes on from the checkpoint."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        reader = spark.readStream.schema(CHANGES)
        stream = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)
        deadline_events(stream, delay, days_before, zone, buckets).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(EVENTS).parquet(out)
