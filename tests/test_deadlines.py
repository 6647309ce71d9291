"""Events from state and timers against a run of each date over the table of changes."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.operators.reminders import run_day
from paperloom.sources.tables import empty_table
from paperloom.streaming.deadlines import CHANGES, DeadlineEvents, replay_files, replayed

START = dt.date(2026, 3, 1)
UTC = dt.timezone.utc


def day(n, hour=5):
    return dt.datetime(2026, 3, 1, hour, tzinfo=UTC) + dt.timedelta(days=n)


def written(spark, path, rows):
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(path)


def events(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def random_changes(seed, documents=12):
    draw = random.Random(seed)
    rows = []
    for i in range(documents):
        deadline, staff, status = START + dt.timedelta(days=draw.randint(2, 14)), None, "New"
        for at in sorted(draw.sample(range(24), draw.randint(1, 5))):
            rows.append((f"d{i}", deadline, status, staff, day(at, draw.randint(0, 23))))
            deadline += dt.timedelta(days=draw.choice([0, 0, 0, 4, -3]))
            staff, status = draw.choice([staff, "s1", "s2"]), draw.choice(["InProgress", "InProgress", "Completed"] if at > 8 else ["New", "InProgress"])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_ends_as_the_batch_run(spark, tmp_path, seed):
    """Out of order within the watermark, over several files and two starts."""
    rows = random_changes(seed)
    rows.sort(key=lambda r: r[4] + dt.timedelta(hours=random.Random(str(r)).randint(0, 20)))
    path, out, cp = (str(tmp_path / x) for x in ("changes", "out", "cp"))
    third = len(rows) // 3
    written(spark, path, rows[:third])
    replay_files(spark, path, out, cp, files=1)
    written(spark, path, rows[third : 2 * third])
    written(spark, path, [*rows[2 * third :], (None, None, None, None, day(40))])
    found = replay_files(spark, path, out, cp, files=1)
    table = spark.createDataFrame(rows, CHANGES)
    assert events(found) == events(replayed(table, F.lit(dt.date(2026, 4, 9))))


def test_replay_is_the_daily_run(spark):
    """The events of the table are those of one run for each date."""
    rows = random_changes(3, 8)
    table = spark.createDataFrame(rows, CHANGES)
    want, state, history = [], {}, []
    for n in range(1, 30):
        date = START + dt.timedelta(days=n)
        begin = dt.datetime(date.year, date.month, date.day, tzinfo=UTC) - dt.timedelta(hours=7)
        for r in sorted(rows, key=lambda r: r[4]):
            if begin - dt.timedelta(days=1) <= r[4] < begin or (n == 1 and r[4] < begin):
                state[r[0]] = r
        if not state:
            continue
        docs = spark.createDataFrame([r[:4] for r in state.values()], "id string, deadline date, status string, assigned_to_staff_id string").withColumn("updated_at", F.current_timestamp())
        out, new, _ = run_day(docs, empty_table(spark, "reminder_history"), F.lit(date), F.current_timestamp())
        want += [str((r.incoming_document_id, "reminder", r.recipient_staff_id, r.reminder_kind, date)) for r in new.collect()]
        for r in out.filter("status = 'Overdue'").collect():
            if state[r.id][2] != "Overdue":
                want.append(str((r.id, "overdue", None, None, date)))
                state[r.id] = (*state[r.id][:2], "Overdue", *state[r.id][3:])
        history.append(date)
    assert events(replayed(table, F.lit(history[-1]))) == sorted(want)


class Counted:
    """Stands for state and timers of one key, and counts what is asked of them."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, []

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "update":
                self.value = args[0]
            elif name == "registerTimer":
                self.timers = [args[0]]
            elif name == "getCurrentWatermarkInMs":
                return int(day(30).timestamp() * 1000)
            return {"getValueState": self, "get": self.value, "listTimers": self.timers}.get(name)

        return call


def test_calls_for_state_do_not_grow_with_documents():
    """Each is a message to Spark and back: a bucket of many documents asks as often as one document."""
    asked = []
    for documents in (1, 400):
        held, processor = Counted(), DeadlineEvents()
        processor.init(held)
        rows = pd.DataFrame([(f"d{i}", int(day(n).timestamp() * 1000), START + dt.timedelta(days=6), "New", "s1") for i in range(documents) for n in (0, 2)], columns=["id", "ms", "deadline", "status", "assigned_to_staff_id"])
        assert not list(processor.handleInputRows((7,), iter([rows]), held))
        out = pd.concat(list(processor.handleExpiredTimer((7,), held, None)))
        assert set(out["incoming_document_id"]) == {f"d{i}" for i in range(documents)}
        assert len(out) == 27 * documents
        asked.append(held.calls)
    assert asked[0] == asked[1]


def test_one_bucket_for_all_documents(spark, tmp_path):
    """Documents that share a bucket keep their own facts; other starts go on from its state."""
    rows = random_changes(5, 30)
    path, out, cp = (str(tmp_path / x) for x in ("changes", "out", "cp"))
    rows.sort(key=lambda r: r[4])
    written(spark, path, rows[:40])
    replay_files(spark, path, out, cp, buckets=1)
    written(spark, path, [*rows[40:], (None, None, None, None, day(40))])
    found = replay_files(spark, path, out, cp, buckets=1)
    assert events(found) == events(replayed(spark.createDataFrame(rows, CHANGES), F.lit(dt.date(2026, 4, 9))))
