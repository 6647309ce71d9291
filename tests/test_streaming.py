import datetime as dt
import json

from pyspark.sql import functions as F

from paperloom.operators.reminders import KEY
from paperloom.plans.reports import write_report
from paperloom.sources.tables import empty_table, read_fixture, read_table
from paperloom.streaming.reminders import drain, pending_files, reminder_batches, reminder_cycle, start_reminders


def test_repeated_ticks_write_once(spark, tmp_path):
    today = dt.date(2026, 8, 2)
    docs = spark.createDataFrame([("1", today, "New", "s"), ("2", today + dt.timedelta(3), "New", "s"), ("3", today + dt.timedelta(2), "New", "s")], "id string, deadline date, status string, assigned_to_staff_id string")
    docs = docs.withColumn("updated_at", F.lit(None).cast("timestamp"))
    history = str(tmp_path / "history")
    empty_table(spark, "reminder_history").write.parquet(history)
    cycle = reminder_cycle(lambda: docs, lambda: read_table(spark, history, "reminder_history"), lambda _, new: new.write.mode("append").parquet(history))
    now = [dt.datetime(2026, 8, 2, 1)]
    run = reminder_batches(cycle, clock=lambda zone: now[0].replace(tzinfo=zone))
    ticks = str(tmp_path / "ticks")

    def tick(hour):
        spark.createDataFrame([(dt.datetime(2026, 8, 2, hour),)], "timestamp timestamp").write.mode("append").parquet(ticks)
        drain(spark.readStream.schema("timestamp timestamp").parquet(ticks), run, str(tmp_path / "checkpoint")).awaitTermination()

    tick(1)
    assert {(r.incoming_document_id, r.reminder_kind) for r in read_table(spark, history, "reminder_history").collect()} == {("1", "DueDate"), ("2", "BeforeDeadline")}
    tick(2)
    stored = read_table(spark, history, "reminder_history")
    assert stored.count() == 2 == stored.dropDuplicates(KEY).count()
    # A gap: the ticks of the days between come all at once, and only today counts.
    now[0] = dt.datetime(2026, 8, 6, 9)
    tick(3)
    for day in range(3, 7):
        spark.createDataFrame([(dt.datetime(2026, 8, day, 1),)], "timestamp timestamp").write.mode("append").parquet(ticks)
    drain(spark.readStream.schema("timestamp timestamp").parquet(ticks), run, str(tmp_path / "checkpoint")).awaitTermination()
    later = read_table(spark, history, "reminder_history").filter(F.col("reminder_date") != today)
    assert {(r.incoming_document_id, r.reminder_kind, r.reminder_date) for r in later.collect()} == {(i, "Overdue", dt.date(2026, 8, 6)) for i in "123"}


def test_runs_at_once_saves_both_and_retries(spark, tmp_path):
    docs = spark.createDataFrame([("1", dt.date(2020, 1, 1), "New", "s"), ("2", dt.date(2020, 1, 1), "Completed", "s"), ("3", dt.date(2020, 1, 1), "New", None)], "id string, deadline date, status string, assigned_to_staff_id string")
    docs = docs.withColumn("updated_at", F.lit(None).cast("timestamp"))
    tries, saved = [], {}

    def save(now, new):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("no disk")
        saved["docs"], saved["new"] = {r.id: r.status for r in now.collect()}, new.count()

    cycle = reminder_cycle(lambda: docs, lambda: empty_table(spark, "reminder_history"), save)
    query = start_reminders(spark, cycle, str(tmp_path / "cp"), minutes=60)
    query.stop()
    assert tries and not saved  # the run at the start failed, and the stream began all the same
    assert cycle(dt.date(2020, 1, 2)) and saved == {"docs": {"1": "Overdue", "2": "Completed", "3": "Overdue"}, "new": 1}


def test_pending_queue(spark, tmp_path):
    path = str(tmp_path / "attachments")
    schema = "id string, extraction_status string"
    spark.createDataFrame([("a", "Pending"), ("b", "Succeeded")], schema).write.parquet(path)
    seen = []
    drain(pending_files(spark, path, schema), lambda df, _: seen.extend(r.id for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["a"]


def test_fixture_and_report(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"version": "1", "cases": [{"id": "a", "query": "q"}, {"id": "b", "query": "r"}]}))
    cases = read_fixture(spark, str(tmp_path / "cases.json"), "cases")
    assert [r.id for r in cases.orderBy("id").collect()] == ["a", "b"]
    gates = spark.createDataFrame([("recall", True)], "gate string, passed boolean")
    write_report(spark.createDataFrame([(1.0,)], "recall double"), gates, cases, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/metrics")).first().gates[0].gate == "recall" and spark.read.json(str(tmp_path / "out/cases")).count() == 2
