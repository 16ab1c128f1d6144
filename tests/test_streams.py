"""Streaming jobs: restarts, replays, late and damaged events."""

import pytest
from pyspark.sql import functions as F

from staylens import schemas as S
from staylens.operators import metrics as M
from staylens.session import fresh_dir
from staylens.sources import streams, versions
from staylens.streaming import events as V
from staylens.streaming import jobs as J
from staylens.streaming import metrics as X
from staylens.streaming import sinks as K


def predictions(spark, *rows):
    """(id, booking, probability, time) as scored events."""
    df = spark.createDataFrame([(i, b, p, t) for i, b, p, t in rows], "prediction_id bigint, booking_id bigint, p double, t string")
    return df.select(
        "prediction_id", "booking_id", F.lit("m_v1").alias("model_version"), F.col("p").cast("decimal(6,4)").alias("cancel_probability"),
        (F.col("p") >= 0.5).cast("int").alias("predicted_label"), F.when(F.col("p") >= 0.6, "high").otherwise("low").alias("risk_level"),
        F.lit("storm").alias("source"), F.col("t").cast("timestamp").alias("predicted_at"))


def names(spark, *rows):
    return spark.createDataFrame(list(rows), "booking_id bigint, hotel_name string, country_name string, market_segment string")


def score(rows):
    return rows.withColumn("risk_level_name", F.concat("risk_level", F.lit("_risk")))


def test_event_parsing(spark):
    lines = ['{"booking_id": 5, "adr": "80.5", "generated_at": "2017-01-13 08:00:00", "new_field": [1]}',
             '{"booking_id": "6", "lead_time": 3.0, "business_time": "2017-01-13", "generated_at": "2017-01-14 08:00:00"}',
             '{"booking_id": 7, "adr": {"bad": 1}}', '{"adr": 1}', '{"booking_id": null}', '{"booking_id": 8', 'hello', '']
    parsed = V.parse_events(spark.createDataFrame([(line,) for line in lines], "value string"))
    good = {r.booking_id: r for r in V.accepted(parsed).collect()}
    assert set(good) == {5, 6, 7}
    assert (good[5].adr, good[5].business_time, good[5].lead_time) == (80.5, "2017-01-13 08:00:00", None)
    assert (good[6].lead_time, good[6].business_time) == (3, "2017-01-13")
    assert good[7].adr is None
    bad = {r.value: r.reason for r in V.rejected(parsed).collect()}
    assert set(bad) == set(lines[3:])
    assert bad['{"adr": 1}'] == bad['{"booking_id": null}'] == "booking_id is required"
    assert bad['{"booking_id": 8'] == bad["hello"] == "not readable"


def test_realtime_job_over_batches_and_a_replay(spark):
    known = names(spark, (1, "H", "PRT", "Direct"), (2, "H", "ESP", "Direct"), (3, "H", None, "Groups"))
    out = fresh_dir(spark, "job")
    write = J.realtime_outputs(out, known, score)
    first = predictions(spark, (1, 1, 0.9, "2017-01-13 08:00:00"), (2, 2, 0.2, "2017-01-13 08:01:00"), (3, 99, 0.7, "2017-01-13 08:02:00"))
    second = predictions(spark, (4, 1, 0.5, "2017-01-13 09:00:00"), (5, 3, 0.6, "2017-01-13 09:01:00"))

    def outcome():
        tables = J.realtime_tables(spark, out)
        return {name: sorted(map(str, df.collect())) for name, df in tables.items()}

    write(first, 0)
    write(second, 1)
    once = outcome()
    write(second, 1)
    assert outcome() == once, "a replayed batch changes nothing"
    tables = J.realtime_tables(spark, out)
    summary = tables["summary"].first()
    assert (summary.processed_count, summary.high_risk_count, summary.predicted_cancellations) == (4, 2, 3)
    assert summary.average_cancel_probability == 0.55
    assert [r.booking_id for r in spark.read.parquet(f"{out}/unresolved").collect()] == [99]
    risk = {(r.dimension, r.name): (r.value, r.booking_count) for r in tables["risk"].collect()}
    assert risk == {("country", "PRT"): (1.0, 2), ("country", "ESP"): (0.0, 1), ("country", "unknown"): (1.0, 1),
                    ("channel", "Direct"): (0.6667, 3), ("channel", "Groups"): (1.0, 1)}
    assert [r.prediction_id for r in tables["recent"].orderBy(F.desc("predicted_at")).collect()] == [5, 4, 2, 1]
    last = tables["metrics"].where(F.col("window_end") == F.lit("2017-01-13 09:01:00").cast("timestamp")).collect()
    assert len(last) == 13 + 5
    assert {r.metric_value for r in last if r.metric_name == "cancel_rate"} == {"0.7500"}
    assert {r.metric_value for r in last if r.metric_name == "Direct"} == {"0.6667"}


def test_metrics_stay_in_order_when_batches_do_not(spark):
    known = names(spark, (1, "H", "PRT", "Direct"))
    out = fresh_dir(spark, "job")
    write = J.realtime_outputs(out, known, score)
    write(predictions(spark, (1, 1, 0.9, "2017-01-13 09:00:00")), 0)
    write(predictions(spark, (2, 1, 0.1, "2017-01-13 08:00:00")), 1)
    latest = M.latest_rows(J.realtime_tables(spark, out)["metrics"], ["summary"]).collect()
    assert {r.metric_name: r.metric_value for r in latest}["processed_count"] == "2"
    assert len(latest) == 4


def test_recent_keeps_ten(spark):
    path = fresh_dir(spark, "recent")
    rows = predictions(spark, *((n, n, 0.1, f"2017-01-13 08:{n:02d}:00") for n in range(25)))
    rows = rows.withColumns({"hotel_name": F.lit("H"), "country_name": F.lit("P"), "risk_level_name": F.lit("low_risk")})
    write = J.keep_recent(path)
    write(rows.where("prediction_id < 8"), 0)
    write(rows.where("prediction_id >= 8 and prediction_id < 12"), 1)
    kept = versions.read_version(spark, path, J.RECENT_SCHEMA)
    assert sorted(r.prediction_id for r in kept.collect()) == list(range(2, 12))


def test_append_mode_emits_only_closed_windows(spark):
    log, out = fresh_dir(spark, "events"), fresh_dir(spark, "closed")
    days = [f"2017-01-{day:02d} 12:00:00" for day in range(1, 8)]
    predictions(spark, *((n, n, 0.5, t) for n, t in enumerate(days))).write.parquet(log)
    stream = streams.parquet_stream(spark, log, S.PREDICTION_SCHEMA).withWatermark("predicted_at", "1 day")
    trend = X.with_cancel_rate(X.trend_sums(stream, "day"))
    K.run_available(trend, K.append_batches(out), mode="append")
    labels = sorted(r.label for r in K.read_batches(spark, out, trend.schema).collect())
    assert labels == [f"2017-01-{day:02d}" for day in range(1, 6)]  # the watermark is the 6th at noon


def test_late_rows_count_in_their_period_after_a_restart(spark):
    log, out = fresh_dir(spark, "events"), fresh_dir(spark, "windows")
    checkpoint = None
    deliveries = [
        [(1, 1, 0.9, "2017-01-13 08:00:00"), (2, 2, 0.1, "2017-01-14 08:00:00")],
        [(3, 3, 0.1, "2017-01-13 20:00:00"), (4, 4, 0.9, "2017-01-01 00:00:00")],  # late; twelve days late
    ]
    for rows in deliveries:
        predictions(spark, *rows).write.mode("append").parquet(log)
        stream = streams.parquet_stream(spark, log, S.PREDICTION_SCHEMA)
        checkpoint = K.run_available(stream, K.append_trend(out, "day"), checkpoint=checkpoint)
    sums = K.read_trend(spark, out, X.trend_sums(stream, "day").schema)
    got = {r.label: (r.inflow, r.cancel_rate) for r in X.with_cancel_rate(sums).collect()}
    assert got == {"2017-01-01": (1, 1.0), "2017-01-13": (2, 0.5), "2017-01-14": (1, 0.0)}


def deliver(spark, run, *deliveries):
    """Each delivery, a table, goes to a log and through a stream with the state and checkpoint of the one before."""
    log, checkpoint = fresh_dir(spark, "log"), None
    for rows in deliveries:
        rows.write.mode("append").parquet(log)
        checkpoint = run(streams.parquet_stream(spark, log, rows.schema), checkpoint)


def test_redelivered_events_count_once_in_the_job(spark):
    known, out = names(spark, (1, "H", "PRT", "Direct")), fresh_dir(spark, "job")
    new = predictions(spark, (5, 1, 0.9, "2017-01-13 09:00:00"), (6, 99, 0.9, "2017-01-13 09:00:00"))
    deliver(
        spark,
        lambda events, checkpoint: J.run_events(events, out, known, score, checkpoint),
        new.union(new),
        new.union(predictions(spark, (1, 1, 0.1, "2016-12-31 09:00:00"))),
    )
    tables = J.realtime_tables(spark, out)
    assert tables["summary"].first().processed_count == tables["predictions"].count() == 2
    assert spark.read.parquet(f"{out}/unresolved").count() == 1
    days = {r.label: r.inflow for r in tables["trends"].where("granularity = 'day'").collect()}
    assert days == {"2016-12-31": 1, "2017-01-13": 1}


def test_events_without_a_key_are_told_apart_by_their_contents(spark):
    known, out = names(spark, (1, "H", "PRT", "Direct")), fresh_dir(spark, "job")
    bookings = known.withColumn("adr", F.lit(1.0))
    lines = [
        '{"booking_id": 1, "lead_time": 3}',
        '{"booking_id": 1, "lead_time": 4}',
        '{"booking_id": 1, "lead_time": 4, "generated_at": "2017-01-13 08:00:00"}',
        '{"booking_id": 1, "lead_time": 5}',
        '{"booking_id": 1, "lead_time": 5, "hotel": null}',
        '{"booking_id": 99, "lead_time": 3}',
        "no event",
    ]

    def scored(rows):
        values = predictions(spark, (1, 1, 0.9, "2017-01-13 09:00:00")).drop("booking_id")
        return score(rows.crossJoin(values))

    log, checkpoint = fresh_dir(spark, "log"), None
    for some in ([*lines[:3], lines[0]], lines, lines):
        spark.createDataFrame([(line,) for line in some], "value string").write.mode("append").text(log)
        checkpoint = J.run_lines(streams.file_lines(spark, log), out, bookings, scored, checkpoint)
    tables = J.realtime_tables(spark, out)
    assert tables["summary"].first().processed_count == tables["predictions"].count() == 4
    unresolved = spark.read.parquet(f"{out}/unresolved")
    assert unresolved.count() == 1 and V.DIGEST not in unresolved.columns
    rejects = K.read_batches(spark, f"{out}/rejected", S.struct("value string, reason string"))
    assert [(r.value, r.reason) for r in rejects.collect()] == [("no event", "not readable")] * 2


def test_null_prediction_ids_are_no_key(spark):
    first = predictions(spark, (None, 1, 0.9, "2017-01-13 08:00:00"), (None, 2, 0.9, "2017-01-13 08:00:00"), (7, 2, 0.9, "2017-01-13 08:00:00"))
    second = predictions(spark, (None, 2, 0.9, "2017-01-13 08:00:00"), (None, 2, 0.9, "2017-01-13 08:00:00.000001"))
    third = predictions(spark, (None, 3, 0.9, "2017-01-13 08:00:00"), (7, 5, 0.1, "2017-01-13 08:00:00"))
    once, known = fresh_dir(spark, "once"), names(spark, *((i, "H", "PRT", "Direct") for i in range(1, 6)))
    job = fresh_dir(spark, "job")

    def plain(events, checkpoint):
        return K.run_available(V.first_deliveries(events, ["prediction_id"]), K.append_batches(once), checkpoint=checkpoint)

    for run in (plain, lambda events, checkpoint: J.run_events(events, job, known, score, checkpoint)):
        deliver(spark, run, first.union(first), second, third)
    for stored in (K.read_batches(spark, once, S.PREDICTION_SCHEMA), J.realtime_tables(spark, job)["predictions"]):
        got = [(r.prediction_id, r.booking_id) for r in stored.collect()]
        assert sorted(got, key=str) == [(7, 2), (None, 1), (None, 2), (None, 2), (None, 3)]


def test_what_a_batch_reads_does_not_depend_on_the_batches_before(spark):
    """Scattered keys, half of them redelivered: the tenth batch looks up its own keys and no more."""
    log, out = fresh_dir(spark, "log"), fresh_dir(spark, "once")
    for n in range(10):
        new = [((31 * (100 * n + i)) % 7919, 1, 0.5, "2017-01-13 08:00:00") for i in range(100)]
        again = [((31 * (100 * max(n - 1, 0) + i)) % 7919, 1, 0.5, "2017-01-13 08:00:00") for i in range(100)]
        predictions(spark, *new, *again).coalesce(1).write.mode("append").parquet(log)
    stream = streams.parquet_stream(spark, log, S.PREDICTION_SCHEMA, max_files=1)
    query = (
        V.first_deliveries(stream, ["prediction_id"])
        .writeStream.foreachBatch(K.append_batches(out))
        .option("checkpointLocation", fresh_dir(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in batches] == [200] * 10
    states = [p["stateOperators"][0] for p in batches]
    assert states[-1]["numRowsTotal"] == 1_000
    reads = [state["customMetrics"]["rocksdbGetCount"] for state in states]
    assert reads[-1] <= max(reads[:2]) and reads[-1] <= 2 * 200, reads
    assert K.read_batches(spark, out, S.PREDICTION_SCHEMA).select("prediction_id").distinct().count() == 1_000


def test_a_fresh_checkpoint_over_old_outputs_is_refused(spark):
    known, out = names(spark, (1, "H", "PRT", "Direct")), fresh_dir(spark, "job")
    write = J.realtime_outputs(out, known, score)
    rows = predictions(spark, (5, 1, 0.9, "2017-01-13 09:00:00"))
    write(rows, 0)
    write(rows, 1)
    with pytest.raises(RuntimeError, match="checkpoint"):
        write(rows, 0)


def test_unfinished_batches_are_not_read(spark):
    out = fresh_dir(spark, "batches")
    rows = predictions(spark, (5, 1, 0.9, "2017-01-13 09:00:00"))
    K.append_batches(out)(rows, 0)
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/v=1")
    assert K.read_batches(spark, out, rows.schema).count() == 1


def test_two_hundred_batches_leave_few_folders(spark):
    out, fs = fresh_dir(spark, "batches"), versions._file_system
    path = spark._jvm.org.apache.hadoop.fs.Path
    rows = [spark.range(n, n + 1) for n in range(201)]
    write, most = K.append_batches(out), 0
    for n in range(201):
        write(rows[n], n)
        most = max(most, len(fs(spark, out).listStatus(path(out))))
    assert most <= 45, "two of ten single batches, ranges of ten and ranges of a hundred at most"
    stored = lambda: sorted(r.id for r in K.read_batches(spark, out, rows[0].schema).collect())
    assert stored() == list(range(201))
    write(rows[200], 200)  # the newest batch again: it compacts again too
    assert stored() == list(range(201))


def test_a_crash_during_compaction_loses_and_doubles_nothing(spark):
    out = fresh_dir(spark, "batches")
    write = K.append_batches(out, every=3)
    stored = lambda: sorted(r.id for r in K.read_batches(spark, out, spark.range(1).schema).collect())
    for n in range(4):
        write(spark.range(n, n + 1), n)
    assert versions.complete_pieces(spark, out) == {(0, 2), (0, 0), (1, 1), (2, 2), (3, 3)}, "replaced folders stay for a while"
    assert stored() == [0, 1, 2, 3]
    # Batch 6 stops before its range is finished, and comes again.
    for n in (4, 5, 6):
        K.append_batches(out, every=100)(spark.range(n, n + 1), n)
    spark.range(99).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/range=3-5")
    assert stored() == [0, 1, 2, 3, 4, 5, 6]
    write(spark.range(6, 7), 6)
    assert stored() == [0, 1, 2, 3, 4, 5, 6]
    assert versions.cover(versions.complete_pieces(spark, out)) == {(0, 2), (3, 5), (6, 6)}
    for n in (7, 8, 9):
        write(spark.range(n, n + 1), n)
    assert (0, 8) in versions.complete_pieces(spark, out) and stored() == list(range(10))


def test_a_batch_leaves_the_sums_of_other_periods_alone(spark):
    """Only the periods of a batch are written; compaction adds sums up."""
    out = fresh_dir(spark, "trend")
    write = K.append_trend(out, "month")
    schema = X.trend_sums(predictions(spark, (1, 1, 0.9, "2017-01-13 08:00:00")), "month").schema
    write(predictions(spark, (1, 1, 0.9, "2017-01-13 08:00:00")), 0)
    first = {f.getPath().toString(): f.getModificationTime() for f in _files(spark, f"{out}/v=0")}
    for n in range(1, 10):
        write(predictions(spark, (n + 1, 1, 0.1, "2017-02-13 08:00:00")), n)
        assert spark.read.parquet(f"{out}/v={n}").count() == 1
    assert {f.getPath().toString(): f.getModificationTime() for f in _files(spark, f"{out}/v=0")} == first
    write(predictions(spark, (11, 1, 0.9, "2017-01-31 08:00:00")), 10)
    assert spark.read.parquet(f"{out}/range=0-9").count() == 2, "a row per month"
    sums = {r.label: (r.inflow, r.predicted_cancellations) for r in K.read_trend(spark, out, schema).collect()}
    assert sums == {"2017-01-01": (2, 2), "2017-02-01": (9, 0)}


def _files(spark, folder):
    return versions._file_system(spark, folder).listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))


def test_weeks_start_on_monday(spark):
    rows = predictions(spark, (1, 1, 0.5, "2017-01-15 23:00:00"), (2, 2, 0.5, "2017-01-16 00:00:00"))
    assert sorted(r.label for r in X.trend_sums(rows, "week").collect()) == ["2017-01-09", "2017-01-16"]
    assert [r.label for r in X.trend_sums(rows, "month").collect()] == ["2017-01-01"]


def test_running_summary_is_the_same_in_batch_and_stream(spark):
    rows = predictions(spark, *((n, n, n / 50, f"2017-01-13 {n % 24:02d}:00:00") for n in range(50)))
    log, out = fresh_dir(spark, "events"), fresh_dir(spark, "summary")
    rows.repartition(5).write.parquet(log)
    totals = X.running_summary(streams.parquet_stream(spark, log, S.PREDICTION_SCHEMA, max_files=1))
    K.run_available(totals, K.overwrite_snapshot(out), mode="complete")
    assert versions.read_version(spark, out, totals.schema).collect() == X.running_summary(rows).collect()


def test_a_running_query_takes_files_that_come_later(spark):
    log, out = fresh_dir(spark, "late-log"), fresh_dir(spark, "late-out")
    spark.range(3).write.parquet(log)
    stream = streams.parquet_stream(spark, log, spark.range(1).schema)
    query = K.run_until_stopped(stream, K.append_batches(out), "1 second", fresh_dir(spark, "late-checkpoint"))
    try:
        query.processAllAvailable()
        spark.range(3, 8).write.mode("append").parquet(log)
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.id for r in K.read_batches(spark, out, spark.range(1).schema).collect()) == list(range(8))
