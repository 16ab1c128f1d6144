"""Registered queries: streaming jobs, each run until its input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens import schemas as S
from staylens.functions import risk
from staylens.operators import bookings as B
from staylens.operators import metrics as M
from staylens.operators import splits as L
from staylens.plans import tables as D
from staylens.plans.catalog import query
from staylens.plans.oracle_tables import even, part_text, wire
from staylens.session import fresh_dir
from staylens.sources import files, streams
from staylens.sources.versions import read_version
from staylens.streaming import events as V
from staylens.streaming import jobs as J
from staylens.streaming import metrics as X
from staylens.streaming import sinks as K

_TS = "'%Y-%m-%d %H:%M:%S'"


def _active(spark, sf):
    return B.active_bookings(D.bookings(spark, sf))


def _booking_events(spark, sf, active=None):
    """Events of the realtime bookings; half of them carry no business time. `active` are the bookings if they are at hand."""
    events = L.as_events(L.realtime_side(active or _active(spark, sf), D.START))
    created = F.concat("business_time", F.lit(" 08:00:00"))
    return events.withColumns(
        {"generated_at": created, "business_time": F.when(F.col("booking_id") % 2 == 0, F.col("business_time"))}
    )


_EVENTS = f"""(SELECT {wire(S.EVENT_COLUMNS)},
    case when booking_id%2=0 then strftime(event_date,'%Y-%m-%d') end AS business_time,
    strftime(event_date,'%Y-%m-%d') || ' 08:00:00' AS generated_at
    FROM active WHERE arrival_date >= DATE '{D.START}')"""


def _event_log(spark, sf):
    path = fresh_dir(spark, "event-log")
    files.append_event_log(_booking_events(spark, sf), path)
    return path


@query("sink_events_jsonl", f"SELECT * FROM {_EVENTS}")
def sink_events_jsonl(spark, sf):
    return spark.read.schema(S.EVENT_SCHEMA).json(_event_log(spark, sf))


@query("stream_file_source", f"SELECT booking_id, country_code, lead_time FROM {_EVENTS}")
def stream_file_source(spark, sf):
    """The log as a growing folder: a second delivery is added after the first run, with the same checkpoint."""
    log, out = fresh_dir(spark, "event-log"), fresh_dir(spark, "copied")
    events = _booking_events(spark, sf)
    checkpoint = None
    for even_hotels in (True, False):
        delivery = events.where((F.col("hotel") == "City Hotel") == F.lit(even_hotels))
        files.append_event_log(delivery, log)
        lines = V.accepted(V.parse_events(streams.file_lines(spark, log))).select("booking_id", "country_code", "lead_time")
        checkpoint = K.run_available(lines, K.append_batches(out), checkpoint=checkpoint)
    return K.read_batches(spark, out, lines.schema)


def _damaged_log(spark, sf, active=None):
    """A log in which some lines break off and some name no booking."""
    path = fresh_dir(spark, "event-log")
    events = _booking_events(spark, sf, active)
    whole = F.to_json(F.struct(*events.columns))
    nameless = F.to_json(F.struct(*(c for c in events.columns if c != "booking_id")))
    line = (
        F.when(F.col("booking_id") % 37 == 0, F.concat(F.lit('{"booking_id": '), F.col("booking_id").cast("string")))
        .when(F.col("booking_id") % 31 == 0, nameless)
        .otherwise(whole)
    )
    events.select(line.alias("value")).write.text(path)
    return path


@query(
    "stream_parse_events",
    f"""SELECT * REPLACE (coalesce(business_time, generated_at) AS business_time) FROM {_EVENTS}
        WHERE booking_id%37<>0 AND booking_id%31<>0""",
)
def stream_parse_events(spark, sf):
    out = fresh_dir(spark, "parsed")
    parsed = V.accepted(V.parse_events(streams.file_lines(spark, _damaged_log(spark, sf))))
    K.run_available(parsed, K.append_batches(out))
    return K.read_batches(spark, out, S.EVENT_SCHEMA)


@query(
    "stream_reject_bad_events",
    f"""SELECT case when booking_id%37=0 then 'not readable' else 'booking_id is required' end AS reason, count(*) AS line_count
        FROM {_EVENTS} WHERE booking_id%37=0 OR booking_id%31=0 GROUP BY 1""",
)
def stream_reject_bad_events(spark, sf):
    out = fresh_dir(spark, "rejected")
    bad = V.rejected(V.parse_events(streams.file_lines(spark, _damaged_log(spark, sf))))
    K.run_available(bad, K.append_batches(out))
    return K.read_batches(spark, out, bad.schema).groupBy("reason").agg(F.count("*").alias("line_count"))


# --- the stream of scored events -------------------------------------------------------------


def _scored(spark, sf):
    """The events table as a stream, with the prediction columns, of the stream source only."""
    events = streams.parquet_stream(spark, f"{sf}/events*.parquet", D.EVENTS_SCHEMA)  # a pattern takes a file or a folder
    return D.scored_events(events).where(F.col("source") == S.STREAM_SOURCE)


def _named(spark, sf):
    """The scored stream as events that carry the names of their bookings; unknown bookings keep their events."""
    log = fresh_dir(spark, "named-events")
    names = D.bookings(spark, sf).select("booking_id", "hotel_name", "country_name", "market_segment")
    stored = D.predictions(spark, sf).where(F.col("source") == S.STREAM_SOURCE).join(names, "booking_id", "left")
    stored.write.parquet(log)
    return streams.parquet_stream(spark, log, stored.schema)


_PRED = f"""prediction_id, booking_id, model_version, cancel_probability::double AS cancel_probability, predicted_label, risk_level,
    source, strftime(predicted_at,{_TS}) AS predicted_at"""


@query("stream_predictions_sink", f"SELECT {_PRED} FROM predictions WHERE source='storm'")
def stream_predictions_sink(spark, sf):
    out = fresh_dir(spark, "predictions")
    K.run_available(_scored(spark, sf), K.append_batches(out))
    return K.read_batches(spark, out, S.PREDICTION_SCHEMA)


def _deliver(spark, sf, run):
    """Run a stream over three deliveries, with a restart before each: the newest half of the events, then the
    older half with every third of the newest again, then everything again. `run` takes the stream and the checkpoint."""
    log = fresh_dir(spark, "delivered")
    rows = D.predictions(spark, sf).where(F.col("source") == S.STREAM_SOURCE)
    middle = rows.agg(F.percentile_approx("predicted_at", 0.5)).scalar()
    new = rows.where(F.col("predicted_at") > middle)
    old = rows.where(F.col("predicted_at") <= middle)
    checkpoint = None
    for delivery in (new, old.unionByName(new.where("prediction_id % 3 = 0")), rows):
        delivery.write.mode("append").parquet(log)
        stream = streams.parquet_stream(spark, log, S.PREDICTION_SCHEMA)
        checkpoint = run(V.first_deliveries(stream, J.event_keys(stream)), checkpoint)


@query(
    "stream_dedup",
    f"SELECT {_PRED} FROM predictions WHERE source='storm'",
)
def stream_dedup(spark, sf):
    """Events come late and again, over restarts; none is lost and each counts once."""
    out = fresh_dir(spark, "deduplicated")
    _deliver(spark, sf, lambda once, checkpoint: K.run_available(once, K.append_batches(out), checkpoint=checkpoint))
    return K.read_batches(spark, out, S.PREDICTION_SCHEMA)


@query(
    "stream_enrich_bookings",
    f"""SELECT e.booking_id, e.generated_at, b.customer_type_name, b.deposit_type, b.adr::double AS adr FROM {_EVENTS} e
        JOIN active b ON b.booking_id = e.booking_id WHERE b.country_code <> 'PRT'""",
)
def stream_enrich_bookings(spark, sf):
    """Events resolve to full bookings; bookings of one country are unknown here and fall out."""
    out = fresh_dir(spark, "resolved")
    known = fresh_dir(spark, "bookings")
    files.write_lookup_table(_active(spark, sf).where(F.col("country_code") != "PRT"), known)
    bookings = files.read_lookup_table(spark, known)
    columns = ["booking_id", "generated_at", "customer_type_name", "deposit_type", "adr"]

    def write(batch, batch_id):
        with J.lookup(batch.persist(), bookings) as found:
            K.append_batches(out)(J.resolved(found).select(*columns), batch_id)
        batch.unpersist()

    K.run_available(V.accepted(V.parse_events(streams.file_lines(spark, _event_log(spark, sf)))), write)
    return K.read_batches(spark, out, bookings.select(*(c for c in columns if c != "generated_at")).schema.add("generated_at", "string")).select(*columns)


@query(
    "stream_unresolved_events",
    f"SELECT booking_id, country_code FROM {_EVENTS} WHERE country_code = 'PRT'",
)
def stream_unresolved_events(spark, sf):
    out = fresh_dir(spark, "unresolved")
    ids = _active(spark, sf).where(F.col("country_code") != "PRT").select("booking_id")

    def write(batch, batch_id):
        with J.lookup(batch.persist(), ids) as found:
            K.append_batches(out)(J.unresolved(found, "country_code"), batch_id)
        batch.unpersist()

    K.run_available(V.accepted(V.parse_events(streams.file_lines(spark, _event_log(spark, sf)))), write)
    return K.read_batches(spark, out, S.struct("booking_id bigint, country_code string"))


def _up(expression: str) -> str:
    return f"floor(({expression})::double*10000.0::double+0.5::double)/10000.0::double"


_SUMMARY = f"""SELECT count(*) AS processed_count, count(*) FILTER (risk_level='high') AS high_risk_count,
    cast(sum(predicted_label) as bigint) AS predicted_cancellations,
    {_up('sum(cancel_probability)::double/count(*)')} AS average_cancel_probability FROM predictions WHERE source='storm'"""


@query("stream_running_summary", _SUMMARY)
def stream_running_summary(spark, sf):
    out = fresh_dir(spark, "summary")
    totals = X.running_summary(_scored(spark, sf))
    K.run_available(totals, K.overwrite_snapshot(out), mode="complete")
    return read_version(spark, out, totals.schema)


@query("stream_snapshot_sink", f"SELECT * FROM ({_SUMMARY})")
def stream_snapshot_sink(spark, sf):
    """The summary snapshot after many small micro-batches: the last one wins."""
    log, out = fresh_dir(spark, "delivered"), fresh_dir(spark, "summary")
    rows = D.predictions(spark, sf).where(F.col("source") == S.STREAM_SOURCE)
    rows.repartitionByRange(6, "predicted_at").write.parquet(log)
    totals = X.running_summary(streams.parquet_stream(spark, log, S.PREDICTION_SCHEMA, max_files=2))
    K.run_available(totals, K.overwrite_snapshot(out), mode="complete")
    return read_version(spark, out, totals.schema)


def _trend(granularity):
    def build(spark, sf):
        out = fresh_dir(spark, f"trend-{granularity}")
        _deliver(spark, sf, lambda once, checkpoint: K.run_available(once, K.append_trend(out, granularity), checkpoint=checkpoint))
        schema = X.trend_sums(D.predictions(spark, sf), granularity).schema
        return X.with_cancel_rate(K.read_trend(spark, out, schema))

    return build


for _granularity in ("day", "week", "month"):
    query(
        f"stream_trend_{_granularity}",
        f"""SELECT strftime(date_trunc('{_granularity}', predicted_at),'%Y-%m-%d') AS label, count(*) AS inflow,
            cast(sum(predicted_label) as bigint) AS predicted_cancellations, {_up('sum(predicted_label)::double/count(*)')} AS cancel_rate
            FROM predictions WHERE source='storm' GROUP BY 1""",
    )(_trend(_granularity))


def _risk(column):
    def build(spark, sf):
        out = fresh_dir(spark, "risk")
        rates = X.running_by(_named(spark, sf), column)
        K.run_available(rates, K.overwrite_snapshot(out), mode="complete")
        return read_version(spark, out, rates.schema)

    return build


for _key, _column in (("country", "country_name"), ("channel", "market_segment")):
    query(
        f"stream_{_key}_risk",
        f"""SELECT coalesce({_column},'unknown') AS name, {_up('sum(predicted_label)::double/count(*)')} AS value, count(*) AS booking_count,
            cast(sum(predicted_label) as bigint) AS predicted_cancellations, {even('sum(predicted_label)::double/count(*)')} AS rate
            FROM predictions p LEFT JOIN bookings b ON b.booking_id = p.booking_id WHERE source='storm' GROUP BY 1""",
    )(_risk(_column))


_RECENT = f"""SELECT prediction_id, p.booking_id, hotel_name, country_name, cancel_probability::double AS cancel_probability,
    risk_level || '_risk' AS risk_level_name, strftime(predicted_at,{_TS}) AS predicted_at
    FROM predictions p {{join}} bookings b ON b.booking_id = p.booking_id WHERE source='storm'
    ORDER BY p.predicted_at DESC, prediction_id DESC LIMIT 10"""


@query("stream_recent", _RECENT.format(join="LEFT JOIN"))
def stream_recent(spark, sf):
    out = fresh_dir(spark, "recent")
    rows = _named(spark, sf).withColumn("risk_level_name", risk.risk_name(F.col("risk_level")))
    K.run_available(rows.select(*J.RECENT_SCHEMA.names), J.keep_recent(out))
    return read_version(spark, out, J.RECENT_SCHEMA)


# --- the whole realtime job ------------------------------------------------------------------


def _realtime_job(spark, sf, deliveries=1):
    """Run every output of the job over the scored events, in several micro-batches."""
    log, out = fresh_dir(spark, "delivered"), fresh_dir(spark, "realtime")
    known = fresh_dir(spark, "bookings")
    files.write_lookup_table(D.bookings(spark, sf), known)
    rows = D.predictions(spark, sf).where(F.col("source") == S.STREAM_SOURCE)
    for _ in range(deliveries):
        rows.repartitionByRange(4, "predicted_at").write.mode("append").parquet(log)
    stored = files.read_lookup_table(spark, known).select("booking_id", "hotel_name", "country_name", "market_segment")
    score = lambda batch: batch.withColumn("risk_level_name", risk.risk_name(F.col("risk_level")))
    stream = streams.parquet_stream(spark, log, S.PREDICTION_SCHEMA, max_files=2)
    J.run_events(stream, out, stored, score)
    return J.realtime_tables(spark, out)


_RESOLVED = """, resolved AS (SELECT p.*, country_name, market_segment FROM predictions p
    JOIN bookings b ON b.booking_id = p.booking_id WHERE source='storm')
, keyed AS (SELECT 'country' AS dimension, country_name AS name, * FROM resolved
    UNION ALL SELECT 'channel', market_segment, * FROM resolved)"""


@query(
    "stream_metric_rows",
    f"""{_RESOLVED}, totals AS (SELECT count(*) AS n, count(*) FILTER (risk_level='high') AS h, sum(predicted_label) AS c,
        cast(sum(cancel_probability)*10000 as bigint) AS p4 FROM resolved)
        SELECT 'summary' AS metric_type, 'processed_count' AS metric_name, cast(n as varchar) AS metric_value FROM totals
        UNION ALL SELECT 'summary', 'high_risk_count', cast(h as varchar) FROM totals
        UNION ALL SELECT 'summary', 'average_cancel_probability', {part_text('p4', 'n*10000')} FROM totals
        UNION ALL SELECT 'summary', 'predicted_cancellations', cast(c as varchar) FROM totals
        UNION ALL SELECT t, 'inflow', cast(n as varchar) FROM totals, (VALUES ('trend_day'),('trend_week'),('trend_month')) v(t)
        UNION ALL SELECT t, 'predicted_cancellations', cast(c as varchar) FROM totals, (VALUES ('trend_day'),('trend_week'),('trend_month')) v(t)
        UNION ALL SELECT t, 'cancel_rate', {part_text('c', 'n')} FROM totals, (VALUES ('trend_day'),('trend_week'),('trend_month')) v(t)
        UNION ALL SELECT dimension || '_risk', name, {part_text('sum(predicted_label)', 'count(*)')} FROM keyed GROUP BY dimension, name""",
)
def stream_metric_rows(spark, sf):
    """The metric rows of the last micro-batch of the whole job."""
    metrics = _realtime_job(spark, sf)["metrics"]
    return M.latest_rows(metrics).select("metric_type", "metric_name", "metric_value")


@query(
    "stream_risk_snapshot",
    f"""{_RESOLVED}, rates AS (SELECT dimension, name, count(*) AS booking_count, cast(sum(predicted_label) as bigint) AS predicted_cancellations,
        sum(predicted_label)::double/count(*) AS rate FROM keyed GROUP BY 1, 2)
        SELECT dimension, name, {even('rate')} AS value, booking_count, predicted_cancellations FROM rates
        QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY rate DESC, booking_count DESC, name) <= 5""",
)
def stream_risk_snapshot(spark, sf):
    return _realtime_job(spark, sf)["risk"]


@query(
    "stream_output_checks",
    f"""{_RESOLVED}, sizes AS (SELECT count(*) AS n FROM resolved)
        SELECT n AS prediction_results, n AS processed_count, 13 + (SELECT count(*) FROM (SELECT DISTINCT dimension, name FROM keyed)) AS realtime_metrics,
          true AS tables_ok, true AS snapshots_ok FROM sizes""",
)
def stream_output_checks(spark, sf):
    tables = _realtime_job(spark, sf)
    return M.output_checks(tables["predictions"], M.latest_rows(tables["metrics"]), tables["summary"])


@query("stream_redelivered_summary", _RESOLVED + "SELECT * FROM (" + _SUMMARY.replace("FROM predictions WHERE source='storm'", "FROM resolved") + ")")
def stream_redelivered_summary(spark, sf):
    """The totals of the whole job when every event is delivered twice."""
    return _realtime_job(spark, sf, deliveries=2)["summary"]


@query(
    "stream_job_trends",
    _RESOLVED
    + " UNION ALL ".join(
        f"""SELECT '{g}' AS granularity, strftime(date_trunc('{g}', predicted_at),'%Y-%m-%d') AS label, count(*) AS inflow,
            cast(sum(predicted_label) as bigint) AS predicted_cancellations, {_up('sum(predicted_label)::double/count(*)')} AS cancel_rate
            FROM resolved GROUP BY 2"""
        for g in ("day", "week", "month")
    ),
)
def stream_job_trends(spark, sf):
    """Day, week and month trends as the job stores them."""
    return _realtime_job(spark, sf)["trends"]
