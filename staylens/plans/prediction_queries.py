"""Registered queries: predictions, stored metrics, serving, chart series."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens import schemas as S
from staylens.functions import risk
from staylens.functions.numbers import ratio
from staylens.operators import bookings as B
from staylens.operators import metrics as M
from staylens.operators import overview as O
from staylens.operators import predictions as P
from staylens.operators import series as R
from staylens.operators import splits as L
from staylens.plans import tables as D
from staylens.plans.catalog import query
from staylens.plans.oracle_tables import even

_TS = "'%Y-%m-%d %H:%M:%S'"


def _active(spark, sf):
    return B.active_bookings(D.bookings(spark, sf))


# --- scoring expressions ---------------------------------------------------------------------


@query(
    "risk_band",
    """SELECT prediction_id, cancel_probability::double AS cancel_probability, risk_level, risk_level || '_risk' AS risk_level_name
       FROM predictions""",
)
def risk_band(spark, sf):
    band = risk.risk_band(F.col("cancel_probability"))
    return D.predictions(spark, sf).select(
        "prediction_id", "cancel_probability", band.alias("risk_level"), risk.risk_name(band).alias("risk_level_name")
    )


@query(
    "risk_band_custom",
    """SELECT prediction_id, case when cancel_probability>0.7 then 'high' when cancel_probability>0.35 then 'medium'
       else 'low' end AS pill FROM predictions""",
)
def risk_band_custom(spark, sf):
    pill = risk.risk_band(F.col("cancel_probability"), high=0.7, medium=0.35, inclusive=False)
    return D.predictions(spark, sf).select("prediction_id", pill.alias("pill"))


@query(
    "predicted_label",
    """SELECT prediction_id, case when cancel_probability>=0.5 then 1 else 0 end AS predicted_label,
       case when cancel_probability>=0.5 then 'may_cancel' else 'likely_keep' end AS predicted_label_name FROM predictions""",
)
def predicted_label(spark, sf):
    p = F.col("cancel_probability")
    return D.predictions(spark, sf).select(
        "prediction_id", risk.predicted_label(p).alias("predicted_label"), risk.predicted_label_name(p).alias("predicted_label_name")
    )


@query(
    "reason_tags",
    """SELECT booking_id, case when tags='' then 'model_probability' else tags end AS tags FROM (
         SELECT booking_id, concat_ws(',', case when lead_time>=90 then 'lead_time_high' end,
           case when previous_cancellations>0 then 'previous_cancellations' end,
           case when total_of_special_requests=0 then 'no_special_requests' end,
           case when deposit_type='Non Refund' then 'non_refund_deposit' end) AS tags FROM active)""",
)
def reason_tags(spark, sf):
    return _active(spark, sf).select("booking_id", risk.reason_tags().alias("tags"))


# --- predictions -----------------------------------------------------------------------------

_JOINED = f"""SELECT prediction_id, p.booking_id, hotel_name, country_name, cancel_probability::double AS cancel_probability,
    predicted_label, risk_level, strftime(predicted_at,{_TS}) AS business_time, risk_level || '_risk' AS risk_level_name
    FROM predictions p LEFT JOIN bookings b ON b.booking_id = p.booking_id WHERE source='storm'"""


@query("predictions_with_booking", _JOINED)
def predictions_with_booking(spark, sf):
    return P.with_booking(D.predictions(spark, sf), D.bookings(spark, sf))


@query("recent_predictions", f"SELECT * FROM ({_JOINED}) ORDER BY business_time DESC, prediction_id DESC LIMIT 10")
def recent_predictions(spark, sf):
    return P.recent(D.predictions(spark, sf), D.bookings(spark, sf), 10)


_BATCHES = f"""SELECT 'storm-' || strftime(predicted_at,'%Y-%m-%d') AS batch_id, strftime(predicted_at,'%Y-%m-%d') AS business_date,
    strftime(min(predicted_at),'%H:%M:%S') || '-' || strftime(max(predicted_at),'%H:%M:%S') AS time_window,
    count(*) AS total_count, count(*) FILTER (predicted_label=1) AS predicted_cancel_count,
    count(*) FILTER (risk_level='high') AS high_risk_count,
    {even('sum(cancel_probability)::double/count(*)')} AS avg_cancel_probability, source,
    strftime(max(predicted_at),{_TS}) AS created_at
    FROM predictions WHERE source='storm' GROUP BY strftime(predicted_at,'%Y-%m-%d'), source"""


@query("prediction_batches", _BATCHES)
def prediction_batches(spark, sf):
    return P.daily_batches(D.predictions(spark, sf))


@query("prediction_batches_page", f"{_BATCHES} ORDER BY created_at DESC LIMIT 7 OFFSET 7")
def prediction_batches_page(spark, sf):
    return P.batch_page(D.predictions(spark, sf), page=2, size=7)


@query("prediction_batch_total", f"SELECT count(*) AS total FROM ({_BATCHES})")
def prediction_batch_total(spark, sf):
    return P.batch_total(D.predictions(spark, sf))


_LATEST_SUMMARY = f"""SELECT max(case when metric_name='processed_count' then metric_value::double end) AS processed_count,
    max(case when metric_name='high_risk_count' then metric_value::double end) AS high_risk_count,
    max(case when metric_name='average_cancel_probability' then metric_value::double end) AS average_cancel_probability,
    max(case when metric_name='predicted_cancellations' then metric_value::double end) AS predicted_cancellations,
    strftime(max(updated_at),{_TS}) AS updated_at
    FROM metrics WHERE metric_type='summary' AND window_end=(SELECT max(window_end) FROM metrics WHERE metric_type='summary')"""


@query(
    "batch_from_metrics",
    f"""SELECT 'storm-metrics-latest' AS batch_id, substr(updated_at,1,10) AS business_date, 'latest' AS time_window,
        processed_count::bigint AS total_count, predicted_cancellations::bigint AS predicted_cancel_count,
        high_risk_count::bigint AS high_risk_count, {even('average_cancel_probability')} AS avg_cancel_probability,
        'storm_metrics' AS source, updated_at AS created_at FROM ({_LATEST_SUMMARY}) WHERE processed_count > 0""",
)
def batch_from_metrics(spark, sf):
    """No stream predictions are stored, so the batch comes from the latest summary."""
    none = D.predictions(spark, sf).where(F.col("source") != S.STREAM_SOURCE)
    return P.batches_or_summary(none, M.latest_summary(D.stored_metrics(spark, sf)))


@query("batches_before_metrics", _BATCHES)
def batches_before_metrics(spark, sf):
    """Stored predictions exist, so the summary adds nothing."""
    return P.batches_or_summary(D.predictions(spark, sf), M.latest_summary(D.stored_metrics(spark, sf)))


@query(
    "orphan_predictions",
    "SELECT prediction_id, booking_id FROM predictions WHERE booking_id NOT IN (SELECT booking_id FROM bookings)",
)
def orphan_predictions(spark, sf):
    return P.orphans(D.predictions(spark, sf), D.bookings(spark, sf))


# --- stored metrics --------------------------------------------------------------------------


@query(
    "latest_metric_rows",
    f"""SELECT metric_type, metric_name, metric_value, strftime(window_start,{_TS}) AS window_start,
        strftime(window_end,{_TS}) AS window_end, strftime(updated_at,{_TS}) AS updated_at
        FROM metrics m WHERE window_end = (SELECT max(window_end) FROM metrics x WHERE x.metric_type = m.metric_type)""",
)
def latest_metric_rows(spark, sf):
    return M.latest_rows(D.stored_metrics(spark, sf))


def _pivot(names):
    return ", ".join(f"max(case when metric_name='{n}' then metric_value::double end) AS {n}" for n in names)


@query(
    "metrics_wide",
    f"""SELECT strftime(window_start,{_TS}) AS window_start, strftime(window_end,{_TS}) AS window_end, {_pivot(S.SUMMARY_METRICS)},
        strftime(max(updated_at),{_TS}) AS updated_at FROM metrics WHERE metric_type='summary' GROUP BY 1, 2""",
)
def metrics_wide(spark, sf):
    return M.wide(D.stored_metrics(spark, sf).where(F.col("metric_type") == "summary"))


@query(
    "metrics_points",
    f"""SELECT strftime(window_start,{_TS}) AS label, {_pivot(S.TREND_METRICS)} FROM metrics WHERE metric_type='trend_day' GROUP BY 1""",
)
def metrics_points(spark, sf):
    return M.points(D.stored_metrics(spark, sf).where(F.col("metric_type") == "trend_day"))


def _day_points(spark, sf):
    """Daily trend points and totals of the stream predictions."""
    return (
        D.predictions(spark, sf)
        .where(F.col("source") == S.STREAM_SOURCE)
        .groupBy(F.date_format("predicted_at", "yyyy-MM-dd").alias("label"))
        .agg(F.count("*").alias("inflow"), F.sum("predicted_label").alias("predicted_cancellations"))
        .withColumn("cancel_rate", ratio(F.col("predicted_cancellations"), F.col("inflow")))
    )


_POINT = """strftime(predicted_at,'%Y-%m-%d') AS label, count(*) AS inflow, cast(sum(predicted_label) as bigint) AS predicted_cancellations,
    {rate} AS cancel_rate FROM predictions WHERE source='storm' GROUP BY 1""".format(
    rate=even("sum(predicted_label)::double/count(*)")
)


def _day_snapshots(spark, sf):
    """One snapshot record per day, with its point nested under `day`; `points` holds none."""
    point = F.struct("label", "inflow", "predicted_cancellations", "cancel_rate")
    return _day_points(spark, sf).select(
        F.array(point).alias("day"), F.lit(None).cast(
            "array<struct<label:string,inflow:bigint,predicted_cancellations:bigint,cancel_rate:double>>").alias("points")
    )


@query("snapshot_rows", f"SELECT {_POINT}")
def snapshot_rows(spark, sf):
    return M.snapshot_rows(_day_snapshots(spark, sf), "fortnight")


# --- serving ---------------------------------------------------------------------------------

_TOTALS = f"""SELECT count(*) AS processed_count, count(*) FILTER (risk_level='high') AS high_risk_count,
    {even('sum(cancel_probability)::double/count(*)')} AS average_cancel_probability, strftime(max(predicted_at),{_TS}) AS updated_at
    FROM predictions WHERE source='storm'"""


def _summary_snapshot(spark, sf):
    rows = D.predictions(spark, sf).where(F.col("source") == S.STREAM_SOURCE)
    return rows.agg(
        F.count("*").alias("processed_count"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_count"),
        ratio(F.sum("cancel_probability"), F.count("*")).alias("average_cancel_probability"),
        F.date_format(F.max("predicted_at"), "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
    )


@query("serve_summary", f"SELECT *, 'running' AS status, 'redis' AS source FROM ({_TOTALS})")
def serve_summary(spark, sf):
    return M.serve_summary(_summary_snapshot(spark, sf), D.stored_metrics(spark, sf))


_STORED = f"""SELECT processed_count::bigint AS processed_count, high_risk_count::bigint AS high_risk_count,
    {even('average_cancel_probability')} AS average_cancel_probability, updated_at, 'mysql_fallback' AS status, 'mysql' AS source
    FROM ({_LATEST_SUMMARY})"""


def _missing(df):
    return df.where(F.lit(False))


@query("serve_summary_stored", _STORED)
def serve_summary_stored(spark, sf):
    """No snapshot is fresh, so the stored metrics serve."""
    return M.serve_summary(_missing(_summary_snapshot(spark, sf)), D.stored_metrics(spark, sf))


@query(
    "serve_trend", f"SELECT *, 'day' AS granularity, 'running' AS status, 'redis' AS source FROM (SELECT {_POINT})"
)
def serve_trend(spark, sf):
    return M.serve_trend(_day_snapshots(spark, sf), D.stored_metrics(spark, sf), "day")


@query(
    "serve_trend_stored",
    f"""SELECT strftime(window_start,{_TS}) AS label, max(case when metric_name='inflow' then metric_value::double end)::bigint AS inflow,
        max(case when metric_name='predicted_cancellations' then metric_value::double end)::bigint AS predicted_cancellations,
        max(case when metric_name='cancel_rate' then metric_value::double end) AS cancel_rate,
        'day' AS granularity, 'running' AS status, 'mysql' AS source FROM metrics
        WHERE metric_type='trend_day' AND window_end=(SELECT max(window_end) FROM metrics WHERE metric_type='trend_day') GROUP BY 1""",
)
def serve_trend_stored(spark, sf):
    return M.serve_trend(_missing(_day_snapshots(spark, sf)), D.stored_metrics(spark, sf), "day")


def _country_counts(spark, sf):
    rows = D.predictions(spark, sf).where(F.col("source") == S.STREAM_SOURCE)
    names = D.bookings(spark, sf).select("booking_id", "country_name", "market_segment")
    keyed = rows.join(names, "booking_id", "left").select(
        "predicted_label",
        F.inline(
            F.array(
                F.struct(F.lit("country").alias("dimension"), F.coalesce("country_name", F.lit("unknown")).alias("name")),
                F.struct(F.lit("channel").alias("dimension"), F.coalesce("market_segment", F.lit("unknown")).alias("name")),
            )
        ),
    )
    return (
        keyed.groupBy("dimension", "name")
        .agg(F.count("*").alias("booking_count"), F.sum("predicted_label").alias("predicted_cancellations"))
        .withColumn("rate", ratio(F.col("predicted_cancellations"), F.col("booking_count")))
    )


_RISK_KEYS = """risk_keys AS (
  SELECT 'country' AS dimension, coalesce(country_name,'unknown') AS name, predicted_label FROM predictions p
    LEFT JOIN bookings b ON b.booking_id = p.booking_id WHERE source='storm'
  UNION ALL SELECT 'channel', coalesce(market_segment,'unknown'), predicted_label FROM predictions p
    LEFT JOIN bookings b ON b.booking_id = p.booking_id WHERE source='storm'),
risk_rates AS (SELECT dimension, name, count(*) AS booking_count, cast(sum(predicted_label) as bigint) AS predicted_cancellations,
    sum(predicted_label)::double/count(*) AS rate FROM risk_keys GROUP BY 1, 2),
risk_top AS (SELECT * FROM risk_rates QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY rate DESC, booking_count DESC, name) <= 5)"""
_RISK_VALUE = f"name, {even('rate')} AS value, booking_count, predicted_cancellations"


@query("top_risk", f", {_RISK_KEYS} SELECT dimension, {_RISK_VALUE} FROM risk_top")
def top_risk(spark, sf):
    return M.top_risk(_country_counts(spark, sf))


@query(
    "serve_risk", f", {_RISK_KEYS} SELECT {_RISK_VALUE}, 'redis' AS source, 'running' AS status FROM risk_top WHERE dimension='country'"
)
def serve_risk(spark, sf):
    snapshot = M.top_risk(_country_counts(spark, sf).where(F.col("dimension") == "country"))
    return M.serve_risk(snapshot, D.stored_metrics(spark, sf), "country_risk")


@query(
    "serve_risk_stored",
    """SELECT metric_name AS name, metric_value::double AS value, null::bigint AS booking_count, null::bigint AS predicted_cancellations,
       'mysql' AS source, 'running' AS status FROM metrics WHERE metric_type='country_risk'
       AND window_end=(SELECT max(window_end) FROM metrics WHERE metric_type='country_risk')""",
)
def serve_risk_stored(spark, sf):
    snapshot = M.top_risk(_country_counts(spark, sf))
    return M.serve_risk(_missing(snapshot), D.stored_metrics(spark, sf), "country_risk")


@query(
    "dashboard_totals",
    f"""SELECT o AS offline_base_rows, processed_count AS realtime_processed_count, o + processed_count AS total_bookings,
        high_risk_count, average_cancel_probability, updated_at, 'running' AS status
        FROM ({_TOTALS}), (SELECT count(*) AS o FROM active WHERE arrival_date <= DATE '{D.CUTOFF}')""",
)
def dashboard_totals(spark, sf):
    offline = L.split_counts(_active(spark, sf), D.CUTOFF, D.START)
    return M.dashboard_totals(offline, M.serve_summary(_summary_snapshot(spark, sf), D.stored_metrics(spark, sf)))


@query(
    "dashboard_totals_default",
    f"""SELECT 80008::bigint AS offline_base_rows, processed_count AS realtime_processed_count, 80008 + processed_count AS total_bookings,
        high_risk_count, average_cancel_probability, updated_at, status FROM ({_STORED})""",
)
def dashboard_totals_default(spark, sf):
    """No offline rows are known, so the fixed base counts; stored metrics stand in for the snapshot."""
    offline = L.split_counts(_active(spark, sf), "1900-01-01", D.START)
    snapshot = _missing(_summary_snapshot(spark, sf))
    return M.dashboard_totals(offline, M.serve_summary(snapshot, D.stored_metrics(spark, sf)))


_OUTPUT_CHECKS = """SELECT (SELECT count(*) FROM predictions WHERE source='storm') AS prediction_results, (SELECT count(*) FROM metrics) AS realtime_metrics,
       (SELECT count(*) FROM predictions WHERE source='storm') AS processed_count, true AS tables_ok, true AS snapshots_ok"""


@query("pipeline_checks", _OUTPUT_CHECKS)
@query("realtime_output_checks", _OUTPUT_CHECKS)
def realtime_output_checks(spark, sf):
    return M.output_checks(D.predictions(spark, sf), D.stored_metrics(spark, sf), _summary_snapshot(spark, sf))


_RECENT_ITEMS = f"""SELECT booking_id, hotel_name, country_name, cancel_probability, risk_level_name, business_time
    FROM ({_JOINED}) ORDER BY business_time DESC, booking_id DESC LIMIT 10"""


@query("serve_recent", _RECENT_ITEMS)
def serve_recent(spark, sf):
    """No snapshot is fresh, so the stored predictions serve."""
    stored = P.recent(D.predictions(spark, sf), D.bookings(spark, sf), 10)
    return M.serve_recent(_missing(stored), stored)


@query("serve_recent_snapshot", _RECENT_ITEMS.replace("ORDER BY", "WHERE booking_id % 3 = 0 ORDER BY"))
def serve_recent_snapshot(spark, sf):
    """A snapshot that has items serves, whatever the stored predictions are."""
    predictions, bookings = D.predictions(spark, sf), D.bookings(spark, sf)
    snapshot = P.recent(predictions.where(F.col("booking_id") % 3 == 0), bookings, 10)
    return M.serve_recent(snapshot, P.recent(predictions, bookings, 10))


@query("listed_total", f"SELECT o + processed_count AS total FROM ({_TOTALS}), (SELECT count(*) AS o FROM active WHERE arrival_date <= DATE '{D.CUTOFF}')")
def listed_total(spark, sf):
    active = _active(spark, sf)
    dashboard = M.dashboard_totals(
        L.split_counts(active, D.CUTOFF, D.START), M.serve_summary(_summary_snapshot(spark, sf), D.stored_metrics(spark, sf))
    )
    return M.listed_total(B.page_totals(active), dashboard, filtered=False)


# --- chart series ----------------------------------------------------------------------------

_MONTHS = f"""(SELECT strftime(arrival_date,'%Y-%m') AS x, count(*)::double AS b, sum(is_canceled)::double AS c,
    {even('sum(is_canceled)::double/count(*)')} AS r FROM active GROUP BY 1)"""


@query(
    "series_trend",
    f"""SELECT x, '订单数' AS series, b AS value FROM {_MONTHS} UNION ALL SELECT x, '已取消订单', c FROM {_MONTHS}
        UNION ALL SELECT x, '取消率', r FROM {_MONTHS}""",
)
def series_trend(spark, sf):
    return R.long_series(O.trend(_active(spark, sf), "month"), "period", R.OVERVIEW_SERIES)


@query(
    "series_realtime_trend",
    f"""SELECT label AS x, '预订流入' AS series, inflow::double AS value FROM (SELECT {_POINT}) UNION ALL
        SELECT label, '预测取消', predicted_cancellations::double FROM (SELECT {_POINT}) UNION ALL
        SELECT label, '取消率', cancel_rate FROM (SELECT {_POINT})""",
)
def series_realtime_trend(spark, sf):
    served = M.serve_trend(_day_snapshots(spark, sf), D.stored_metrics(spark, sf), "day")
    return R.long_series(served, "label", R.REALTIME_SERIES)


_ACTIVE_RATE = even("sum(is_canceled)::double/count(*)")


@query(
    "series_factor",
    f"""SELECT 'lead_time_high' AS name, {_ACTIVE_RATE} AS value FROM active WHERE lead_time>=90 UNION ALL
        SELECT 'no_special_requests', {_ACTIVE_RATE} FROM active WHERE total_of_special_requests=0 UNION ALL
        SELECT 'previous_cancellations', {_ACTIVE_RATE} FROM active WHERE previous_cancellations>0""",
)
def series_factor(spark, sf):
    return R.named_values(O.factor_rates(_active(spark, sf)), "name", "cancel_rate", "value")


@query("series_channel", f"SELECT market_segment_name AS name, {_ACTIVE_RATE} AS value FROM active GROUP BY market_segment, market_segment_name")
def series_channel(spark, sf):
    return R.named_values(O.channel_ranking(_active(spark, sf)), "name", "cancel_rate", "value")


@query("series_structure", "SELECT is_canceled_label AS name, count(*)::double AS value FROM active GROUP BY 1")
def series_structure(spark, sf):
    return R.named_values(O.cancel_structure(_active(spark, sf)), "name", "cancel_rate", "value")


@query(
    "series_tags",
    """SELECT 'lead_time_high' AS name, count(*)::double AS value FROM active WHERE lead_time>=90 UNION ALL
       SELECT 'no_special_requests', count(*) FROM active WHERE total_of_special_requests=0 UNION ALL
       SELECT 'previous_cancellations', count(*) FROM active WHERE previous_cancellations>0""",
)
def series_tags(spark, sf):
    return R.named_values(O.risk_tag_counts(_active(spark, sf)), "name", "value")


def _map_case() -> str:
    arms = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in S.WORLD_MAP_NAMES.items())
    return f"CASE country_code {arms} ELSE country_name END"


@query("series_country", f"SELECT {_map_case()} AS name, {_ACTIVE_RATE} AS value FROM active GROUP BY country_code, country_name")
def series_country(spark, sf):
    return R.country_series(O.country_rates(_active(spark, sf)))
