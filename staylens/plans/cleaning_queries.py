"""Registered queries: cleaning job, file round trips, contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens import schemas as S
from staylens.functions.labels import label_or_code
from staylens.functions.wire import alias_float, alias_int, metric_field, metric_number
from staylens.operators import cleaning as C
from staylens.operators.bookings import active_bookings
from staylens.operators.splits import realtime_side
from staylens.plans import tables as D
from staylens.plans.catalog import query
from staylens.plans.oracle_tables import even, wire
from staylens.session import fresh_dir
from staylens.sources import files

_IDS = ["booking_id"]
# Rows of a raw file, about.
ROWS_PER_FILE = 200_000


@query("scan_raw_csv", f"SELECT src_pos, {', '.join(S.RAW_COLUMNS)} FROM raw_nulls")
def scan_raw_csv(spark, sf):
    path = fresh_dir(spark, "raw-csv")
    files.write_raw_csv(D.raw_bookings(spark, sf), path)
    schema = S.T.StructType([S.T.StructField("src_pos", S.T.StringType()), *S.RAW_SCHEMA.fields])
    return files.read_raw_csv(spark, path, schema).withColumn("src_pos", F.col("src_pos").cast("bigint"))


@query(
    "scan_clean_lenient_dates",
    """SELECT booking_id, case when (booking_id-1)%23=0 then null else strftime(arrival_date,'%Y-%m-%d') end AS arrival_date,
       strftime(event_date,'%Y-%m-%d') AS event_date, strftime(reservation_status_date,'%Y-%m-%d') AS reservation_status_date,
       is_deleted FROM bookings""",
)
def scan_clean_lenient_dates(spark, sf):
    path = fresh_dir(spark, "clean-csv")
    damaged = F.when((F.col("booking_id") - 1) % 23 == 0, "2017-02-30").otherwise(F.date_format("arrival_date", "yyyy-MM-dd"))
    files.write_clean_csv(D.bookings(spark, sf).withColumn("arrival_date", damaged), path)
    return files.read_clean_csv(spark, path).select("booking_id", *S.DATE_COLUMNS, "is_deleted")


@query("scan_table", f"SELECT {wire(S.CONTRACT_COLUMNS)} FROM active")
def scan_table(spark, sf):
    """All active rows of the stored table."""
    path = fresh_dir(spark, "bookings")
    files.write_bookings_table(D.bookings(spark, sf), path)
    rows = files.read_bookings_table(spark, path)
    return rows.where(F.col("is_deleted") == 0).select(*S.CONTRACT_COLUMNS)


@query("scan_table_months", f"SELECT {wire(S.CONTRACT_COLUMNS)} FROM active WHERE arrival_date >= DATE '1999-01-01'")
def scan_table_months(spark, sf):
    """The realtime side of the stored table: the folders of earlier months aren't read."""
    path = fresh_dir(spark, "bookings")
    files.write_bookings_table(D.bookings(spark, sf), path)
    return realtime_side(active_bookings(files.read_bookings_table(spark, path)), "1999-01-01").select(*S.CONTRACT_COLUMNS)


@query("sink_clean_roundtrip", f"SELECT {wire(S.CONTRACT_COLUMNS)} FROM bookings")
def sink_clean_roundtrip(spark, sf):
    path = fresh_dir(spark, "clean-csv")
    files.write_clean_csv(D.bookings(spark, sf), path)
    return files.read_clean_csv(spark, path)


@query(
    "align_to_contract",
    f"""SELECT {wire(S.CONTRACT_COLUMNS)} FROM (SELECT * REPLACE (0 AS lead_time, 0 AS babies, null::varchar AS meal_name,
        0.00::decimal(10,2) AS adr, 0 AS is_deleted) FROM bookings)""",
)
def align_to_contract(spark, sf):
    return C.align_to_contract(D.bookings(spark, sf).drop("lead_time", "babies", "meal_name", "adr", "is_deleted"))


@query(
    "assign_dense_id",
    """SELECT src_pos, reservation_status_date, row_number() OVER (ORDER BY reservation_status_date, src_pos) AS position
       FROM raw_nulls""",
)
def assign_dense_id(spark, sf):
    raw = D.raw_with_nulls(spark, sf).select("src_pos", "reservation_status_date")
    return C.dense_position(raw, "reservation_status_date", "src_pos").select("src_pos", "reservation_status_date", "position")


@query("coerce_ints", "SELECT src_pos, " + ", ".join(S.INT_COLUMNS) + " FROM typed")
def coerce_ints(spark, sf):
    return D.raw_with_nulls(spark, sf).withColumns(C.coerced_ints()).select("src_pos", *S.INT_COLUMNS)


@query("coerce_adr", "SELECT src_pos, adr::double AS adr FROM typed")
def coerce_adr(spark, sf):
    return D.raw_with_nulls(spark, sf).select("src_pos", C.lenient_money("adr").alias("adr"))


_CODES = [name for name in S.MISSING_CODE if name != "country"]


@query("fill_defaults", "SELECT src_pos, country_code AS country, " + ", ".join(_CODES) + " FROM typed")
def fill_defaults(spark, sf):
    return D.raw_with_nulls(spark, sf).withColumns(C.filled_codes()).select("src_pos", "country", *_CODES)


_NAMES = "hotel_name country_name market_segment_name deposit_type_name customer_type_name meal_name".split()


@query("label_with_fallback", "SELECT booking_id, " + ", ".join(_NAMES) + " FROM cleaned")
def label_with_fallback(spark, sf):
    return D.bookings(spark, sf).select(*_IDS, *_NAMES)


@query("label_flags", "SELECT booking_id, is_canceled, is_canceled_label, is_repeated_guest, is_repeated_guest_label FROM cleaned")
def label_flags(spark, sf):
    return D.bookings(spark, sf).select(
        *_IDS, "is_canceled", "is_canceled_label", "is_repeated_guest", "is_repeated_guest_label"
    )


@query("assemble_date", "SELECT booking_id, strftime(arrival_date,'%Y-%m-%d') AS arrival_date FROM cleaned")
def assemble_date(spark, sf):
    return D.bookings(spark, sf).select(*_IDS, "arrival_date")


@query(
    "parse_status_date",
    "SELECT booking_id, strftime(reservation_status_date,'%Y-%m-%d') AS reservation_status_date FROM cleaned",
)
def parse_status_date(spark, sf):
    return D.bookings(spark, sf).select(*_IDS, "reservation_status_date")


@query("derive_totals", "SELECT booking_id, total_nights, total_guests FROM cleaned")
def derive_totals(spark, sf):
    return D.bookings(spark, sf).select(*_IDS, "total_nights", "total_guests")


@query("derive_room_changed", "SELECT booking_id, reserved_room_type, assigned_room_type, room_type_changed FROM cleaned")
def derive_room_changed(spark, sf):
    return D.bookings(spark, sf).select(*_IDS, "reserved_room_type", "assigned_room_type", "room_type_changed")


@query(
    "clean_bookings",
    f"""SELECT {wire(S.CONTRACT_COLUMNS)} FROM (SELECT * REPLACE (row_number() OVER (ORDER BY booking_id) AS booking_id) FROM cleaned)""",
)
def clean_bookings(spark, sf):
    return C.import_bookings(D.raw_with_nulls(spark, sf), "src_pos")


@query(
    "import_raw_files",
    f"""SELECT {wire(S.CONTRACT_COLUMNS)} FROM (SELECT * REPLACE (row_number() OVER (ORDER BY booking_id) AS booking_id) FROM cleaned)""",
)
def import_raw_files(spark, sf):
    """Several raw CSV files, more of them for more rows, as one task sorts a file; the ids are the positions in file order."""
    path = fresh_dir(spark, "raw-csv")
    parts = max(5, -(-D.table(spark, sf, "orders").count() // ROWS_PER_FILE))
    files.write_raw_csv(D.raw_bookings(spark, sf).repartitionByRange(parts, "src_pos").sortWithinPartitions("src_pos").drop("src_pos"), path)
    return C.import_files(files.read_raw_csv(spark, path, positions=True))


@query("project_list", f"SELECT {wire(S.LIST_COLUMNS)} FROM active")
def project_list(spark, sf):
    return D.bookings(spark, sf).where("is_deleted = 0").select(*S.LIST_COLUMNS)


@query("project_detail", f"SELECT {wire(S.DETAIL_COLUMNS)} FROM active")
def project_detail(spark, sf):
    return D.bookings(spark, sf).where("is_deleted = 0").select(*S.DETAIL_COLUMNS)


@query("project_candidates", f"SELECT {wire(S.CANDIDATE_COLUMNS)} FROM active")
def project_candidates(spark, sf):
    return D.bookings(spark, sf).where("is_deleted = 0").select(*S.CANDIDATE_COLUMNS)


@query("project_events", f"SELECT {wire(S.EVENT_COLUMNS)} FROM active")
def project_events(spark, sf):
    return D.bookings(spark, sf).where("is_deleted = 0").select(*S.EVENT_COLUMNS)


@query(
    "normalize_record",
    f"""SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') AS o_orderdate, strftime(o_orderdate,'%Y-%m-%d') AS order_day,
       case when o_orderkey%7=0 then null else {even('o_totalprice/1000')} end AS thousands,
       cast(o_totalprice as decimal(12,2))::double AS amount FROM orders""",
)
def normalize_record(spark, sf):
    nan = F.lit(float("nan"))
    return D.table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderdate",
        F.to_date("o_orderdate").alias("order_day"),
        F.when(F.col("o_orderkey") % 7 == 0, nan).otherwise(F.col("o_totalprice") / 1000).alias("thousands"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
    )


@query(
    "parse_metric_value",
    """SELECT event_id, case when event_type='view' then value when event_type='click' then null else
         try_cast(json_extract_string(props,'$.k') as double) end AS number_value,
       case when event_type='error' then json_extract_string(props,'$.k') end AS object_k,
       case event_type when 'view' then cast(value as varchar) when 'click' then event_type when 'error' then null
         else json_extract_string(props,'$.k') end AS text_value
       FROM events""",
)
def parse_metric_value(spark, sf):
    """Metric texts of all kinds: numbers, plain words and flat JSON objects."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.col("value").cast("string"))
        .when(kind == "click", kind)
        .when(kind == "error", F.col("props"))
        .otherwise(F.get_json_object("props", "$.k"))
    )
    field = metric_field(text, "k")
    return (
        D.table(spark, sf, "events")
        .withColumn("metric_value", text)
        .select(
            "event_id",
            F.coalesce(metric_number(F.col("metric_value")), field.try_cast("double")).alias("number_value"),
            field.alias("object_k"),
            F.when(field.isNull(), F.col("metric_value")).alias("text_value"),
        )
    )


@query(
    "coalesce_aliases",
    f"""SELECT event_id, cast(trunc(coalesce(case when event_type in ('view','click') then value end,
         case when event_type<>'error' then user_id end, 0)) as bigint) AS inflow,
       {even("coalesce(case when event_type='view' then value/1000 end, 0.0)")} AS cancel_rate FROM events""",
)
def coalesce_aliases(spark, sf):
    kind = F.col("event_type")
    payload = D.table(spark, sf, "events").select(
        "event_id",
        F.when(kind.isin("view", "click"), F.col("value")).alias("inflow_count"),
        F.when(kind != "error", F.col("user_id")).alias("booking_count"),
        F.when(kind == "view", F.col("value") / 1000).alias("latest_cancel_rate"),
    )
    return payload.select(
        "event_id",
        alias_int(payload, "inflow", "inflow_count", "booking_count").alias("inflow"),
        alias_float(payload, "cancel_rate", "latest_cancel_rate").alias("cancel_rate"),
    )


def _world_case() -> str:
    arms = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in S.WORLD_MAP_NAMES.items())
    return f"CASE country_code {arms} ELSE country_name END"


@query("world_map_name", f"SELECT booking_id, {_world_case()} AS map_name FROM active")
def world_map_name(spark, sf):
    active = D.bookings(spark, sf).where("is_deleted = 0")
    return active.select("booking_id", label_or_code("country_code", S.WORLD_MAP_NAMES, "country_name").alias("map_name"))


@query(
    "not_null_violations",
    " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) - count({name}) AS null_count FROM bookings" for name in S.CONTRACT_COLUMNS
    ),
)
def not_null_violations(spark, sf):
    return C.not_null_violations(D.bookings(spark, sf), S.CONTRACT_COLUMNS)


@query(
    "duplicate_keys",
    """SELECT 'bookings' AS table_name, cast(booking_id as varchar) AS key_value, count(*) AS row_count FROM bookings
         GROUP BY booking_id HAVING count(*) > 1
       UNION ALL SELECT 'prediction_results', cast(prediction_id as varchar), count(*) FROM (
         SELECT prediction_id FROM predictions UNION ALL SELECT prediction_id FROM predictions WHERE source='api')
         GROUP BY prediction_id HAVING count(*) > 1
       UNION ALL SELECT 'realtime_metrics', metric_type || '|' || metric_name || '|' || strftime(window_end,'%Y-%m-%d %H:%M:%S'), count(*)
         FROM metrics GROUP BY metric_type, metric_name, window_end HAVING count(*) > 1
       UNION ALL SELECT 'model_metrics', model_version || '|' || source, count(*) FROM predictions
         GROUP BY model_version, source HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf):
    scored = D.predictions(spark, sf)
    redelivered = scored.unionByName(scored.where(F.col("source") == "api"))
    reports = [
        C.duplicate_keys(D.bookings(spark, sf), ["booking_id"], "bookings"),
        C.duplicate_keys(redelivered, ["prediction_id"], "prediction_results"),
        C.duplicate_keys(D.stored_metrics(spark, sf), ["metric_type", "metric_name", "window_end"], "realtime_metrics"),
        C.duplicate_keys(scored, ["model_version", "source"], "model_metrics"),
    ]
    result = reports[0]
    for report in reports[1:]:
        result = result.unionByName(report)
    return result
