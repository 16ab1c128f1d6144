"""Registered queries: filters, pages, edits and the overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens import schemas as S
from staylens.operators import bookings as B
from staylens.operators import edits as E
from staylens.operators import overview as O
from staylens.plans import tables as D
from staylens.plans.catalog import query
from staylens.plans.oracle_tables import even, wire
from staylens.session import fresh_dir, stored
from staylens.sources import files

_LIST = wire(S.LIST_COLUMNS)
_ALL = wire(S.CONTRACT_COLUMNS)


def _active(spark, sf):
    return B.active_bookings(D.bookings(spark, sf))


@query("active_bookings", f"SELECT {_ALL} FROM active")
def active_bookings(spark, sf):
    return _active(spark, sf)


@query(
    "filter_equality",
    f"""SELECT {_LIST} FROM active WHERE hotel='City Hotel' AND country_code='PRT' AND market_segment='Direct'
        AND customer_type='Contract'""",
)
def filter_equality(spark, sf):
    rows = B.filter_bookings(
        D.bookings(spark, sf), hotel="City Hotel", country_code="PRT", market_segment="Direct", customer_type="Contract"
    )
    return rows.select(*S.LIST_COLUMNS)


@query("filter_canceled", f"SELECT {_LIST} FROM active WHERE is_canceled = 0")
def filter_canceled(spark, sf):
    return B.filter_bookings(D.bookings(spark, sf), is_canceled="0", hotel="").select(*S.LIST_COLUMNS)


@query(
    "filter_keyword",
    f"""SELECT {_LIST} FROM active WHERE contains(cast(booking_id as varchar),'12') OR contains(lower(country_name),'12')
        OR contains(lower(country_code),'12')""",
)
def filter_keyword(spark, sf):
    return B.filter_bookings(D.bookings(spark, sf), keyword="12").select(*S.LIST_COLUMNS)


@query(
    "filter_keyword_text",
    f"""SELECT {_LIST} FROM active WHERE contains(cast(booking_id as varchar),'pr') OR contains(lower(country_name),'pr')
        OR contains(lower(country_code),'pr')""",
)
def filter_keyword_text(spark, sf):
    return B.filter_bookings(D.bookings(spark, sf), keyword="pR").select(*S.LIST_COLUMNS)


@query("filter_month", f"SELECT {_LIST} FROM active WHERE strftime(arrival_date,'%Y-%m')='1998-02'")
def filter_month(spark, sf):
    return B.filter_overview(D.bookings(spark, sf), month="1998-02").select(*S.LIST_COLUMNS)


@query("filter_risk_tag", f"SELECT {_LIST} FROM active WHERE previous_cancellations > 0")
def filter_risk_tag(spark, sf):
    return B.filter_overview(D.bookings(spark, sf), risk_tag="previous_cancellations").select(*S.LIST_COLUMNS)


@query("lookup_by_ids", f"SELECT {_ALL} FROM active WHERE booking_id IN (SELECT booking_id FROM predictions)")
def lookup_by_ids(spark, sf):
    return B.lookup_by_ids(D.bookings(spark, sf), D.predictions(spark, sf))


@query("paginate", f"SELECT {_LIST} FROM active WHERE hotel='City Hotel' ORDER BY booking_id LIMIT 20 OFFSET 40")
def paginate(spark, sf):
    return B.paginate(B.filter_bookings(D.bookings(spark, sf), hotel="City Hotel"), page=3, size=20)


@query("paginate_deep", f"SELECT {_LIST} FROM active ORDER BY booking_id LIMIT 100 OFFSET 1000")
def paginate_deep(spark, sf):
    """A page past the top-k bound; the bound is lowered so that the small tables reach it."""
    active = _active(spark, sf)
    return B.paginate(active, page=11, size=500, top_k_rows=1000, ranges=stored(B.id_ranges(active), "id-ranges"))


@query("paginate_keyset", f"SELECT {_LIST} FROM active WHERE booking_id > 700 ORDER BY booking_id LIMIT 25")
def paginate_keyset(spark, sf):
    return B.page_after(_active(spark, sf), last_id=700, size=25)


@query(
    "export_page_csv",
    "SELECT " + ", ".join(f"cast({c} as varchar) AS {c}" for c in S.LIST_COLUMNS)
    + " FROM (SELECT * FROM active WHERE country_code='FRA' ORDER BY booking_id LIMIT 20)",
)
def export_page_csv(spark, sf):
    path = fresh_dir(spark, "page-csv")
    files.export_page(B.paginate(B.filter_bookings(D.bookings(spark, sf), country_code="FRA")), path)
    text = S.T.StructType([S.T.StructField(name, S.T.StringType()) for name in S.LIST_COLUMNS])
    return spark.read.schema(text).option("header", True).csv(path)


@query(
    "page_totals",
    "SELECT count(*) AS total, cast((count(*)+19)//20 as bigint) AS total_pages FROM active WHERE hotel='Resort Hotel'",
)
def page_totals(spark, sf):
    return B.page_totals(B.filter_bookings(D.bookings(spark, sf), hotel="Resort Hotel"), 20)


@query(
    "page_stats",
    f"""SELECT count(*) AS row_count, {even('sum(case when is_canceled=1 then 1 else 0 end)::double/count(*)')} AS cancel_rate,
        {even('sum(adr)::double/count(*)', 1)} AS avg_adr FROM (SELECT * FROM active ORDER BY booking_id LIMIT 50 OFFSET 50)""",
)
def page_stats(spark, sf):
    return B.page_stats(B.paginate(_active(spark, sf), page=2, size=50))


@query(
    "filter_options",
    " UNION ".join(
        f"SELECT '{dimension}' AS dimension, cast({value} as varchar) AS value, {label} AS label FROM active "
        f"WHERE {value} IS NOT NULL AND {label} IS NOT NULL"
        for dimension, (value, label) in B.OPTION_COLUMNS.items()
    ),
)
def filter_options(spark, sf):
    return B.filter_options(D.bookings(spark, sf))


@query("sample_orders", f"SELECT {wire(S.SAMPLE_COLUMNS)} FROM active WHERE country_code='ESP' ORDER BY booking_id LIMIT 10")
def sample_orders(spark, sf):
    return B.sample_orders(B.filter_overview(D.bookings(spark, sf), country_code="ESP"))


# --- edits -----------------------------------------------------------------------------------

_EDITS = """, edit_log AS (
  SELECT booking_id, prediction_id AS seq, case when predicted_label=1 then 'Contract' end AS customer_type,
    case when risk_level='low' then 'Aviation' end AS market_segment,
    case when risk_level='high' then 'Non Refund' end AS deposit_type,
    case when risk_level='medium' then 99.5 end AS adr, case when source='api' then 5 end AS total_of_special_requests
  FROM predictions UNION ALL
  SELECT booking_id, prediction_id + 1000000000, 'Group', null, null, null, null FROM predictions WHERE source='api'
), edits AS (SELECT * FROM edit_log QUALIFY row_number() OVER (PARTITION BY booking_id ORDER BY seq DESC) = 1)
"""


def _edit_log(spark, sf):
    """Edits from the predictions; ids with source `api` are edited twice, and the later edit counts."""
    scored = D.predictions(spark, sf)
    band = F.col("risk_level")
    first = scored.select(
        "booking_id",
        F.col("prediction_id").alias("seq"),
        F.when(F.col("predicted_label") == 1, "Contract").alias("customer_type"),
        F.when(band == "low", "Aviation").alias("market_segment"),
        F.when(band == "high", "Non Refund").alias("deposit_type"),
        F.when(band == "medium", F.lit(99.5)).alias("adr"),
        F.when(F.col("source") == "api", 5).alias("total_of_special_requests"),
    )
    later = scored.where(F.col("source") == "api").select(
        "booking_id", (F.col("prediction_id") + 1000000000).alias("seq"), F.lit("Group").alias("customer_type")
    )
    return first.unionByName(later, allowMissingColumns=True)


def _edited(select: str) -> str:
    from staylens.plans.oracle_tables import _case

    return f"""{_EDITS} SELECT {select} FROM (SELECT b.* REPLACE (
        coalesce(e.customer_type, b.customer_type) AS customer_type, coalesce(e.market_segment, b.market_segment) AS market_segment,
        coalesce(e.deposit_type, b.deposit_type) AS deposit_type, coalesce(cast(e.adr as decimal(10,2)), b.adr) AS adr,
        coalesce(e.total_of_special_requests, b.total_of_special_requests) AS total_of_special_requests,
        {_case('coalesce(e.customer_type, b.customer_type)', S.CUSTOMER_LABELS, 'coalesce(e.customer_type, b.customer_type)')} AS customer_type_name,
        {_case('coalesce(e.market_segment, b.market_segment)', S.SEGMENT_LABELS, 'coalesce(e.market_segment, b.market_segment)')} AS market_segment_name,
        {_case('coalesce(e.deposit_type, b.deposit_type)', S.DEPOSIT_LABELS, 'coalesce(e.deposit_type, b.deposit_type)')} AS deposit_type_name
      ) FROM bookings b LEFT JOIN edits e ON e.booking_id = b.booking_id)"""


@query("apply_edits", _edited(_ALL))
def apply_edits(spark, sf):
    return E.apply_edits(D.bookings(spark, sf), _edit_log(spark, sf), sequence="seq")


@query(
    "edit_counts",
    """SELECT count(*) FILTER (b.booking_id IS NOT NULL) AS matched, count(*) FILTER (b.booking_id IS NULL) AS unmatched
       FROM (SELECT DISTINCT booking_id FROM predictions) p LEFT JOIN bookings b ON b.booking_id = p.booking_id""",
)
def edit_counts(spark, sf):
    return E.edit_counts(D.bookings(spark, sf), _edit_log(spark, sf))


@query(
    "soft_delete",
    """SELECT booking_id, case when booking_id IN (SELECT booking_id FROM predictions WHERE risk_level='high') then 1
       else is_deleted end AS is_deleted FROM bookings""",
)
def soft_delete(spark, sf):
    gone = D.predictions(spark, sf).where(F.col("risk_level") == "high")
    return E.soft_delete(D.bookings(spark, sf), gone).select("booking_id", "is_deleted")


@query(
    "upsert_by_key",
    f"""SELECT {_ALL} FROM (SELECT * FROM bookings WHERE hotel<>'Resort Hotel'
        UNION ALL SELECT * REPLACE ('Partner Hotel' AS hotel, 0.00::decimal(10,2) AS adr) FROM bookings WHERE hotel='Resort Hotel'
        UNION ALL SELECT * REPLACE (-booking_id AS booking_id, 'Partner Hotel' AS hotel, 0.00::decimal(10,2) AS adr)
          FROM bookings WHERE hotel='Resort Hotel')""",
)
def upsert_by_key(spark, sf):
    base = D.bookings(spark, sf)
    partner = base.where(F.col("hotel") == "Resort Hotel").withColumns(
        {"hotel": F.lit("Partner Hotel"), "adr": F.lit("0.00").cast("decimal(10,2)")}
    )
    return E.upsert_by_key(base, partner.unionByName(partner.withColumn("booking_id", -F.col("booking_id"))))


@query("rewrite_table", f"SELECT {_ALL} FROM (SELECT * REPLACE (case when booking_id IN (SELECT booking_id FROM predictions) then 1 else is_deleted end AS is_deleted) FROM bookings)")
def rewrite_table(spark, sf):
    """Store the table by month, mark the predicted bookings deleted in the months that hold any, and read it back."""
    path = fresh_dir(spark, "bookings")
    files.write_bookings_table(D.bookings(spark, sf), path)
    gone = D.predictions(spark, sf)
    files.rewrite_months(spark, path, gone, lambda rows: E.soft_delete(rows, gone))
    return files.read_bookings_table(spark, path).drop("arrival_month")


# --- overview --------------------------------------------------------------------------------

_RATE = even("sum(is_canceled)::double/count(*)")
_COUNTS = "count(*) AS booking_count, cast(sum(is_canceled) as bigint) AS cancel_count"
_TAG_CONDITIONS = {
    "lead_time_high": "lead_time >= 90",
    "no_special_requests": "total_of_special_requests = 0",
    "previous_cancellations": "previous_cancellations > 0",
}


@query("overview_summary", f"SELECT {_COUNTS}, {_RATE} AS cancel_rate, {even('sum(adr)::double/count(*)', 2)} AS avg_adr FROM active")
def overview_summary(spark, sf):
    return O.summary(_active(spark, sf))


def _trend_sql(form: str) -> str:
    return f"SELECT strftime(arrival_date,'{form}') AS period, {_COUNTS}, {_RATE} AS cancel_rate FROM active GROUP BY 1"


@query("trend_month", _trend_sql("%Y-%m"))
def trend_month(spark, sf):
    return O.trend(_active(spark, sf), "month")


@query("trend_day", _trend_sql("%Y-%m-%d"))
def trend_day(spark, sf):
    return O.trend(_active(spark, sf), "day")


_STRUCTURE = "SELECT is_canceled_label AS name, count(*) AS value FROM active WHERE is_canceled_label IS NOT NULL GROUP BY 1"


@query("cancel_structure", _STRUCTURE)
def cancel_structure(spark, sf):
    return O.cancel_structure(_active(spark, sf))


@query(
    "factor_rates",
    " UNION ALL ".join(
        f"SELECT '{tag}' AS name, '{tag}' AS risk_tag, {_RATE} AS cancel_rate FROM active WHERE {condition}"
        for tag, condition in _TAG_CONDITIONS.items()
    ),
)
def factor_rates(spark, sf):
    return O.factor_rates(_active(spark, sf))


@query(
    "risk_tag_counts",
    " UNION ALL ".join(
        f"SELECT '{tag}' AS name, count(*) AS value FROM active WHERE {condition}" for tag, condition in _TAG_CONDITIONS.items()
    ),
)
def risk_tag_counts(spark, sf):
    return O.risk_tag_counts(_active(spark, sf))


@query(
    "channel_ranking",
    f"""SELECT market_segment, market_segment_name AS name, count(*) AS booking_count, {_RATE} AS cancel_rate
        FROM active GROUP BY 1, 2""",
)
def channel_ranking(spark, sf):
    return O.channel_ranking(_active(spark, sf))


@query(
    "country_rates",
    f"SELECT country_code AS code, country_name AS name, {_RATE} AS value, count(*) AS booking_count FROM active GROUP BY 1, 2",
)
def country_rates(spark, sf):
    return O.country_rates(_active(spark, sf))


def _sections_sql(source: str) -> str:
    part = f"{_COUNTS}, {_RATE} AS cancel_rate"
    none = "null::double AS avg_adr"
    rows = [
        f"SELECT 'summary' AS section, null::varchar AS code, null::varchar AS name, {part}, {even('sum(adr)::double/count(*)', 2)} AS avg_adr FROM {source}",
        f"SELECT 'trend', strftime(arrival_date,'%Y-%m'), strftime(arrival_date,'%Y-%m'), {part}, {none} FROM {source} GROUP BY 2, 3",
        f"SELECT 'cancel_structure', null, is_canceled_label, {part}, {none} FROM {source} GROUP BY 3",
        f"SELECT 'channel_ranking', market_segment, market_segment_name, {part}, {none} FROM {source} GROUP BY 2, 3",
        f"SELECT 'country_map', country_code, country_name, {part}, {none} FROM {source} GROUP BY 2, 3",
    ]
    rows += [
        f"SELECT 'risk_factor', null, '{tag}', {part}, {none} FROM {source} WHERE {condition}"
        for tag, condition in _TAG_CONDITIONS.items()
    ]
    return " UNION ALL ".join(rows)


@query("overview_sections", _sections_sql("active"))
def overview_sections(spark, sf):
    return O.sections(_active(spark, sf))


@query(
    "overview_filtered",
    _sections_sql("(SELECT * FROM active WHERE market_segment='Direct' AND customer_type='Contract' AND lead_time >= 90)"),
)
def overview_filtered(spark, sf):
    rows = B.filter_overview(
        D.bookings(spark, sf), market_segment="Direct", customer_type="Contract", risk_tag="lead_time_high"
    )
    return O.sections(rows)
