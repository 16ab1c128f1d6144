"""The derived tables in DuckDB SQL, written from FIXTURES.md and not from the Spark expressions.

`raw` has the source text, `raw_nulls` the text after missing-value tokens, `cleaned` the
contract, `bookings` the contract with soft deletes, `active` the rows not deleted.
"""

from staylens import schemas as S


def even(expression: str, digits: int = 4) -> str:
    """Half to even on the exact binary value of a double expression."""
    scale = f"{10**digits}.0::double"
    high = "(v*134217729.0::double - (v*134217729.0::double - v))"
    below = f"floor(v*{scale})"
    past = f"(({high}*{scale} - ({below}+0.5::double)) + (v-{high})*{scale})"
    up = f"case when {past}>0 or ({past}=0 and {below}%2<>0) then 1 else 0 end"
    return f"list_transform([({expression})::double], lambda v: ({below}+{up})/{scale})[1]"


def part_text(part: str, whole: str) -> str:
    """part / whole of two integers as text with four decimals, half up, in integer arithmetic."""
    return f"printf('%.4f', ((({part})::hugeint*20000 + ({whole})) // (2*({whole})))::double / 10000.0::double)"


# FIXTURES.md 5.1, with every column as text.
_RAW = """
raw AS (
  SELECT o_orderkey AS src_pos, r.* FROM (
    SELECT o.*, c_nationkey, c_mktsegment, n_name, n_nationkey, o_orderkey AS k, coalesce(n_lines,0) AS nl
    FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
  ) b, LATERAL (SELECT
    case when k%3=0 then 'Resort Hotel' when k%101=1 then 'Boutique Hotel' else 'City Hotel' end AS hotel,
    case when k%97=0 then 'NULL' when o_orderstatus='F' then '1' else '0' end AS is_canceled,
    case when k%53=0 then 'abc' else cast((k*37+o_custkey)%300 as varchar) end AS lead_time,
    cast(year(o_orderdate) as varchar) AS arrival_date_year,
    monthname(o_orderdate) AS arrival_date_month,
    cast(day(o_orderdate) as varchar) AS arrival_date_day_of_month,
    cast(nl%3 as varchar) AS stays_in_weekend_nights,
    cast(nl%6 as varchar) AS stays_in_week_nights,
    cast(1+k%3 as varchar) AS adults,
    case when k%29=0 then 'NA' else cast(k%2 as varchar) end AS children,
    case when k%11=0 then '1' else '0' end AS babies,
    case k%6 when 0 then 'BB' when 1 then 'HB' when 2 then 'FB' when 3 then 'SC' when 4 then 'Undefined' else null end AS meal,
    case when k%41=0 then 'NULL' else case n_nationkey when 0 then 'PRT' when 1 then 'GBR' when 2 then 'FRA' when 3 then 'ESP'
      when 4 then 'DEU' when 5 then 'ITA' when 6 then 'IRL' when 7 then 'BRA' when 8 then 'USA' when 9 then 'CN'
      when 10 then 'CHN' else n_name end end AS country,
    case c_mktsegment when 'AUTOMOBILE' then 'Online TA' when 'BUILDING' then 'Direct' when 'FURNITURE' then 'Corporate'
      when 'HOUSEHOLD' then 'Groups' else 'Offline TA/TO' end AS market_segment,
    case k%4 when 0 then 'TA/TO' when 1 then 'Direct' when 2 then 'Corporate' else null end AS distribution_channel,
    case when k%503=5 then '2' when k%7=0 then '1' else '0' end AS is_repeated_guest,
    cast(case when k%13=0 then 1+k%3 else 0 end as varchar) AS previous_cancellations,
    cast(o_custkey%5 as varchar) AS previous_bookings_not_canceled,
    case k%4 when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end AS reserved_room_type,
    case when k%59=0 then null when k%5=0 then 'E' else
      case k%4 when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end end AS assigned_room_type,
    cast(k%4 as varchar) AS booking_changes,
    case o_orderpriority when '1-URGENT' then 'Non Refund' when '2-HIGH' then 'Refundable' when '5-LOW' then null
      else 'No Deposit' end AS deposit_type,
    cast(k%10 as varchar) AS days_in_waiting_list,
    case o_custkey%5 when 0 then 'Transient' when 1 then 'Transient-Party' when 2 then 'Contract' when 3 then 'Group'
      else null end AS customer_type,
    case when k%61=0 then null else cast(cast(o_totalprice as decimal(10,2)) as varchar) end AS adr,
    case when k%8=0 then '1' else '0' end AS required_car_parking_spaces,
    cast(k%6 as varchar) AS total_of_special_requests,
    case o_orderstatus when 'F' then 'Canceled' when 'O' then 'Check-Out' else 'No-Show' end AS reservation_status,
    cast(cast(o_orderdate as date) as varchar) AS reservation_status_date
  ) r
)"""

_RAW_NULLS = "raw_nulls AS (SELECT src_pos, " + ", ".join(
    f"case when {name} in ('NULL','NA') then null else {name} end AS {name}" for name in S.RAW_COLUMNS
) + " FROM raw)"


def _case(code: str, entries: dict, otherwise: str) -> str:
    arms = " ".join(f"when {code}={key!r} then '{label}'" for key, label in entries.items())
    return f"case {arms} else {otherwise} end"


def _int(name: str) -> str:
    return f"cast(trunc(coalesce(try_cast({name} as double),0)) as int)"


_CLEANED = f"""
typed AS (
  SELECT src_pos, hotel, {', '.join(f'{_int(name)} AS {name}' for name in S.INT_COLUMNS)},
    cast(strptime(arrival_date_year || ' ' || arrival_date_month || ' ' || arrival_date_day_of_month, '%Y %B %d') as date) AS arrival_date,
    {', '.join(f"coalesce({name},'{value}') AS {'country_code' if name == 'country' else name}" for name, value in S.MISSING_CODE.items())},
    coalesce(try_cast(adr as decimal(10,2)), 0) AS adr,
    reservation_status, cast(reservation_status_date as date) AS reservation_status_date
  FROM raw_nulls
),
cleaned AS (
  SELECT src_pos + 1 AS booking_id, hotel, {_case('hotel', S.HOTEL_LABELS, 'hotel')} AS hotel_name,
    is_canceled, {_case('is_canceled', S.CANCELED_LABELS, 'null')} AS is_canceled_label, lead_time,
    arrival_date, arrival_date AS event_date, stays_in_weekend_nights, stays_in_week_nights,
    stays_in_weekend_nights + stays_in_week_nights AS total_nights, adults, children, babies,
    adults + children + babies AS total_guests, meal, {_case('meal', S.MEAL_LABELS, 'meal')} AS meal_name,
    country_code, {_case('country_code', S.COUNTRY_LABELS, 'country_code')} AS country_name,
    market_segment, {_case('market_segment', S.SEGMENT_LABELS, 'market_segment')} AS market_segment_name,
    distribution_channel, is_repeated_guest, {_case('is_repeated_guest', S.REPEATED_GUEST_LABELS, 'null')} AS is_repeated_guest_label,
    previous_cancellations, previous_bookings_not_canceled, reserved_room_type, assigned_room_type,
    case when reserved_room_type <> assigned_room_type then 1 else 0 end AS room_type_changed, booking_changes,
    deposit_type, {_case('deposit_type', S.DEPOSIT_LABELS, 'deposit_type')} AS deposit_type_name, days_in_waiting_list,
    customer_type, {_case('customer_type', S.CUSTOMER_LABELS, 'customer_type')} AS customer_type_name, adr,
    required_car_parking_spaces, total_of_special_requests, reservation_status, reservation_status_date, 0 AS is_deleted
  FROM typed
),
bookings AS (SELECT * REPLACE (case when (booking_id-1)%19=0 then 1 else 0 end AS is_deleted) FROM cleaned),
active AS (SELECT * FROM bookings WHERE is_deleted = 0)"""

_PREDICTIONS = """
predictions AS (
  SELECT event_id AS prediction_id, event_id*2+1 AS booking_id, 'random_forest_v1' AS model_version, cancel_probability,
    case when cancel_probability>=0.5 then 1 else 0 end AS predicted_label,
    case when cancel_probability>=0.6 then 'high' when cancel_probability>=0.3 then 'medium' else 'low' end AS risk_level,
    case event_type when 'signup' then 'api' else 'storm' end AS source, ts AS predicted_at
  FROM (SELECT *, cast(cast(json_extract_string(props,'$.k') as int)/100.0::double as decimal(6,4)) AS cancel_probability FROM events)
)"""

_METRICS = f"""
hourly AS (
  SELECT date_trunc('hour', predicted_at) AS w, count(*) AS n, count(*) FILTER (risk_level='high') AS h,
    sum(predicted_label) AS c, cast(sum(cancel_probability)*10000 as bigint) AS p4
  FROM predictions WHERE source='storm' GROUP BY 1
),
hourly_country AS (
  SELECT date_trunc('hour', predicted_at) AS w, coalesce(country_name,'unknown') AS name, count(*) AS n, sum(predicted_label) AS c
  FROM predictions p LEFT JOIN bookings b ON b.booking_id = p.booking_id WHERE source='storm' GROUP BY 1, 2
),
metrics AS (
  SELECT t.*, w AS window_start, w + interval 1 hour AS window_end, w + interval 1 hour AS updated_at FROM (
    SELECT w, 'summary' AS metric_type, 'processed_count' AS metric_name, cast(n as varchar) AS metric_value FROM hourly
    UNION ALL SELECT w, 'summary', 'high_risk_count', cast(h as varchar) FROM hourly
    UNION ALL SELECT w, 'summary', 'average_cancel_probability', {part_text('p4', 'n*10000')} FROM hourly
    UNION ALL SELECT w, 'summary', 'predicted_cancellations', cast(c as varchar) FROM hourly
    UNION ALL SELECT w, 'trend_day', 'inflow', cast(n as varchar) FROM hourly
    UNION ALL SELECT w, 'trend_day', 'predicted_cancellations', cast(c as varchar) FROM hourly
    UNION ALL SELECT w, 'trend_day', 'cancel_rate', {part_text('c', 'n')} FROM hourly
    UNION ALL SELECT w, 'country_risk', name, {part_text('c', 'n')} FROM hourly_country
  ) t
)"""

TABLES = "WITH " + ",".join([_RAW, _RAW_NULLS, _CLEANED, _PREDICTIONS, _METRICS]) + "\n"



def wire(columns: list[str]) -> str:
    """A select list of contract columns in wire form."""
    parts = []
    for name in columns:
        kind = S.CONTRACT_TYPES[name]
        if kind == "date":
            parts.append(f"strftime({name}, '%Y-%m-%d') AS {name}")
        elif kind.startswith("decimal"):
            parts.append(f"{name}::double AS {name}")
        else:
            parts.append(name)
    return ", ".join(parts)
