"""Schemas, defaults and the fixed label dictionaries."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
    "decimal(10,2)": T.DecimalType(10, 2), "decimal(6,4)": T.DecimalType(6, 4),
}


def struct(columns: str) -> T.StructType:
    """A schema from "name type, name type"; unlike a DDL string it needs no running session."""
    pairs = (column.split() for column in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# ---------------------------------------------------------------------------
# The 29 raw columns, all read as text.
# ---------------------------------------------------------------------------
RAW_COLUMNS = """
    hotel is_canceled lead_time arrival_date_year arrival_date_month arrival_date_day_of_month
    stays_in_weekend_nights stays_in_week_nights adults children babies meal country market_segment
    distribution_channel is_repeated_guest previous_cancellations previous_bookings_not_canceled
    reserved_room_type assigned_room_type booking_changes deposit_type days_in_waiting_list customer_type
    adr required_car_parking_spaces total_of_special_requests reservation_status reservation_status_date
""".split()

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])

# ---------------------------------------------------------------------------
# The 41-column contract, in order, as "name type [default]".
# A column without a default must be supplied by the writer.
# ---------------------------------------------------------------------------
_CONTRACT = """
    booking_id                      bigint
    hotel                           string
    hotel_name                      string
    is_canceled                     int
    is_canceled_label               string
    lead_time                       int             0
    arrival_date                    date
    event_date                      date
    stays_in_weekend_nights         int             0
    stays_in_week_nights            int             0
    total_nights                    int             0
    adults                          int             0
    children                        int             0
    babies                          int             0
    total_guests                    int             0
    meal                            string
    meal_name                       string
    country_code                    string
    country_name                    string
    market_segment                  string
    market_segment_name             string
    distribution_channel            string
    is_repeated_guest               int             0
    is_repeated_guest_label         string
    previous_cancellations          int             0
    previous_bookings_not_canceled  int             0
    reserved_room_type              string
    assigned_room_type              string
    room_type_changed               int             0
    booking_changes                 int             0
    deposit_type                    string
    deposit_type_name               string
    days_in_waiting_list            int             0
    customer_type                   string
    customer_type_name              string
    adr                             decimal(10,2)   0.00
    required_car_parking_spaces     int             0
    total_of_special_requests       int             0
    reservation_status              string
    reservation_status_date         date
    is_deleted                      int             0
"""

_contract_rows = [line.split() for line in _CONTRACT.strip().splitlines()]
CONTRACT_TYPES: dict[str, str] = {row[0]: row[1] for row in _contract_rows}
CONTRACT_DEFAULTS: dict[str, str] = {row[0]: row[2] for row in _contract_rows if len(row) == 3}
CONTRACT_COLUMNS = list(CONTRACT_TYPES)
CONTRACT_SCHEMA = struct(", ".join(f"{name} {kind}" for name, kind in CONTRACT_TYPES.items()))
DATE_COLUMNS = [name for name, kind in CONTRACT_TYPES.items() if kind == "date"]

INT_COLUMNS = """
    is_canceled lead_time stays_in_weekend_nights stays_in_week_nights adults children babies
    is_repeated_guest previous_cancellations previous_bookings_not_canceled booking_changes
    days_in_waiting_list required_car_parking_spaces total_of_special_requests
""".split()

# ---------------------------------------------------------------------------
# Replacements for missing codes, labels per code, text read as missing.
# ---------------------------------------------------------------------------
UNKNOWN = "未知"
MISSING_CODE = {
    "meal": "Undefined",
    "country": UNKNOWN,
    "market_segment": "Undefined",
    "distribution_channel": "Undefined",
    "reserved_room_type": UNKNOWN,
    "assigned_room_type": UNKNOWN,
    "deposit_type": "No Deposit",
    "customer_type": "Transient",
}

HOTEL_LABELS = {"Resort Hotel": "度假酒店", "City Hotel": "城市酒店"}
COUNTRY_LABELS = {
    "PRT": "葡萄牙", "GBR": "英国", "FRA": "法国", "ESP": "西班牙", "DEU": "德国", "ITA": "意大利",
    "IRL": "爱尔兰", "BRA": "巴西", "USA": "美国", "CN": "中国", "CHN": "中国",
}
SEGMENT_LABELS = {
    "Direct": "直接预订", "Corporate": "企业客户", "Online TA": "线上旅行社", "Offline TA/TO": "线下旅行社/批发商",
    "Groups": "团队", "Complementary": "免费订单", "Aviation": "航空客户", "Undefined": "未知",
}
DEPOSIT_LABELS = {"No Deposit": "无订金", "Non Refund": "不可退订金", "Refundable": "可退订金"}
CUSTOMER_LABELS = {"Transient": "散客", "Transient-Party": "散客团体", "Contract": "合约客户", "Group": "团队客户"}
MEAL_LABELS = {"BB": "含早餐", "HB": "半餐", "FB": "全餐", "SC": "不含餐", "Undefined": "未知"}
CANCELED_LABELS = {0: "未取消", 1: "已取消"}
REPEATED_GUEST_LABELS = {0: "新客户", 1: "回头客"}

WORLD_MAP_NAMES = {
    "AGO": "Angola", "ARG": "Argentina", "AUS": "Australia", "AUT": "Austria", "BEL": "Belgium",
    "BRA": "Brazil", "CAN": "Canada", "CHE": "Switzerland", "CHN": "China", "CN": "China",
    "DEU": "Germany", "ESP": "Spain", "FRA": "France", "GBR": "United Kingdom", "IRL": "Ireland",
    "ITA": "Italy", "JPN": "Japan", "KOR": "South Korea", "NLD": "Netherlands", "POL": "Poland",
    "PRT": "Portugal", "RUS": "Russia", "SWE": "Sweden", "USA": "United States", "ZAF": "South Africa",
}

# Text that CSV readers conventionally take as a missing value.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---------------------------------------------------------------------------
# Named projections.
# ---------------------------------------------------------------------------
LIST_COLUMNS = """
    booking_id hotel hotel_name is_canceled is_canceled_label arrival_date country_code country_name
    market_segment market_segment_name customer_type customer_type_name lead_time total_guests total_nights adr
""".split()
DETAIL_COLUMNS = """
    booking_id hotel_name is_canceled_label lead_time arrival_date total_nights total_guests meal_name
    country_name market_segment_name distribution_channel is_repeated_guest_label previous_cancellations
    previous_bookings_not_canceled reserved_room_type assigned_room_type room_type_changed booking_changes
    deposit_type_name days_in_waiting_list customer_type_name adr required_car_parking_spaces
    total_of_special_requests reservation_status reservation_status_date
""".split()
SAMPLE_COLUMNS = "booking_id hotel_name country_name lead_time adr is_canceled_label".split()
CANDIDATE_COLUMNS = "booking_id hotel_name arrival_date country_name lead_time adr customer_type_name".split()
EVENT_COLUMNS = """
    booking_id hotel hotel_name country_code country_name market_segment customer_type lead_time adr
    total_guests total_nights previous_cancellations total_of_special_requests
""".split()
EDITABLE_COLUMNS = "customer_type market_segment deposit_type adr total_of_special_requests".split()

# ---------------------------------------------------------------------------
# Model features.
# ---------------------------------------------------------------------------
CATEGORICAL_FEATURES = """
    hotel meal country_code market_segment distribution_channel reserved_room_type assigned_room_type
    deposit_type customer_type
""".split()
NUMERIC_FEATURES = """
    lead_time total_nights adults children babies total_guests is_repeated_guest previous_cancellations
    previous_bookings_not_canceled room_type_changed booking_changes days_in_waiting_list adr
    required_car_parking_spaces total_of_special_requests
""".split()
LABEL = "is_canceled"

# ---------------------------------------------------------------------------
# Stream and result tables.
# ---------------------------------------------------------------------------
# Fields of events, predictions and metrics.
EVENT_SCHEMA = struct(
    "booking_id bigint, hotel string, hotel_name string, country_code string, country_name string, "
    "market_segment string, customer_type string, lead_time int, adr double, total_guests int, total_nights int, "
    "previous_cancellations int, total_of_special_requests int, business_time string, generated_at string"
)
PREDICTION_SCHEMA = struct(
    "prediction_id bigint, booking_id bigint, model_version string, cancel_probability decimal(6,4), "
    "predicted_label int, risk_level string, source string, predicted_at timestamp"
)
METRIC_SCHEMA = struct(
    "metric_type string, metric_name string, metric_value string, window_start timestamp, "
    "window_end timestamp, updated_at timestamp"
)

# The metric names each metric type may hold, where that list is closed.
SUMMARY_METRICS = ["processed_count", "high_risk_count", "average_cancel_probability", "predicted_cancellations"]
TREND_METRICS = ["inflow", "predicted_cancellations", "cancel_rate"]
METRIC_TYPES = ["summary", "trend", "trend_day", "trend_week", "trend_month", "country_risk", "channel_risk"]
# The name of the stream among the sources, and the rows of the offline side in the published split.
STREAM_SOURCE = "storm"
DEFAULT_OFFLINE_ROWS = 80008
