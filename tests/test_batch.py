"""Batch operators on small literal tables, against plain Python."""

import datetime as dt
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from staylens import schemas as S
from staylens import session
from staylens.operators import bookings as B
from staylens.operators import cleaning as C
from staylens.operators import edits as E
from staylens.operators import joins
from staylens.operators import metrics as M
from staylens.operators import overview as O
from staylens.operators import predictions as P
from staylens.operators import series as R
from staylens.operators import splits as L
from staylens.plans import cleaning_queries
from staylens.session import fresh_dir, stored
from staylens.sources import files, versions

RAW = {
    "hotel": "City Hotel", "is_canceled": "0", "lead_time": "12", "arrival_date_year": "2017", "arrival_date_month": "March",
    "arrival_date_day_of_month": "9", "stays_in_weekend_nights": "1", "stays_in_week_nights": "2", "adults": "2",
    "children": "1", "babies": "0", "meal": "HB", "country": "ESP", "market_segment": "Aviation",
    "distribution_channel": "GDS", "is_repeated_guest": "1", "previous_cancellations": "0",
    "previous_bookings_not_canceled": "4", "reserved_room_type": "D", "assigned_room_type": "D", "booking_changes": "0",
    "deposit_type": "Refundable", "days_in_waiting_list": "0", "customer_type": "Contract", "adr": "75.5",
    "required_car_parking_spaces": "1", "total_of_special_requests": "2", "reservation_status": "Check-Out",
    "reservation_status_date": "2017-03-12",
}


def raw_rows(spark, *changes):
    rows = [(n, *({**RAW, **change}[name] for name in S.RAW_COLUMNS)) for n, change in enumerate(changes)]
    return spark.createDataFrame(rows, "pos int, " + ", ".join(f"{name} string" for name in S.RAW_COLUMNS))


def booking_rows(spark, *changes):
    """Cleaned rows with ids from 1; `is_deleted` and date overrides apply after cleaning."""
    raw_changes = [{k: v for k, v in change.items() if k in RAW} for change in changes]
    cleaned = C.clean_bookings(raw_rows(spark, *raw_changes), F.col("pos") + 1)
    deleted = [n + 1 for n, change in enumerate(changes) if change.get("is_deleted")]
    return cleaned.withColumn("is_deleted", F.when(F.col("booking_id").isin(deleted or [0]), 1).otherwise(0))


def test_cleaning_of_missing_and_unknown_values(spark):
    raw = raw_rows(
        spark,
        {"children": None, "adr": None, "country": None, "assigned_room_type": None, "meal": None, "customer_type": None},
        {"assigned_room_type": "A", "is_canceled": "1", "country": "XYZ", "hotel": "Lodge", "is_repeated_guest": "2"},
    )
    first, second = C.clean_bookings(raw, F.col("pos") + 1).orderBy("booking_id").collect()
    assert list(first.asDict()) == S.CONTRACT_COLUMNS
    assert (first.children, float(first.adr), first.total_guests, first.total_nights) == (0, 0.0, 2, 3)
    assert (first.country_code, first.country_name, first.assigned_room_type) == ("未知", "未知", "未知")
    assert (first.meal, first.meal_name, first.customer_type, first.customer_type_name) == ("Undefined", "未知", "Transient", "散客")
    assert (first.room_type_changed, first.is_canceled_label, first.is_repeated_guest_label) == (1, "未取消", "回头客")
    assert (first.market_segment_name, first.deposit_type_name) == ("航空客户", "可退订金")
    assert first.arrival_date == first.event_date == dt.date(2017, 3, 9)
    assert (second.room_type_changed, second.is_canceled_label, second.hotel_name) == (1, "已取消", "Lodge")
    assert (second.country_name, second.is_repeated_guest, second.is_repeated_guest_label) == ("XYZ", 2, None)


def test_rejected_rows_and_strict_mode(spark):
    raw = raw_rows(spark, {}, {"arrival_date_day_of_month": "32"}, {"reservation_status_date": "soon"})
    cleaned = C.clean_bookings(raw, F.col("pos") + 1)
    assert sorted(r.booking_id for r in C.rejected_rows(cleaned).collect()) == [2, 3]
    with pytest.raises(Exception):
        C.clean_bookings(raw, F.col("pos") + 1, strict=True).collect()


def test_file_order_gives_the_ids(spark):
    path = fresh_dir(spark, "ordered-csv")
    raw = raw_rows(spark, *({"lead_time": str(n)} for n in range(400)))
    files.write_raw_csv(raw.repartitionByRange(3, "pos").sortWithinPartitions("pos").drop("pos"), path)
    expected = [(n + 1, n) for n in range(400)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # several splits per file
    try:
        marked = files.read_raw_csv(spark, path, positions=True)
        assert marked.select("file_path", "split_start").distinct().count() > 6
        by_split = C.import_files(marked)
        assert sorted((r.booking_id, r.lead_time) for r in by_split.collect()) == expected
        by_sort = C.import_bookings(marked, *files.POSITION_COLUMNS)
        assert sorted((r.booking_id, r.lead_time) for r in by_sort.collect()) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_raw_files_grow_in_number_with_the_rows(spark, sf_dir, monkeypatch):
    """No task sorts more than about the rows of a file, however many there are."""
    written, write = [], files.write_raw_csv
    monkeypatch.setattr(files, "write_raw_csv", lambda raw, path: (write(raw, path), written.append(path)))
    monkeypatch.setattr(cleaning_queries, "ROWS_PER_FILE", 100)
    got = cleaning_queries.import_raw_files(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    sizes = [r["count"] for r in spark.read.csv(written[0], header=True).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == rows and max(sizes) <= 300
    assert sorted(r.booking_id for r in got.select("booking_id").collect()) == list(range(1, rows + 1))


def test_dense_position_with_a_hot_first_column(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("day"), "id")
    got = C.dense_position(rows.repartition(7), "day", "id").orderBy("day", "id").select("position").collect()
    assert [r.position for r in got] == list(range(1, 5001))


def test_file_positions_shuffle_no_rows(spark, monkeypatch):
    """Even where nothing is small enough to broadcast by its size; beyond the bound on splits the result is the same."""
    path = fresh_dir(spark, "ordered-csv")
    raw = raw_rows(spark, *({"lead_time": str(n)} for n in range(300)))
    files.write_raw_csv(raw.repartitionByRange(3, "pos").sortWithinPartitions("pos").drop("pos"), path)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        marked = files.read_raw_csv(spark, path, positions=True)
        numbered = C.import_files(marked)
        text = numbered._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text
        found = sorted((r.booking_id, r.lead_time) for r in numbered.collect())
        assert found == [(n + 1, n) for n in range(300)]
        monkeypatch.setattr(C, "BROADCAST_SPLITS", 2)
        assert sorted((r.booking_id, r.lead_time) for r in C.import_files(marked).collect()) == found
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_deep_pages_read_the_stored_ranges_of_their_rows(spark):
    table = spark.range(0, 300_000, 3).select(F.col("id").alias("booking_id")).repartition(8)
    ranges = stored(B.id_ranges(table, 500), "ranges")
    assert ranges.agg(F.sum("rows"), F.max(F.col("start") + F.col("rows"))).first() == (100_000, 100_000)
    for offset, count in ((0, 1), (499, 2), (50_000, 100), (99_950, 100), (100_000, 5)):
        page = B.slice_by_id(table, offset, count, 0, ranges)
        assert sorted(r.booking_id for r in page.collect()) == [3 * n for n in range(offset, min(offset + count, 100_000))]
    text = B.slice_by_id(table, 70_000, 100, 0, ranges)._jdf.queryExecution().optimizedPlan().toString()
    low, high = (int(n) for n in re.search(r">= (\d+)\).*?<= (\d+)\)", text).groups())
    assert (high - low) / 3 + 1 <= 0.012 * 100_000, "a page reads the rows of one or two ranges"


def test_edits_rewrite_only_their_months(spark):
    path = fresh_dir(spark, "months")
    table = booking_rows(spark, *({"arrival_date_month": month} for month in ("January", "March", "March", "July")), {"arrival_date_day_of_month": "32"})
    files.write_bookings_table(table, path)
    fs = versions._file_system(spark, path)

    def stamps():
        found, listed = {}, fs.listFiles(spark._jvm.org.apache.hadoop.fs.Path(path), True)
        while listed.hasNext():
            status = listed.next()
            if status.getPath().getName().startswith("part-"):
                found[status.getPath().toString()] = status.getModificationTime()
        return found

    before = stamps()
    ids = [r.booking_id for r in table.orderBy("booking_id").collect()]
    gone = spark.createDataFrame([(ids[1],), (-5,)], "booking_id bigint")
    assert files.rewrite_months(spark, path, gone, lambda rows: E.soft_delete(rows, gone)) == ["2017-03"]
    after = stamps()
    assert {name for name in before if before[name] != after.get(name)} == {name for name in before if "=2017-03" in name}
    assert {name for name in before if "=2017-03" not in name} == {name for name in after if "=2017-03" not in name}
    assert {r.booking_id: r.is_deleted for r in files.read_bookings_table(spark, path).collect()} == {i: int(i == ids[1]) for i in ids}
    dateless = spark.createDataFrame([(ids[4],)], "booking_id bigint")
    assert files.rewrite_months(spark, path, dateless, lambda rows: E.soft_delete(rows, dateless)) == [None]
    assert {r.booking_id: r.is_deleted for r in files.read_bookings_table(spark, path).collect()} == {i: int(i in (ids[1], ids[4])) for i in ids}
    assert files.rewrite_months(spark, path, spark.createDataFrame([(-5,)], "booking_id bigint"), lambda rows: rows) == []


def test_medians_of_continuous_columns_order_few_values(spark):
    """Histograms narrow a column until few values are left; medians stay exact, with hot values, nulls and outliers too."""
    rng = random.Random(7)
    columns = {
        "smooth": [rng.random() for _ in range(6_001)],
        "skewed": [10 ** rng.uniform(-9, 9) for _ in range(6_000)] + [None],
        "hot": [1.0] * 2_900 + [rng.random() * 5 for _ in range(3_101)],
        "gap": [rng.random() for _ in range(3_000)] + [1e12 + rng.random() for _ in range(3_000)] + [None],
        "empty": [None] * 6_001,
    }
    table = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{name} double" for name in columns)).repartition(7)
    exact = {name: statistics.median([v for v in values if v is not None]) for name, values in columns.items() if name != "empty"}
    for most in (100_000, 3, 1):
        got = {r.column_name: r.median for r in L.feature_stats(table, list(columns), most).collect()}
        assert got == exact
    counts = table.select(F.lit(0).alias("index"), F.col("smooth").alias("value"), F.lit(1).alias("n"))
    few = L._narrowed(L._narrowed(counts))
    assert few.count() <= 5 and few.agg(F.sum("n")).first()[0] == 6_001


def test_sketches_are_not_merged_in_one_task(spark):
    """A sketch per group of partitions; the bounds hold the median although each partition has other values."""
    table = spark.range(0, 20_000, 1, 100).select(F.col("id").cast("double").alias("x"))
    steps = L._profile(table, ["x"])._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("ObjectHashAggregate" in step and "percentile_approx" in step and "_part" in step for step in steps)
    row = L.feature_stats(table, ["x"]).first()
    assert (row.median, row.mean) == (9999.5, 9999.5) and row.deviation == pytest.approx(5773.502690)


def test_scratch_is_removed_on_demand(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(tmp_path))
    rows = stored(spark.range(5), "some")
    assert rows.count() == 5 and list(tmp_path.rglob("*.parquet"))
    session.remove_scratch(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_align_and_required_columns(spark):
    df = spark.createDataFrame([(1, "City Hotel")], "booking_id bigint, hotel string")
    row = C.align_to_contract(df).first()
    assert (row.lead_time, float(row.adr), row.meal, row.is_deleted) == (0, 0.0, None, 0)
    with pytest.raises(ValueError, match="arrival_date"):
        L.offline_side(df)


def test_filters_pages_and_deleted_rows(spark):
    df = booking_rows(
        spark, {}, {"hotel": "Resort Hotel"}, {"is_deleted": 1}, {"country": "PRT", "is_canceled": "1"}, {"country": None}
    )
    ids = lambda rows: [r.booking_id for r in rows.orderBy("booking_id").collect()]
    assert ids(B.filter_bookings(df, hotel="City Hotel")) == [1, 4, 5]
    assert ids(B.filter_bookings(df, is_canceled=0, hotel="")) == [1, 2, 5]
    assert ids(B.filter_bookings(df, keyword="prt")) == [4]
    assert ids(B.filter_bookings(df, keyword="葡萄")) == [4]
    assert ids(B.filter_bookings(df, keyword=".")) == []
    assert ids(B.filter_bookings(df, keyword="%")) == []
    assert ids(B.filter_overview(df, month="2017-03", risk_tag="lead_time_high")) == []
    assert ids(B.filter_overview(df, month="2017-03", risk_tag="unheard of")) == [1, 2, 4, 5]
    active = B.active_bookings(df)
    assert ids(B.paginate(active, page=2, size=3)) == [5]
    assert ids(B.paginate(active, page=0, size=1000)) == [1, 2, 4, 5]
    assert ids(B.paginate(active, page=2, size=3, top_k_rows=2)) == [5]
    twice = active.union(active)
    for start, count in ((0, 3), (1, 4), (2, 1), (3, 2), (6, 5), (8, 2)):
        expected = [1, 1, 2, 2, 4, 4, 5, 5][start:start + count]
        assert ids(B.slice_by_id(twice, start, count)) == ids(B.slice_by_id(twice, start, count, top_k_rows=0)) == expected
    assert ids(B.page_after(active, last_id=2, size=1)) == [4]
    assert tuple(B.page_totals(active, 3).first()) == (4, 2)
    assert tuple(B.page_totals(active.where("false"), 3).first()) == (0, 0)


def test_overview_of_an_empty_table(spark):
    none = booking_rows(spark, {}).where("false")
    assert tuple(O.summary(none).first()) == (0, 0, 0.0, 0.0)
    for section in (O.trend, O.cancel_structure, O.factor_rates, O.channel_ranking, O.country_rates, O.risk_tag_counts):
        assert section(none).count() == 0


def test_overview_sections_agree_with_the_single_queries(spark):
    df = booking_rows(
        spark, {}, {"is_canceled": "1", "lead_time": "200"}, {"is_canceled": "1", "total_of_special_requests": "0"},
        {"country": "PRT", "arrival_date_month": "April"}, {"country": None, "previous_cancellations": "3", "is_canceled": "2"},
    )
    rows = O.sections(df).collect()
    by_section = lambda name: sorted((r.name, r.booking_count, r.cancel_rate) for r in rows if r.section == name)
    assert by_section("trend") == sorted((r.period, r.booking_count, r.cancel_rate) for r in O.trend(df).collect())
    assert by_section("country_map") == sorted((r.name, r.booking_count, r.value) for r in O.country_rates(df).collect())
    assert by_section("channel_ranking") == sorted((r.name, r.booking_count, r.cancel_rate) for r in O.channel_ranking(df).collect())
    assert sum(n for _, n, _ in by_section("channel_ranking")) == O.summary(df).first().booking_count == 5
    assert sorted((r.name, r.booking_count) for r in rows if r.section == "risk_factor") == sorted(
        (r.name, r.value) for r in O.risk_tag_counts(df).collect())
    assert sum(r.value for r in O.cancel_structure(df).collect()) == 4  # the flag 2 has no label


def test_edits_change_only_editable_columns(spark):
    base = booking_rows(spark, {}, {}, {})
    edits = spark.createDataFrame(
        [(1, 1, "Group", 9.999, 1), (1, 2, "Transient", None, 1), (3, 1, None, 12.5, None), (77, 1, "Group", None, None)],
        "booking_id bigint, seq int, customer_type string, adr double, is_canceled int")
    rows = E.apply_edits(base, edits, sequence="seq").orderBy("booking_id").collect()
    assert [(r.customer_type, r.customer_type_name, float(r.adr), r.is_canceled) for r in rows] == [
        ("Transient", "散客", 75.5, 0), ("Contract", "合约客户", 75.5, 0), ("Contract", "合约客户", 12.5, 0)]
    kept = E.apply_edits(base, edits, sequence="seq", relabel=False).orderBy("booking_id").first()
    assert (kept.customer_type, kept.customer_type_name) == ("Transient", "合约客户")
    assert tuple(E.edit_counts(base, edits).first()) == (2, 1)


def test_upsert_twice_changes_nothing(spark):
    base = booking_rows(spark, {}, {}, {})
    new = booking_rows(spark, {"adr": "1"}, {"adr": "2"}).withColumn("booking_id", F.col("booking_id") + 2)
    once = E.upsert_by_key(base, new)
    twice = E.upsert_by_key(once, new)
    key = lambda df: sorted((r.booking_id, float(r.adr)) for r in df.collect())
    assert key(once) == key(twice) == [(1, 75.5), (2, 75.5), (3, 1.0), (4, 2.0)]


def test_table_versions(spark):
    path = fresh_dir(spark, "versions")
    one = spark.range(3)
    assert versions.read_version(spark, path, one.schema).count() == 0
    assert versions.replace_table(one, path) == 0
    current = versions.read_version(spark, path, one.schema)
    assert versions.replace_table(current.where("id > 0"), path) == 1
    assert versions.read_version(spark, path, one.schema).count() == 2
    assert versions.read_version(spark, path, one.schema, before=1).count() == 3
    versions.write_version(one, path, 2, keep=2)
    assert versions.complete_versions(spark, path) == [1, 2]


def test_published_confusion_matrices(spark):
    # The published matrices and what they must yield.
    published = [
        ((9468, 754, 937, 4843), (0.8943, 0.8653, 0.8379, 0.8514)),
        ((8654, 1568, 1124, 4656), (0.8318, 0.7481, 0.8055, 0.7757)),
    ]
    names = ["true_negative", "false_positive", "false_negative", "true_positive"]
    for cells, expected in published:
        assert tuple(P.quality(spark.createDataFrame([cells], names)).first()) == expected
    assert tuple(P.quality(spark.createDataFrame([(5, 0, 0, 0)], names)).first()) == (1.0, 0.0, 0.0, 0.0)
    cells = R.matrix_series(spark.createDataFrame([published[0][0]], names)).collect()
    assert {(r.x, r.y): r["count"] for r in cells} == {(0, 0): 9468, (1, 0): 754, (0, 1): 937, (1, 1): 4843}
    assert cells[0].scale_max == 9468


def test_best_model_prefers_f1_then_accuracy(spark):
    rows = [("a", 0.8, 0.7), ("b", 0.9, 0.7), ("c", 0.99, 0.6)]
    assert P.best_model(spark.createDataFrame(rows, "model_name string, accuracy double, f1_score double")).first()[0] == "b"


def test_date_split_boundaries(spark):
    days = ["2017-01-11", "2017-01-12 23:59:00", "2017-01-13 00:00:01", None]
    df = spark.createDataFrame([(d,) for d in days], "t string").select(F.col("t").cast("timestamp").alias("arrival_date"))
    assert tuple(L.split_counts(df).first()) == (2, 1, 4)


def test_exact_split_takes_a_fifth_of_each_class(spark):
    df = spark.range(1, 1004).select(F.col("id").alias("booking_id"), (F.col("id") % 3 == 0).cast("int").alias("is_canceled"))
    got = L.exact_test_part(df).groupBy("is_canceled").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert {r.is_canceled: (r.n, r.t) for r in got} == {0: (669, 134), 1: (334, 67)}


@pytest.mark.parametrize("rows", [1, 2, 999, 1000])
def test_exact_medians(spark, rows):
    chooser = random.Random(rows)
    values = [chooser.choice([0, 0, 0, chooser.randint(0, 10**6)]) for _ in range(rows)]
    df = spark.createDataFrame([(v, -v / 4) for v in values], "a int, b double")
    got = {r.column_name: r for r in L.feature_stats(df, ["a", "b"]).collect()}
    assert got["a"].median == statistics.median(values)
    assert got["b"].median == statistics.median([-v / 4 for v in values])
    assert got["a"].mean == pytest.approx(statistics.fmean(values))
    assert got["a"].deviation == pytest.approx(statistics.pstdev(values))


def test_modes_prefer_the_smallest_among_equals(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("c", "x"), ("b", "y"), ("a", "y")], "u string, v string")
    assert {r.column_name: (r["mode"], r.row_count) for r in L.category_modes(df, ["u", "v"]).collect()} == {
        "u": ("a", 2), "v": ("y", 2)}


def test_join_with_a_hot_key_is_whole(spark):
    many = spark.range(9000).select(
        F.when(F.col("id") < 4000, 7).when(F.col("id") < 4100, None).otherwise(F.col("id") % 3000).alias("k"), "id")
    one = spark.range(0, 2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("double"))
    for how in ("left", "inner"):
        got = joins.join_unique(many, one, "k", how).select("id", "k", "double")
        expected = many.join(one, "k", how).select("id", "k", "double")
        assert got.count() == expected.count()
        assert got.exceptAll(expected).count() == 0


def test_join_without_a_hot_key_is_one_join(spark):
    many, one = spark.range(9000).withColumnRenamed("id", "k"), spark.range(0, 2500).withColumnRenamed("id", "k")
    joined = joins.join_unique(many, one, "k", "left")
    assert "Union" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 9000


def test_serving_order(spark):
    snapshot = spark.createDataFrame([("12", 3, 0.25, "2017-02-01 00:00:00")],
                                     "realtime_processed_count string, high_risk_count int, avg_cancel_probability double, updated_at string")
    metrics = spark.createDataFrame(
        [("summary", "processed_count", "7", 1), ("summary", "processed_count", "5", 0), ("trend", "inflow", "7", 1)],
        "metric_type string, metric_name string, metric_value string, h int",
    ).selectExpr("metric_type", "metric_name", "metric_value", "timestamp'2017-01-13 00:00:00' + make_interval(0,0,0,0,h) AS window_start",
                 "timestamp'2017-01-13 01:00:00' + make_interval(0,0,0,0,h) AS window_end", "timestamp'2017-01-13 02:00:00' AS updated_at")
    offline = spark.createDataFrame([(0,)], "offline_rows bigint")
    total = lambda s, m: M.dashboard_totals(offline, M.serve_summary(s, m)).first()
    none = lambda df: df.where("false")
    fresh, stored, waiting = total(snapshot, metrics), total(none(snapshot), metrics), total(none(snapshot), none(metrics))
    assert (fresh.total_bookings, fresh.status, fresh.average_cancel_probability) == (80020, "running", 0.25)
    assert (stored.total_bookings, stored.status) == (80015, "mysql_fallback")
    assert (waiting.total_bookings, waiting.status, waiting.updated_at) == (80008, "waiting", None)
    empty = spark.createDataFrame([], "day array<struct<label:string,inflow:int>>, week array<struct<label:string,inflow:int>>")
    points = M.serve_trend(empty, metrics, "week").collect()
    assert [(p.label, p.inflow, p.source) for p in points] == [("2017-01-13 01:00:00", 7, "mysql")]


def test_batch_of_one_day(spark):
    rows = [(n, n, "m", p, int(p >= 0.5), "high" if p >= 0.6 else "low", "storm", f"2017-01-13 0{n}:30:00") for n, p in
            enumerate([0.9, 0.2, 0.55, 0.1])]
    df = spark.createDataFrame(rows, "prediction_id bigint, booking_id bigint, model_version string, p double, "
                                     "predicted_label int, risk_level string, source string, at string")
    df = df.withColumns({"cancel_probability": F.col("p").cast("decimal(6,4)"), "predicted_at": F.col("at").cast("timestamp")})
    row = P.daily_batches(df).first()
    assert tuple(row) == ("storm-2017-01-13", "2017-01-13", "00:30:00-03:30:00", 4, 2, 1, 0.4375, "storm", "2017-01-13 03:30:00")


def test_a_summary_without_snapshot_or_metric_waits(spark):
    snapshot = spark.createDataFrame(
        [], "processed_count bigint, high_risk_count bigint, average_cancel_probability double, updated_at string")
    row = M.serve_summary(snapshot, spark.createDataFrame([], S.METRIC_SCHEMA)).first()
    assert row.asDict() == {"processed_count": 0, "high_risk_count": 0, "average_cancel_probability": 0.0,
                            "updated_at": None, "status": "waiting", "source": "none"}
