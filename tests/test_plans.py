"""Plans: what reaches the scan, what is shuffled, and that no Python runs in the data path."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from staylens import plans
from staylens.operators import bookings as B
from staylens.operators import metrics as M
from staylens.operators import overview as O
from staylens.operators import predictions as P
from staylens.operators import splits as L
from staylens.plans import tables as D
from staylens.session import fresh_dir
from staylens.sources import files
from staylens.streaming import jobs as J

# Keys whose callable does work of its own (files, streams, fits) before it returns a frame.
EAGER = ("stream_", "sink_", "scan_", "train_", "score_", "ml_", "export_", "rewrite_", "category_encoding", "paginate_deep",
         "assign_dense_id", "clean_bookings")


def plan(df):
    """The formatted plan: the tree first, then the full details of each node."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def tree(df):
    return plan(df).split("\n\n(1)")[0]


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    path = fresh_dir(spark, "plan-bookings")
    files.write_lookup_table(D.bookings(spark, sf_dir), path)
    return files.read_lookup_table(spark, path)


def test_no_python_and_no_cross_join_in_any_lazy_query(spark, sf_dir):
    for key, build in plans.queries().items():
        if not key.startswith(EAGER):
            text = plan(build(spark, sf_dir))
            assert "Python" not in text and "ArrowEval" not in text, key
            assert "CartesianProduct" not in text and "NestedLoop" not in text, key


def test_lookups_leave_the_bookings_in_their_buckets(spark, stored):
    """Ids over the whole range: few ids skip the buckets without any, many ids shuffle no booking."""
    ids = stored.select("booking_id").orderBy("booking_id").collect()
    few = spark.createDataFrame([ids[0], ids[len(ids) // 2], ids[-1]], "booking_id bigint")
    known = J.known_bookings(few, stored)
    chosen, all_buckets = map(int, re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", plan(known)).groups())
    assert (chosen <= 3, all_buckets) == (True, files.LOOKUP_BUCKETS)
    assert sorted(known.select("booking_id").collect()) == sorted(few.collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        many = stored.select((F.col("booking_id") + 1).alias("booking_id")).union(stored.select("booking_id").where("booking_id % 3 = 0"))
        text = tree(J.known_bookings(many.repartition(3), stored))
        scan = text[text.index("SortMergeJoin") :].splitlines()
        left = scan[1 : next(i for i, line in enumerate(scan) if "Exchange" in line)]
        assert any("Scan parquet" in line for line in left), "no exchange above the scan of the bookings"
        assert "Bucketed: true" in plan(J.known_bookings(many.repartition(3), stored))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(O.channel_ranking(B.filter_overview(stored, month="1998-02", country_code="PRT")))
    pushed = re.search(r"PushedFilters: \[(.*?)\]\n", text).group(1)
    for part in ("arrival_date,1998-02-01", "arrival_date,1998-03-01", "country_code,PRT", "is_deleted"):
        assert part in pushed
    columns = re.search(r"ReadSchema: struct<(.*?)>\n", text).group(1)
    assert {c.split(":")[0] for c in columns.split(",") if ":" in c} == {
        "is_canceled", "arrival_date", "country_code", "market_segment", "market_segment_name", "is_deleted"}


def test_month_folders_are_pruned(spark, sf_dir):
    path = fresh_dir(spark, "plan-months")
    files.write_bookings_table(D.bookings(spark, sf_dir), path)
    text = plan(files.read_bookings_table(spark, path).where("arrival_month = '1998-02'"))
    assert re.search(r"PartitionFilters: \[[^\]]*1998-02", text)
    stored_table = files.read_bookings_table(spark, path)
    for rows in (
        B.filter_overview(stored_table, month="1998-02"),
        L.offline_side(stored_table, "1998-02-10"),
        L.realtime_side(stored_table, "1998-02-11"),
    ):
        assert re.search(r"PartitionFilters: \[[^\]]*1998-02", plan(rows))


def test_pages_are_top_k(stored):
    text = plan(B.paginate(B.active_bookings(stored), page=3))
    assert "TakeOrderedAndProject" in text and "Exchange rangepartitioning" not in text


def test_recent_predictions_shuffle_neither_table(spark, sf_dir, stored):
    text = plan(P.recent(D.predictions(spark, sf_dir), stored))
    assert "SortMergeJoin" not in text and "hashpartitioning(booking_id" not in text


def test_sections_read_the_table_once_and_multiply_only_cells(stored):
    lines = tree(O.sections(B.active_bookings(stored))).splitlines()
    assert sum("Scan" in line for line in lines) == 1
    expand = next(i for i, line in enumerate(lines) if "Expand" in line)
    assert sum("HashAggregate" in line for line in lines[expand:]) == 2  # the cells, partial and final


def test_windows_over_rows_are_partitioned(stored):
    """Only tables with one row per class, bucket or partition may be ordered as a whole."""
    assert "SinglePartition" not in plan(L.exact_test_part(stored.select("booking_id", "is_canceled")))


def test_unused_line_join_is_dropped(spark, sf_dir):
    assert "lineitem" not in plan(D.bookings(spark, sf_dir).groupBy("market_segment").count())


def test_top_rows_are_cut_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 3 as dimension", "cast(id as string) as name", "id / 7 as rate",
                                        "id as booking_count", "id as predicted_cancellations")
    shown = tree(M.top_risk(rows))
    assert shown.rindex("WindowGroupLimit") > shown.index("Exchange")
    assert M.top_risk(rows).count() == 15


def test_recent_rows_filter_the_bookings_without_a_shuffle(spark, sf_dir, stored):
    assert "SortMergeJoin" not in tree(P.recent(D.predictions(spark, sf_dir), stored))
