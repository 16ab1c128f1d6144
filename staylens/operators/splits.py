"""Date split, hash split and the statistics the training starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from staylens import schemas as S
from staylens.operators.bookings import slice_by_id
from staylens.operators.cleaning import require_columns
from staylens.session import stored

# The published date boundary.
OFFLINE_CUTOFF, REALTIME_START = "2017-01-12", "2017-01-13"

# Different values of a column that are put in order in one task, and bins of the histograms that narrow them down to that.
ORDERED_VALUES = 100_000
HISTOGRAM_BINS = 4_096
# Sketches of a column, each of the rows of some partitions; one task would merge those of all partitions.
SKETCHES = 64


def _on_or_before(day: str) -> Column:
    return F.to_date("arrival_date") <= F.lit(day).cast("date")


def _on_or_after(day: str) -> Column:
    return F.to_date("arrival_date") >= F.lit(day).cast("date")


def offline_side(df: DataFrame, cutoff: str = OFFLINE_CUTOFF) -> DataFrame:
    """Rows for training. A missing date belongs to neither side."""
    return _in_folders(require_columns(df, ["arrival_date"]), "<=", cutoff).where(_on_or_before(cutoff))


def realtime_side(df: DataFrame, start: str = REALTIME_START) -> DataFrame:
    """Rows that arrive as events."""
    return _in_folders(require_columns(df, ["arrival_date"]), ">=", start).where(_on_or_after(start))


def _in_folders(df: DataFrame, comparison: str, day: str) -> DataFrame:
    """The bound that a day implies for the month folders, where the table has them."""
    return df.where(f"arrival_month {comparison} '{day[:7]}'") if "arrival_month" in df.columns else df


def split_counts(df: DataFrame, cutoff: str = OFFLINE_CUTOFF, start: str = REALTIME_START) -> DataFrame:
    return require_columns(df, ["arrival_date"]).agg(
        F.count_if(_on_or_before(cutoff)).alias("offline_rows"),
        F.count_if(_on_or_after(start)).alias("realtime_rows"),
        F.count("*").alias("total_rows"),
    )


def event_slice(
    df: DataFrame, start: int, count: int, first_day: str = REALTIME_START, ranges: DataFrame | None = None
) -> DataFrame:
    """`count` realtime rows from position `start`, in id order, with the event fields; `ranges` are their stored `id_ranges`."""
    return as_events(slice_by_id(realtime_side(df, first_day), start, count, ranges=ranges))


def as_events(df: DataFrame) -> DataFrame:
    """The event fields of bookings, with the business day."""
    return df.select(*S.EVENT_COLUMNS, F.date_format("event_date", "yyyy-MM-dd").alias("business_time"))


def in_test_part(key: str = "booking_id", share: float = 0.2, seed: int = 42) -> Column:
    """A stable pseudo-random condition on the key that holds for about `share` of the rows.

    It needs no shuffle, gives the same answer on every run, and splits every class in the same
    proportion up to chance. The first four hex digits of the hash are compared as text.
    """
    bound = format(round(share * 0x10000), "04x")
    return F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 4) < bound


def exact_test_part(df: DataFrame, share: float = 0.2, seed: int = 42, key: str = "booking_id", label: str = S.LABEL) -> DataFrame:
    """Add `is_test`: per class, exactly the `share` of rows with the lowest hashes, rounded up.

    The hash that cuts a class is found by counting hashes in 65,536 buckets per class, which
    combine map side; only the bucket that the cut falls into is ranked row by row. So no task
    ever holds a class. The cuts, a row per class, are found once and stored.
    """
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    hashed = df.withColumn("_hash", digest).withColumn("_bucket", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))
    counts = hashed.groupBy(label, "_bucket").agg(F.count("*").alias("_rows"))
    by_bucket = Window.partitionBy(label).orderBy("_bucket")
    cuts = (
        counts.withColumn("_through", F.sum("_rows").over(by_bucket))
        .withColumn("_wanted", F.ceil(F.sum("_rows").over(Window.partitionBy(label)) * F.lit(share)))
        .where((F.col("_through") >= F.col("_wanted")) & (F.col("_through") - F.col("_rows") < F.col("_wanted")))
        .select(F.col(label).alias("_label"), F.col("_bucket").alias("_cut"),
                (F.col("_wanted") - (F.col("_through") - F.col("_rows"))).alias("_take"))
    )
    cuts = stored(cuts, "class-cuts")
    joined = hashed.join(F.broadcast(cuts), F.col(label) == F.col("_label"))
    on_cut = F.col("_bucket") == F.col("_cut")
    edge = joined.where(on_cut).withColumn(
        "is_test", F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_hash", key)) <= F.col("_take")
    )
    clear = joined.where(~on_cut).withColumn("is_test", F.col("_bucket") < F.col("_cut"))
    return clear.unionByName(edge).select(*df.columns, "is_test")


def class_weights(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """Rows and balanced weight per class, and whether a stratified split is possible."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("class_rows"))
    totals = counts.agg(
        F.struct(F.sum("class_rows").alias("n"), F.count("*").alias("classes"), F.min("class_rows").alias("smallest"))
    )
    t = counts.withColumn("t", totals.scalar())
    return t.select(
        "label",
        "class_rows",
        (F.col("t.n") / (F.col("t.classes") * F.col("class_rows"))).alias("weight"),
        ((F.col("t.classes") > 1) & (F.col("t.smallest") >= 2)).alias("can_stratify"),
    )


def _long(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    pairs = [F.struct(F.lit(name).alias("column_name"), F.col(name).cast(kind).alias("value")) for name in columns]
    return df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def _profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with an array: per numeric column, bounds that enclose the median, mean and population deviation.

    The rows of some partitions have a sketch of their own, whose bounds enclose their median. The median of
    all rows lies between the smallest and the largest of these medians, however the rows are dealt, so the
    outermost bounds enclose it.
    """
    values = {name: F.col(name).cast("double") for name in columns}
    part = F.pmod(F.spark_partition_id(), F.lit(SKETCHES))
    sketches = df.withColumn("_part", part).groupBy("_part").agg(
        F.array(*(F.percentile_approx(value, [0.499, 0.501], 10_000) for value in values.values())).alias("bounds")
    )
    bound = lambda index, end: F.col("bounds")[index][end]
    bounds = sketches.agg(
        F.array(*(F.struct(F.min(bound(i, 0)).alias("lo"), F.max(bound(i, 1)).alias("hi")) for i in range(len(columns)))).alias("bounds")
    )
    moments = df.agg(
        F.array(
            *(
                F.struct(F.lit(name).alias("column_name"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
                for name, value in values.items()
            )
        ).alias("moments")
    )
    measure = lambda moment, ends: F.struct(moment["column_name"], ends["lo"], ends["hi"], moment["mean"], moment["deviation"])
    return moments.withColumn("bounds", bounds.scalar()).select(F.zip_with("moments", "bounds", measure).alias("profile"))


def _narrowed(counts: DataFrame) -> DataFrame:
    """`counts` (index, value, n) with the same rows, all of them -inf or inf but those near the median of their column.

    The finite values of a column are counted in HISTOGRAM_BINS bins of equal width; those in the bins of the
    two middle ranks stay. The tables joined have a row per bin at most.
    """
    is_finite = F.abs("value") < float("inf")
    bounds = counts.where(is_finite).groupBy("index").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    share = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))  # null where all values are one
    inside = F.coalesce(F.least(F.floor(share * HISTOGRAM_BINS), F.lit(HISTOGRAM_BINS - 1)), F.lit(0))
    place = F.when(is_finite, inside).when(F.col("value") < 0, F.lit(-1)).otherwise(F.lit(HISTOGRAM_BINS))
    binned = counts.join(F.broadcast(bounds), "index", "left").withColumn("bin", place.cast("int")).drop("lo", "hi")
    upto = Window.partitionBy("index").orderBy("bin")
    bins = binned.groupBy("index", "bin").agg(F.sum("n").alias("rows")).withColumns(
        {"upto": F.sum("rows").over(upto), "total": F.sum("rows").over(Window.partitionBy("index"))}
    )
    at_rank = lambda rank: F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("rows") < rank), F.col("bin")))
    lower, upper = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    middle = bins.groupBy("index").agg(at_rank(lower).alias("first"), at_rank(upper).alias("last"))
    value = (
        F.when(F.col("bin") < F.col("first"), F.lit(float("-inf")))
        .when(F.col("bin") > F.col("last"), F.lit(float("inf")))
        .otherwise(F.col("value"))
    )
    narrowed = binned.join(F.broadcast(middle), "index").select("index", value.alias("value"), "n")
    return narrowed.groupBy("index", "value").agg(F.sum("n").alias("n"))


def feature_stats(df: DataFrame, columns: list[str] = S.NUMERIC_FEATURES, most: int = ORDERED_VALUES) -> DataFrame:
    """Exact median, mean and population deviation per numeric feature.

    No task holds a column's values: sketches enclose the median between two values (their rank
    error is a tenth of the margin), and a second pass counts the rows below and above them and
    the rows per value between. While these are more than `most` different values of a column, a
    histogram of them narrows the bounds. Only the values left are then put in order.
    """
    profile = stored(_profile(df, columns), "profile").scalar()
    places = []
    for index, name in enumerate(columns):
        value, bounds = F.col(name).cast("double"), F.col("_profile")[index]
        place = (
            F.when(value < bounds["lo"], F.lit(float("-inf"))).when(value > bounds["hi"], F.lit(float("inf"))).otherwise(value)
        )
        places.append(F.struct(F.lit(index).alias("index"), place.alias("value")))
    counts = (
        df.select(profile.alias("_profile"), *columns)
        .select(F.inline(F.array(*places)))
        .where(F.col("value").isNotNull())
        .groupBy("index", "value")
        .agg(F.count("*").alias("n"))
    )
    counts = stored(counts, "value-counts")
    largest = lambda: counts.groupBy("index").count().agg(F.max("count")).first()[0] or 0
    size, before = largest(), None
    while size > most and size != before:  # values that lie too close for a bin stay as they are
        counts = stored(_narrowed(counts), "value-counts")
        size, before = largest(), size
    through = Window.partitionBy("index").orderBy("value")
    ranked = counts.withColumns(
        {"upto": F.sum("n").over(through), "total": F.sum("n").over(Window.partitionBy("index"))}
    )
    at_rank = lambda rank: F.max(
        F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank), F.col("value"))
    )
    lower, upper = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    of_column = F.element_at(profile, F.col("index") + 1)
    return ranked.groupBy("index").agg(
        ((at_rank(lower) + at_rank(upper)) / 2).alias("median"), F.any_value(of_column).alias("own")
    ).select("own.column_name", "median", "own.mean", "own.deviation")


def category_counts(df: DataFrame, columns: list[str] = S.CATEGORICAL_FEATURES) -> DataFrame:
    """(column_name, value, n): rows per value of each categorical feature, missing ones left out; one pass."""
    return _long(df, columns, "string").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def category_profile(counts: DataFrame) -> DataFrame:
    """Per column of `category_counts` the most frequent value, the smallest among equals, its rows and the number of values."""
    return counts.groupBy("column_name").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
        F.max("n").alias("row_count"),
        F.count("*").alias("n_values"),
    )


def category_modes(df: DataFrame, columns: list[str] = S.CATEGORICAL_FEATURES) -> DataFrame:
    """Most frequent value per categorical feature, and its rows."""
    return category_profile(category_counts(df, columns)).drop("n_values")
