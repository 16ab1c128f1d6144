"""Registered queries: date split, training statistics, classifier quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens import schemas as S
from staylens.operators import bookings as B
from staylens.operators import predictions as P
from staylens.operators import series as R
from staylens.operators import splits as L
from staylens.plans import tables as D
from staylens.plans.catalog import query
from staylens.plans.oracle_tables import even, wire


def _active(spark, sf):
    return B.active_bookings(D.bookings(spark, sf))


_OFFLINE = f"(SELECT * FROM active WHERE arrival_date <= DATE '{D.CUTOFF}')"


@query("split_offline", f"SELECT {wire(S.LIST_COLUMNS)} FROM {_OFFLINE}")
def split_offline(spark, sf):
    return L.offline_side(_active(spark, sf), D.CUTOFF).select(*S.LIST_COLUMNS)


@query("split_realtime", f"SELECT {wire(S.LIST_COLUMNS)} FROM active WHERE arrival_date >= DATE '{D.START}'")
def split_realtime(spark, sf):
    return L.realtime_side(_active(spark, sf), D.START).select(*S.LIST_COLUMNS)


@query(
    "split_counts",
    f"""SELECT count(*) FILTER (arrival_date <= DATE '{D.CUTOFF}') AS offline_rows,
        count(*) FILTER (arrival_date >= DATE '{D.START}') AS realtime_rows, count(*) AS total_rows FROM active""",
)
def split_counts(spark, sf):
    return L.split_counts(_active(spark, sf), D.CUTOFF, D.START)


@query(
    "event_slice",
    f"""SELECT {wire(S.EVENT_COLUMNS)}, strftime(event_date,'%Y-%m-%d') AS business_time FROM active
        WHERE arrival_date >= DATE '{D.START}' ORDER BY booking_id LIMIT 40 OFFSET 15""",
)
def event_slice(spark, sf):
    return L.event_slice(_active(spark, sf), start=15, count=40, first_day=D.START)


_HASH = "md5(cast(booking_id as varchar) || ':42')"


@query(
    "hash_split",
    f"SELECT booking_id, is_canceled, case when substr({_HASH},1,4) < '3333' then 1 else 0 end AS is_test FROM {_OFFLINE}",
)
def hash_split(spark, sf):
    rows = L.offline_side(_active(spark, sf), D.CUTOFF)
    return rows.select("booking_id", "is_canceled", L.in_test_part().cast("int").alias("is_test"))


@query(
    "exact_split",
    f"""SELECT booking_id, is_canceled, case when row_number() OVER (PARTITION BY is_canceled ORDER BY {_HASH}, booking_id)
          <= ceil(0.2 * count(*) OVER (PARTITION BY is_canceled)) then 1 else 0 end AS is_test FROM {_OFFLINE}""",
)
def exact_split(spark, sf):
    rows = L.offline_side(_active(spark, sf), D.CUTOFF).select("booking_id", "is_canceled")
    return L.exact_test_part(rows).withColumn("is_test", F.col("is_test").cast("int"))


@query(
    "class_weights",
    f"""SELECT is_canceled AS label, count(*) AS class_rows, {even('sum(count(*)) OVER ()::double / (count(*) OVER () * count(*))')} AS weight,
        count(*) OVER () > 1 AND min(count(*)) OVER () >= 2 AS can_stratify FROM {_OFFLINE} GROUP BY is_canceled""",
)
def class_weights(spark, sf):
    return L.class_weights(L.offline_side(_active(spark, sf), D.CUTOFF))


@query(
    "feature_stats",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS column_name, {even(f'median({name}::double)')} AS median, {even(f'avg({name}::double)')} AS mean,
            {even(f'stddev_pop({name}::double)')} AS deviation FROM {_OFFLINE}"""
        for name in S.NUMERIC_FEATURES
    ),
)
def feature_stats(spark, sf):
    return L.feature_stats(L.offline_side(_active(spark, sf), D.CUTOFF))


@query(
    "category_modes",
    " UNION ALL ".join(
        f"""(SELECT '{name}' AS column_name, {name} AS mode, count(*) AS row_count FROM {_OFFLINE}
            WHERE {name} IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)"""
        for name in S.CATEGORICAL_FEATURES
    ),
)
def category_modes(spark, sf):
    return L.category_modes(L.offline_side(_active(spark, sf), D.CUTOFF))


# --- quality of the stored predictions against what happened ---------------------------------

_JUDGED = """, judged AS (SELECT source AS model_name, is_canceled AS label, predicted_label FROM predictions p
    JOIN bookings b ON b.booking_id = p.booking_id),
matrix AS (SELECT model_name, count(*) FILTER (label=0 AND predicted_label=0) AS tn, count(*) FILTER (label=0 AND predicted_label=1) AS fp,
    count(*) FILTER (label=1 AND predicted_label=0) AS fn, count(*) FILTER (label=1 AND predicted_label=1) AS tp FROM judged GROUP BY 1),
graded AS (SELECT model_name, {accuracy} AS accuracy, {precision} AS precision_score, {recall} AS recall_score, {f1} AS f1_score FROM matrix)
""".format(
    accuracy=even("(tp+tn)::double/(tn+fp+fn+tp)"),
    precision=even("coalesce(tp::double/nullif(tp+fp,0),0)"),
    recall=even("coalesce(tp::double/nullif(tp+fn,0),0)"),
    f1=even("coalesce(2.0::double*tp/nullif(2*tp+fp+fn,0),0)"),
)


def _matrix(spark, sf):
    """One confusion matrix per prediction source, which plays the model's name."""
    judged = D.predictions(spark, sf).join(D.bookings(spark, sf).select("booking_id", "is_canceled"), "booking_id")
    return P.confusion_matrix(judged.withColumnRenamed("source", "model_name"), "model_name", actual="is_canceled")


@query(
    "confusion_matrix",
    f"{_JUDGED} SELECT model_name, tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive FROM matrix",
)
def confusion_matrix(spark, sf):
    return _matrix(spark, sf)


@query("classification_metrics", f"{_JUDGED} SELECT * FROM graded")
def classification_metrics(spark, sf):
    return P.quality(_matrix(spark, sf), "model_name")


@query(
    "select_model",
    f"""{_JUDGED} SELECT model_name AS selected_model, f1_score FROM graded ORDER BY f1_score DESC, accuracy DESC, model_name DESC LIMIT 1""",
)
def select_model(spark, sf):
    return P.best_model(P.quality(_matrix(spark, sf), "model_name"))


@query(
    "model_comparison",
    f"""{_JUDGED} SELECT g.*, case when model_name = (SELECT model_name FROM graded ORDER BY f1_score DESC, accuracy DESC, model_name DESC LIMIT 1)
        then 1 else 0 end AS is_selected FROM graded g""",
)
def model_comparison(spark, sf):
    graded = P.quality(_matrix(spark, sf), "model_name")
    best = P.best_model(graded).select("selected_model").scalar()
    return graded.withColumn("is_selected", (F.col("model_name") == best).cast("int"))


@query(
    "comparison_rows",
    f"{_JUDGED} SELECT model_name, accuracy, precision_score, 0.0::double AS recall_score, f1_score FROM graded",
)
def comparison_rows(spark, sf):
    """One JSON document per model, without the recall, back to rows."""
    graded = P.quality(_matrix(spark, sf), "model_name")
    metrics = F.struct("accuracy", "precision_score", "f1_score")
    return P.comparison_rows(graded.select(F.to_json(F.create_map("model_name", metrics)).alias("document")))


@query(
    "series_metrics",
    f"""{_JUDGED} SELECT model_name, '准确率' AS name, accuracy AS value FROM graded UNION ALL SELECT model_name, '精确率', precision_score FROM graded
        UNION ALL SELECT model_name, '召回率', recall_score FROM graded UNION ALL SELECT model_name, 'F1 值', f1_score FROM graded""",
)
def series_metrics(spark, sf):
    return R.quality_series(P.quality(_matrix(spark, sf), "model_name"), "model_name")


@query(
    "series_confusion",
    f"""{_JUDGED} SELECT model_name, greatest(tn,fp,fn,tp) AS scale_max, x, y, count FROM (
        SELECT *, 0 AS x, 0 AS y, tn AS count FROM matrix UNION ALL SELECT *, 1, 0, fp FROM matrix
        UNION ALL SELECT *, 0, 1, fn FROM matrix UNION ALL SELECT *, 1, 1, tp FROM matrix)""",
)
def series_confusion(spark, sf):
    return R.matrix_series(_matrix(spark, sf), "model_name")
