"""Registered queries that fit or apply a model, graded by what must hold of any right fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens import schemas as S
from staylens.operators import bookings as B
from staylens.operators import models as T
from staylens.operators import splits as L
from staylens.plans import tables as D
from staylens.plans.catalog import query
from staylens.plans.stream_queries import _damaged_log
from staylens.session import fresh_dir, stored
from staylens.sources import files, streams
from staylens.streaming import jobs as J


def _active(spark, sf, *columns):
    """Derived from the test tables once per query, all columns or those given; every later read is a scan."""
    return stored(B.active_bookings(D.bookings(spark, sf)).select(*columns or "*"), "active-bookings")


# What a training run and its metrics document read of a booking.
_TRAINING = ("booking_id", "arrival_date", S.LABEL, *S.CATEGORICAL_FEATURES, *S.NUMERIC_FEATURES)


_REALTIME = f"active WHERE arrival_date >= DATE '{D.START}'"
_OFFLINE = f"active WHERE arrival_date <= DATE '{D.CUTOFF}'"

# A fifth of each class, rounded up, is held out.
_PARTS = f"""(SELECT cast(sum(ceil(0.2*n)) as bigint) AS test_rows, cast(sum(n)-sum(ceil(0.2*n)) as bigint) AS train_rows,
    cast(sum(ceil(0.2*n)) FILTER (is_canceled=1) as bigint) AS test_positives
    FROM (SELECT is_canceled, count(*) AS n FROM {_OFFLINE} AND is_canceled IS NOT NULL GROUP BY 1))"""


def _tested(report):
    """The sums of the test matrix, which the split fixes."""
    positives = F.col("true_positive") + F.col("false_negative")
    return report.withColumns(
        {
            "test_positives": positives.cast("bigint"),
            "test_rows": (positives + F.col("true_negative") + F.col("false_positive")).cast("bigint"),
        }
    )


@query(
    "train_lr",
    f"SELECT 'logistic_regression' AS model_name, test_rows, test_positives, 1::bigint AS is_selected, true AS at_optimum FROM {_PARTS}",
)
def train_lr(spark, sf):
    """The fit, its test matrix and whether the penalised loss is flat there."""
    with T.held_parts(_active(spark, sf), D.CUTOFF) as (train_part, test_part):
        trained = T.fit(train_part, test_part, only=["logistic_regression"])
        slope = T.steepest(trained.models["logistic_regression"], train_part).first()["slope"]
    return _tested(trained.report).select(
        "model_name", "test_rows", "test_positives", F.col("is_selected").cast("bigint"), F.lit(slope < 1e-3).alias("at_optimum")
    )


@query(
    "train_rf",
    f"""SELECT 'random_forest' AS model_name, test_rows, test_positives, 1::bigint AS is_selected, 120::bigint AS trees,
        true AS knows_its_rows FROM {_PARTS}""",
)
def train_rf(spark, sf):
    """The fit and its test matrix; full trees know nearly all the rows they grew from."""
    trained = T.train(_active(spark, sf, *_TRAINING), D.CUTOFF, only=["random_forest"])
    return _tested(trained.report).select(
        "model_name", "test_rows", "test_positives", F.col("is_selected").cast("bigint"),
        F.lit(T.trees_of(trained.models["random_forest"])).cast("bigint").alias("trees"),
        (F.col("train_score") >= 0.9).alias("knows_its_rows"),
    )


@query(
    "category_encoding",
    f"""SELECT booking_id, cast((SELECT count(DISTINCT country_code) FROM {_OFFLINE}) as int) AS width,
        case when country_code IN (SELECT country_code FROM {_OFFLINE}) then 1.0::double else 0.0::double end AS set_positions
        FROM {_REALTIME}""",
)
def category_encoding(spark, sf):
    """One-hot width and number of set positions per row of the realtime side, encoded as trained offline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    active = _active(spark, sf)
    offline = T.training_frame(L.offline_side(active, D.CUTOFF))
    fitted = Pipeline(stages=T.preprocessing(offline)).fit(offline)
    encoded = fitted.transform(T.training_frame(L.realtime_side(active, D.START)))
    hot = vector_to_array("country_code_onehot")
    return encoded.select(
        "booking_id", F.size(hot).alias("width"), F.aggregate(hot, F.lit(0.0), lambda a, b: a + b).alias("set_positions")
    )


_RULES = """SELECT booking_id, 'logistic_regression_v1' AS model_version, true AS probability_follows, true AS label_follows,
    true AS band_follows"""


def _rules(scored, active, model):
    """Whether the prediction fields follow from the coefficients of the model."""
    p, q = F.col("cancel_probability").cast("double"), F.col("linear_probability")
    band = F.when(p >= 0.6, "high").when(p >= 0.3, "medium").otherwise("low")
    own = T.linear_probability(active, model).select("booking_id", "linear_probability")
    return scored.join(own, "booking_id").select(
        "booking_id",
        "model_version",
        (F.abs(p - q) < 0.000051).alias("probability_follows"),
        (F.col("predicted_label") == (p >= 0.5).cast("int")).alias("label_follows"),
        (F.col("risk_level") == band).alias("band_follows"),
    )


_TAGS = f"SELECT booking_id, 'logistic_regression_v1' AS model_version, true AS probability_follows, lead_time, deposit_type FROM {_REALTIME}"


@query("score_bookings", _TAGS)
def score_bookings(spark, sf):
    """Scored bookings with columns of their own, and whether the probability follows from the coefficients."""
    active = _active(spark, sf)
    model = T.train(active, D.CUTOFF, only=["logistic_regression"]).models["logistic_regression"]
    scored = T.score(T.linear_probability(L.realtime_side(active, D.START), model), model, "logistic_regression_v1")
    follows = F.abs(F.col("cancel_probability").cast("double") - F.col("linear_probability")) < 0.000051
    return scored.select("booking_id", "model_version", follows.alias("probability_follows"), "lead_time", "deposit_type")


@query("score_rules", f"{_RULES} FROM {_REALTIME}")
def score_rules(spark, sf):
    active = _active(spark, sf)
    model = T.train(active, D.CUTOFF, only=["logistic_regression"]).models["logistic_regression"]
    return _rules(T.prediction_records(L.realtime_side(active, D.START), model, "logistic_regression_v1"), active, model)


@query("ml_artifact_roundtrip", f"SELECT booking_id, true AS equal FROM {_REALTIME}")
def ml_artifact_roundtrip(spark, sf):
    """Train, save, load and score again: the two probabilities of each booking are equal."""
    path = fresh_dir(spark, "artifacts")
    active = _active(spark, sf)
    trained = T.train(active, D.CUTOFF, only=["logistic_regression"])
    T.save_artifacts(trained, T.metrics_document(trained, active, D.CUTOFF, D.START), path)
    loaded = T.load_model(path)
    rows = L.realtime_side(active, D.START)
    before = T.score(rows, trained.models[trained.selected], "v1").select("booking_id", F.col("cancel_probability").alias("saved"))
    after = T.score(rows, loaded, "v1").select("booking_id", F.col("cancel_probability").alias("loaded"))
    return before.join(after, "booking_id").select("booking_id", (F.col("saved") == F.col("loaded")).alias("equal"))


@query("ml_forest_roundtrip", f"SELECT booking_id, true AS equal FROM {_REALTIME}")
def ml_forest_roundtrip(spark, sf):
    """A small forest, saved and loaded with its metrics document: the served model name and the probabilities are the same."""
    path = fresh_dir(spark, "artifacts")
    active = _active(spark, sf)
    trained = T.train(active, D.CUTOFF, only=["random_forest"], max_depth=8, trees=10)
    T.save_artifacts(trained, T.metrics_document(trained, active, D.CUTOFF, D.START), path)
    loaded, served = T.load_model(path), T.metrics_of(spark.read.json(f"{path}/metrics")).select("model_name").scalar()
    rows = L.realtime_side(active, D.START)
    before = T.score(rows, trained.models["random_forest"], "v1").select("booking_id", F.col("cancel_probability").alias("saved"))
    after = T.score(rows, loaded, "v1").select("booking_id", F.col("cancel_probability").alias("loaded"))
    same = (F.col("saved") == F.col("loaded")) & (served == "random_forest")
    return before.join(after, "booking_id").select("booking_id", same.alias("equal"))


@query(
    "train_and_select",
    f"""SELECT 1::bigint AS is_selected, 'selected by training pipeline' AS reason, true AS is_best, 2::bigint AS models,
        train_rows, test_rows, test_positives, (SELECT count(*) FROM {_REALTIME}) AS realtime_rows FROM {_PARTS}""",
)
def train_and_select(spark, sf):
    """Both candidates in full, the selection, the saved artifacts, and the served view of the metrics document."""
    path = fresh_dir(spark, "artifacts")
    active = _active(spark, sf, *_TRAINING)
    trained = T.train(active, D.CUTOFF)
    T.save_artifacts(trained, T.metrics_document(trained, active, D.CUTOFF, D.START), path)
    documents = spark.read.json(f"{path}/metrics")
    split = documents.select("data_split").scalar()
    served = T.metrics_of(documents).withColumn("data_split", split)
    best = trained.report.agg(F.max("f1_score")).scalar()
    tested = _tested(trained.report)
    return served.select(
        F.col("is_selected").cast("bigint"),
        "reason",
        (F.col("f1_score") == best).alias("is_best"),
        tested.agg(F.count_distinct("model_name")).scalar().alias("models"),
        F.col("data_split.train_rows"),
        F.col("data_split.test_rows"),
        tested.agg(F.max("test_positives")).scalar().alias("test_positives"),
        F.col("data_split.realtime_simulation_rows").alias("realtime_rows"),
    )


@query("stream_score", f"{_RULES} FROM {_REALTIME} AND booking_id%37<>0 AND booking_id%31<>0")
def stream_score(spark, sf):
    """The whole realtime job with a trained model: parse, reject, resolve, score, store."""
    active = _active(spark, sf)
    model = T.train(active, D.CUTOFF, only=["logistic_regression"]).models["logistic_regression"]
    known, out = fresh_dir(spark, "bookings"), fresh_dir(spark, "realtime")
    files.write_lookup_table(active, known)
    lines = streams.file_lines(spark, _damaged_log(spark, sf, active))

    def score(resolved):
        return T.score(resolved, model, "logistic_regression_v1").withColumns(
            {
                "prediction_id": F.col("booking_id"),
                "cancel_probability": F.col("cancel_probability").cast("decimal(6,4)"),
                "source": F.lit(S.STREAM_SOURCE),
                "predicted_at": F.to_timestamp("generated_at"),
            }
        )

    J.run_lines(lines, out, files.read_lookup_table(spark, known), score)
    return _rules(J.realtime_tables(spark, out)["predictions"], active, model)
