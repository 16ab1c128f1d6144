"""Training on a small learnable table."""

import pytest
from pyspark.sql import functions as F

from staylens.operators import models as T
from staylens.plans import training_queries as Q
from tests.test_batch import booking_rows


@pytest.fixture(scope="module")
def learnable(spark):
    changes = []
    for n in range(80):
        risky = n % 4 < 2
        changes.append({
            "is_canceled": str(int(risky)), "lead_time": str(150 + n if risky else 5 + n % 20),
            "deposit_type": "Non Refund" if risky else "No Deposit", "country": "PRT" if risky else "GBR",
            "adr": None if n % 9 == 0 else str(60 + n), "arrival_date_day_of_month": str(1 + n % 28),
        })
    return booking_rows(spark, *changes)


def test_both_candidates_learn_and_one_is_selected(learnable):
    trained = T.train(learnable, "2017-12-31", max_depth=5, trees=10)
    rows = {r.model_name: r for r in trained.report.collect()}
    assert set(rows) == {"logistic_regression", "random_forest"}
    for row in rows.values():
        assert row.accuracy >= 0.9 and row.test_score == row.accuracy
        cells = row.true_negative + row.false_positive + row.false_negative + row.true_positive
        assert cells == 16 and row.true_positive + row.false_negative == 8  # a fifth of each class
    assert sum(r.is_selected for r in rows.values()) == 1


def test_scoring_survives_unseen_and_missing_values(spark, learnable):
    model = T.train(learnable, "2017-12-31", only=["logistic_regression"]).models["logistic_regression"]
    strange = learnable.where("booking_id = 1").withColumns({"country_code": F.lit("new"), "meal": F.lit(None).cast("string"),
                                                             "adr": F.lit(None).cast("decimal(10,2)")})
    row = T.prediction_records(strange, model, "v1").first()
    assert 0.0 <= row.cancel_probability <= 1.0
    assert row.predicted_label == int(row.cancel_probability >= 0.5)
    assert row.risk_level_name == row.risk_level + "_risk"
    assert "non_refund_deposit" in row.reason_tags


def test_metrics_document_defaults(spark):
    bare = spark.createDataFrame([(1,)], "other int")
    assert tuple(T.metrics_of(bare).first()) == (
        "unknown_model", "unknown_model_v1", 1, "selected by training pipeline", 0.0, 0.0, 0.0, 0.0)


def test_wide_categories_are_refused_or_hashed_on_demand(spark, learnable):
    with pytest.raises(ValueError, match="hashed"):
        T.train(learnable, "2017-12-31", only=["logistic_regression"], max_categories=1)
    wide = tuple(T.S.CATEGORICAL_FEATURES)
    trained = T.train(learnable, "2017-12-31", only=["logistic_regression"], max_categories=1, hashed=wide)
    kinds = [type(stage).__name__ for stage in trained.models["logistic_regression"].stages]
    assert "FeatureHasher" in kinds
    assert trained.report.first().accuracy >= 0.9


def test_the_fit_is_read_from_its_coefficients(spark, learnable):
    """The probability by column expressions equals the model's, also for unseen and missing values; a wrong one is told apart."""
    model = T.train(learnable, "2017-12-31", only=["logistic_regression"]).models["logistic_regression"]
    odd = learnable.withColumns({"country_code": F.when(F.col("booking_id") % 7 == 0, "new").otherwise(F.col("country_code")),
                                 "adr": F.when(F.col("booking_id") % 5 > 0, F.col("adr"))})
    scored = T.score(T.linear_probability(odd, model), model, "v1").select("cancel_probability", "linear_probability").collect()
    assert len(scored) == 80 and len({row[0] for row in scored}) > 10
    assert all(abs(float(row[0]) - row[1]) < 0.000051 for row in scored)
    train = T.balanced(T.exact_test_part(T.training_frame(learnable), label="label").where("not is_test"))
    assert T.steepest(model, train).first().slope < 1e-3
    others = T.training_frame(learnable).withColumns({"label": 1 - F.col("label"), "weight": F.lit(1.0)})
    assert T.steepest(model, others).first().slope > 0.1


def test_very_many_values_are_pooled(spark, learnable):
    """A column with 100,000 values: the frequent ones and the rest have places, and the coefficients give the probability."""
    many = spark.range(100_000).select(F.col("id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("f"), F.col("id") % 32)).otherwise(F.concat(F.lit("v"), "id")).alias("code"))
    rows = many.join(learnable.withColumn("k", F.col("booking_id") - 1), F.col("id") % 80 == F.col("k")).drop("k")
    rows = rows.withColumns({"booking_id": F.col("id"), "country_code": F.col("code")}).drop("id", "code")
    train = T.balanced(T.training_frame(rows))
    with pytest.raises(ValueError, match="pooled"):
        T.preprocessing(train)
    trained = T.fit(train, train.where("booking_id % 50 = 0"), only=["logistic_regression"], pooled=("country_code",), pooled_values=8)
    model = trained.models["logistic_regression"]
    width = T.Pipeline(stages=T.preprocessing(train, pooled=("country_code",), pooled_values=8)).fit(train).transform(train).schema
    assert width["country_code_onehot"].metadata["ml_attr"]["num_attrs"] == 9, "eight frequent values and the rest"
    few = rows.where("booking_id < 200").withColumn("country_code", F.when(F.col("booking_id") % 3 == 0, "new").otherwise(F.col("country_code")))
    scored = T.score(T.linear_probability(few, model), model, "v1").select("cancel_probability", "linear_probability").collect()
    assert len(scored) == 200 and all(abs(float(row[0]) - row[1]) < 0.000051 for row in scored)


def test_the_bookings_are_derived_once_per_query(spark, sf_dir, monkeypatch):
    """Training and both scorings read the stored bookings; nothing is left in memory."""
    derived, derive = [], Q.D.bookings
    monkeypatch.setattr(Q.D, "bookings", lambda *args: derived.append(args) or derive(*args))
    spark.catalog.clearCache()
    rows = Q.score_rules(spark, sf_dir)
    assert len(derived) == 1 and all("active-bookings" in path for path in rows.inputFiles())
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_a_forest_depends_on_the_rows_not_on_the_session(spark, learnable, tmp_path, monkeypatch):
    """Grown in parts, three at once: all its trees, each of its own sample, the votes of one forest, saved and loaded as one."""
    seen, spread = [], T.spread
    monkeypatch.setattr(T, "spread", lambda df, parts=None: seen.append(parts) or spread(df, parts))
    before, scores = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (3, 8):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            trained = T.train(learnable, "2017-12-31", only=["random_forest"], max_depth=5, trees=25)
            model = trained.models["random_forest"]
            scores.append([tuple(row) for row in model.transform(learnable).select(
                "booking_id", T.vector_to_array("probability").alias("p"), "prediction").orderBy("booking_id").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert scores[0] == scores[1] and len(scores[0]) == 80
    assert 1 in seen, "64 rows are one part, whatever the session says"
    forests = [stage for stage in model.stages if isinstance(stage, T.RandomForestClassificationModel)]
    assert [stage.getNumTrees for stage in forests] == [10, 10, 5] and T.trees_of(model) == 25
    assert len({stage.toDebugString.split("\n", 1)[1] for stage in forests[:2]}) == 2
    votes = model.transform(learnable).select("booking_id", *(T.vector_to_array(f"votes_{i}").alias(f"v{i}") for i in range(3)))
    for row, (key, p, prediction) in zip(votes.orderBy("booking_id").collect(), scores[0]):
        summed = [sum(v[k] for v in row[1:]) for k in (0, 1)]
        assert row.booking_id == key and sum(summed) == pytest.approx(25)
        assert p == pytest.approx([summed[0] / 25, summed[1] / 25]) and prediction == float(summed[1] > summed[0])
    path = str(tmp_path / "forest")
    model.write().overwrite().save(f"{path}/model")
    loaded = T.load_model(path).transform(learnable).select("booking_id", T.vector_to_array("probability").alias("p"), "prediction")
    assert [tuple(row) for row in loaded.orderBy("booking_id").collect()] == scores[0]


def test_training_stores_the_columns_it_reads(spark, sf_dir):
    """The bookings a training query stores have the columns of the fit and the split, in all their rows."""
    narrow, whole = Q._active(spark, sf_dir, *Q._TRAINING), Q._active(spark, sf_dir)
    assert set(narrow.columns) == {"booking_id", "arrival_date", "is_canceled", *T.S.CATEGORICAL_FEATURES, *T.S.NUMERIC_FEATURES}
    assert sorted(narrow.collect()) == sorted(whole.select(*narrow.columns).collect())
