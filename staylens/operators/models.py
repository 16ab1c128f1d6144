"""Training, evaluating and applying the cancellation classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import (
    FeatureHasher,
    OneHotEncoder,
    OneHotEncoderModel,
    SQLTransformer,
    StandardScaler,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from staylens import schemas as S
from staylens.functions import risk
from staylens.functions.labels import sql_literal
from staylens.functions.numbers import half_even
from staylens.operators.cleaning import require_columns
from staylens.operators.forests import grow_forests
from staylens.operators.predictions import confusion_matrix, quality
from staylens.operators.splits import (
    category_counts,
    category_profile,
    class_weights,
    exact_test_part,
    feature_stats,
    offline_side,
    split_counts,
)
from staylens.session import stored, use_checkpoints

# A category list lives on the driver and in every task, so its size is checked.
MAX_CATEGORIES = 10_000
# So many of the most frequent values of a pooled column have a place of their own.
POOLED_VALUES = 1_000

# MLlib's own limit; a caller whose trees outgrow the driver passes less.
MAX_DEPTH = 30
MAX_BINS = 256

# A forest grows as smaller ones of so many trees; their rows lie in parts of so many, where they are packed in parts of fewer.
TREES_PER_FIT, ROWS_PER_PART, PACKED_PER_PART = 10, 200_000, 50_000
# Between the seeds of two of them; a fit adds the number of a partition to its seed.
SEED_STEP = 1_000_003

MODEL_VERSION_SUFFIX = "_v1"


def preprocessing(
    train: DataFrame, hashed: tuple[str, ...] = (), hashed_width: int = 1 << 14, max_categories: int = MAX_CATEGORIES,
    pooled: tuple[str, ...] = (), pooled_values: int = POOLED_VALUES,
) -> list:
    """Stages from the 24 feature columns to one vector.

    Missing numbers become the exact median and are standardised; missing categories become the most
    frequent value and are one-hot encoded, an unseen value being the zero vector. For columns with very many
    values: those named in `pooled` have a place for each of the `pooled_values` most frequent ones and one for
    all the rest, unseen ones too; those in `hashed` are hashed to `hashed_width` places. Any other column with
    more than `max_categories` values is an error. The values are counted and ranked by Spark; the driver gets
    those that have a place.
    """
    indexed = [name for name in S.CATEGORICAL_FEATURES if name not in hashed and name not in pooled]
    counts = stored(category_counts(train), "category-counts")  # a row per value of a column
    profile = {row["column_name"]: row for row in category_profile(counts).collect()}  # one row per column
    wide = [name for name in indexed if name in profile and profile[name]["n_values"] > max_categories]
    if wide:
        raise ValueError(f"more than {max_categories} values in {wide}: name them in `pooled` or `hashed`, or raise `max_categories`")
    values: dict[str, list[str]] = {name: [] for name in indexed}
    listed = counts.where(F.col("column_name").isin(indexed)).orderBy("column_name", F.desc("n"), "value")
    for row in listed.collect():  # max_categories per column at most
        values[row["column_name"]].append(row["value"])
    for name in pooled:
        frequent = counts.where(F.col("column_name") == name).orderBy(F.desc("n"), "value").limit(pooled_values)
        values[name] = [row["value"] for row in frequent.collect()]
    medians = {row["column_name"]: row["median"] for row in feature_stats(train).collect()}  # one row per column
    filled = [
        f"coalesce(`{name}`, {sql_literal(profile[name]["mode"])}) AS `{name}_filled`" if name in profile else f"`{name}` AS `{name}_filled`"
        for name in S.CATEGORICAL_FEATURES
    ]
    numbers = [
        f"coalesce(cast(`{name}` AS double), {medians.get(name, 0.0)!r}D) AS `{name}_number`" for name in S.NUMERIC_FEATURES
    ]
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(filled + numbers)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{name}_number" for name in S.NUMERIC_FEATURES], outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
    ]
    vectors = ["scaled"]
    # The last place of a column is that of all values without one; it is dropped unless they are pooled.
    for names, drop_last in ((indexed, True), (list(pooled), False)):
        if names:
            # The values by falling frequency, as an indexer would find them in a pass of its own.
            stages += [
                StringIndexerModel.from_labels(values[name], f"{name}_filled", f"{name}_index", handleInvalid="keep")
                for name in names
            ]
            stages.append(
                OneHotEncoder(
                    inputCols=[f"{name}_index" for name in names], outputCols=[f"{name}_onehot" for name in names], dropLast=drop_last
                )
            )
            vectors += [f"{name}_onehot" for name in names]
    if hashed:
        stages.append(
            FeatureHasher(
                inputCols=[f"{name}_filled" for name in hashed], outputCol="hashed", numFeatures=hashed_width,
                categoricalCols=[f"{name}_filled" for name in hashed],
            )
        )
        vectors.append("hashed")
    return stages + [VectorAssembler(inputCols=vectors, outputCol="features")]


def candidates(train_rows: int, max_depth: int = MAX_DEPTH, trees: int = 120, max_bins: int = MAX_BINS) -> dict:
    """The two classifiers with balanced weights.

    The penalty equals an inverse strength of 1 on the summed loss; MLlib averages the loss, hence
    1/n. The features are scaled already.
    """
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        "logistic_regression": LogisticRegression(
            maxIter=1000, regParam=1.0 / max(train_rows, 1), standardization=False, **common
        ),
        "random_forest": RandomForestClassifier(
            numTrees=trees, minInstancesPerNode=2, maxDepth=max_depth, maxBins=max_bins, seed=42, featureSubsetStrategy="sqrt",
            cacheNodeIds=True, maxMemoryInMB=1024, **common
        ),
    }


def training_frame(bookings: DataFrame) -> DataFrame:
    """Features, label and balanced class weight."""
    require_columns(bookings, [*S.CATEGORICAL_FEATURES, *S.NUMERIC_FEATURES, S.LABEL])
    labelled = bookings.where(F.col(S.LABEL).isNotNull()).withColumn("label", F.col(S.LABEL).cast("int"))
    return labelled.select("booking_id", *S.CATEGORICAL_FEATURES, *S.NUMERIC_FEATURES, "label")


def balanced(train: DataFrame) -> DataFrame:
    """Add the class weights; they are as many as there are classes, two here."""
    weights = {row["label"]: row["weight"] for row in class_weights(train, "label").collect()}
    weight: Column = F.lit(1.0)
    for label, value in weights.items():
        weight = F.when(F.col("label") == label, F.lit(float(value))).otherwise(weight)
    return train.withColumn("weight", weight)


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows by booking id in `parts` or else `spark.sql.shuffle.partitions` partitions, sorted.

    The fit depends on that number alone, not on the cores or the files. One shuffle serves all passes of the fits.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "booking_id").sortWithinPartitions("booking_id")


class SummedVotes(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """The probability and prediction of a forest from the votes of its parts, as one forest derives them from all its trees."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        first, *others = (vector_to_array(name) for name in self.getInputCols())
        votes = first
        for more in others:
            votes = F.zip_with(votes, more, lambda x, y: x + y)
        summed = dataset.withColumn("_votes", votes)
        total = F.aggregate("_votes", F.lit(0.0), lambda x, y: x + y)
        share = F.transform("_votes", lambda vote: F.when(total > 0, vote / total).otherwise(vote))
        winner = F.array_position("_votes", F.array_max("_votes")) - 1
        return summed.withColumns({"probability": array_to_vector(share), "prediction": winner.cast("double")}).drop("_votes")


def grow(forest: RandomForestClassifier, features: DataFrame, rows: int) -> list:
    """The fitted stages of a forest: smaller forests of its trees and the sum of their votes.

    A tree grows in one task that holds all rows, packed. Rows that don't fit a task are left to MLlib: there every
    task holds the counts of all open nodes in a pass over the rows, and the driver handles each of them. So the work
    grows with nodes times partitions and a single fit keeps few cores busy: the rows come in as few partitions as
    their number allows, and as many fits run at once as there are cores for. Both draw samples by the partitions of
    the rows, so a forest depends on the rows alone, not on the session.
    """
    trees = forest.getNumTrees()
    sizes = [min(TREES_PER_FIT, trees - done) for done in range(0, trees, TREES_PER_FIT)]
    forests = [
        forest.copy({forest.numTrees: size, forest.seed: forest.getSeed() + index * SEED_STEP}) for index, size in enumerate(sizes)
    ]
    spark = features.sparkSession
    fitted = grow_forests(forests, spread(features, -(-rows // PACKED_PER_PART)), rows)
    if fitted is None:
        parts = -(-rows // ROWS_PER_PART)
        dealt = spread(features, parts).persist(StorageLevel.DISK_ONLY)
        at_once = max(1, spark.sparkContext.defaultParallelism // max(parts, 1))
        with ThreadPool(min(at_once, len(forests))) as pool:
            fitted = pool.map(inheritable_thread_target(spark)(lambda part: part.fit(dealt)), forests, chunksize=1)
        dealt.unpersist()
    votes = [f"votes_{index}" for index in range(len(fitted))]
    for model, name in zip(fitted, votes):
        model.setRawPredictionCol(name).setProbabilityCol("").setPredictionCol("")
    summed = SummedVotes()
    return [*fitted, summed._set(inputCols=votes)]


def trees_of(model: PipelineModel) -> int:
    return sum(stage.getNumTrees for stage in model.stages if isinstance(stage, RandomForestClassificationModel))


@dataclass
class Trained:
    """What one training run leaves behind."""

    models: dict[str, PipelineModel]
    report: DataFrame
    selected: str


def _predicted(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df).select("label", F.col("prediction").cast("int").alias("predicted_label"))


def evaluate(name: str, model: Model, train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: test quality, test matrix, accuracy on both parts. The parts have the columns that the model takes."""
    tested = confusion_matrix(_predicted(model, test))
    train_score = quality(confusion_matrix(_predicted(model, train))).select("accuracy").scalar()
    return (
        tested.select(F.struct("*").alias("matrix"), "*")
        .transform(lambda m: quality(m, "matrix"))
        .select(
            F.lit(name).alias("model_name"),
            "accuracy",
            "precision_score",
            "recall_score",
            "f1_score",
            train_score.alias("train_score"),
            F.col("accuracy").alias("test_score"),
            "matrix.*",
        )
    )


@contextmanager
def held_parts(bookings: DataFrame, cutoff: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The train rows of the offline side with their class weights, and a held-out fifth of each class.

    The feature columns are stored for the many passes of the fits, so the table is read once, a pass reads
    the columns it needs, and the memory is left to the fits.
    """
    source = stored(training_frame(offline_side(bookings, cutoff)), "training-rows")
    rows = stored(exact_test_part(source, label="label"), "split-rows")
    yield balanced(rows.where(~F.col("is_test"))), rows.where("is_test")


def train(bookings: DataFrame, cutoff: str, *args, **options) -> Trained:
    """Fit the candidates on the offline side, see `fit`, and grade them on a held-out fifth of each class."""
    with held_parts(bookings, cutoff) as (train_part, test_part):
        return fit(train_part, test_part, *args, **options)


def fit(
    train_part: DataFrame, test_part: DataFrame, only: list[str] | None = None, max_depth: int = MAX_DEPTH, trees: int = 120,
    max_bins: int = MAX_BINS, hashed: tuple[str, ...] = (), max_categories: int = MAX_CATEGORIES,
    pooled: tuple[str, ...] = (), pooled_values: int = POOLED_VALUES,
) -> Trained:
    """Fit the candidates on weighted rows, grade them on others and select the best by F1.

    Tree nodes reach over many jobs, so their ids are cut off from their lineage in the shared folder. The
    features wait on disk, as the classifiers hold them in memory in a form of their own.
    """
    use_checkpoints(train_part.sparkSession)
    rows = train_part.count()
    fits = candidates(rows, max_depth, trees, max_bins)
    wanted = {name: fits[name] for name in only or fits}
    stages = preprocessing(train_part, hashed, max_categories=max_categories, pooled=pooled, pooled_values=pooled_values)
    prepared = Pipeline(stages=stages).fit(train_part)
    features = spread(prepared.transform(train_part).select("booking_id", "label", "weight", "features"))
    features = features.persist(StorageLevel.DISK_ONLY)
    tested = prepared.transform(test_part).select("label", "features")
    models, grades = {}, []
    for name, estimator in wanted.items():
        fitted = grow(estimator, features, rows) if isinstance(estimator, RandomForestClassifier) else [estimator.fit(features)]
        models[name] = PipelineModel(stages=[*prepared.stages, *fitted])
        grades.append(evaluate(name, PipelineModel(stages=fitted), features, tested).first().asDict())
    features.unpersist()
    selected = max(grades, key=lambda grade: (grade["f1_score"], grade["accuracy"], grade["model_name"]))["model_name"]
    report = train_part.sparkSession.createDataFrame(grades)  # one row per model
    return Trained(models, report.withColumn("is_selected", (F.col("model_name") == selected).cast("int")), selected)


def metrics_document(trained: Trained, bookings: DataFrame, cutoff: str, start: str) -> DataFrame:
    """The one-row metrics document: selection, qualities, feature count and the data split."""
    measures = ["accuracy", "precision_score", "recall_score", "f1_score", "train_score", "test_score"]
    cells = ["true_negative", "false_positive", "false_negative", "true_positive"]
    ordered = trained.report.agg(
        F.map_from_entries(F.collect_list(F.struct("model_name", F.struct(*measures, *cells)))).alias("comparison"),
        F.max_by(F.struct(*measures), "is_selected").alias("metrics"),
        F.max_by(F.struct(*cells), "is_selected").alias("confusion_matrix"),
    )
    rows = exact_test_part(training_frame(offline_side(bookings, cutoff)), label="label")
    split = rows.agg(F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"))
    counts = split_counts(bookings, cutoff, start).agg(
        F.struct(F.max("offline_rows").alias("offline_rows"), F.max("realtime_rows").alias("realtime_rows"))
    )
    document = ordered.withColumns(
        {
            "selected_model": F.lit(trained.selected),
            "model_version": F.lit(trained.selected + MODEL_VERSION_SUFFIX),
            "feature_count": F.lit(len(S.CATEGORICAL_FEATURES) + len(S.NUMERIC_FEATURES)),
            "parts": split.select(F.struct("train_rows", "test_rows")).scalar(),
            "sides": counts.scalar(),
        }
    )
    return document.select(
        "selected_model", "model_version", "metrics", "comparison", "confusion_matrix", "feature_count",
        F.struct(
            F.lit(cutoff).alias("offline_cutoff_date"),
            F.lit(start).alias("realtime_start_date"),
            F.col("sides.offline_rows").alias("offline_source_rows"),
            F.col("parts.train_rows"),
            F.col("parts.test_rows"),
            F.col("sides.realtime_rows").alias("realtime_simulation_rows"),
            F.lit(0.2).alias("test_size"),
            F.lit(42).alias("random_state"),
        ).alias("data_split"),
    )


def save_artifacts(trained: Trained, document: DataFrame, path: str) -> None:
    """The selected model, its feature list and the metrics document under one folder."""
    spark = document.sparkSession
    trained.models[trained.selected].write().overwrite().save(f"{path}/model")
    names = [*S.CATEGORICAL_FEATURES, *S.NUMERIC_FEATURES]
    spark.range(1).select(F.array(*(F.lit(n) for n in names)).alias("feature_columns")).write.mode("overwrite").json(
        f"{path}/feature_columns"
    )
    document.write.mode("overwrite").json(f"{path}/metrics")


def metrics_of(documents: DataFrame) -> DataFrame:
    """The served view of metrics documents: the selected model, its version and its four measures.

    A document may lack parts: the names then say unknown and the measures are 0.
    """
    has = lambda name: name in documents.columns
    text = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if has(name) else F.lit(default)
    held = documents.schema["metrics"].dataType.names if has("metrics") else []
    measure = lambda name: F.coalesce(F.col(f"metrics.{name}").cast("double"), F.lit(0.0)) if name in held else F.lit(0.0)
    return documents.select(
        text("selected_model", "unknown_model").alias("model_name"),
        text("model_version", "unknown_model_v1").alias("model_version"),
        F.lit(1).alias("is_selected"),
        text("selection_reason", "selected by training pipeline").alias("reason"),
        *(measure(name).alias(name) for name in ("accuracy", "precision_score", "recall_score", "f1_score")),
    )


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def score(bookings: DataFrame, model: PipelineModel, model_version: str) -> DataFrame:
    """Bookings with their prediction record: probability, label, band, tags. No shuffle, one pass."""
    probability = half_even(vector_to_array(F.col("probability"))[1])
    scored = model.transform(bookings).withColumn("cancel_probability", probability)
    p = F.col("cancel_probability")
    band = risk.risk_band(p)
    return scored.select(
        *bookings.columns,
        F.lit(model_version).alias("model_version"),
        "cancel_probability",
        risk.predicted_label(p).alias("predicted_label"),
        risk.predicted_label_name(p).alias("predicted_label_name"),
        band.alias("risk_level"),
        risk.risk_name(band).alias("risk_level_name"),
        risk.reason_tags().alias("reason_tags"),
    )


def linear_probability(bookings: DataFrame, model: PipelineModel, name: str = "linear_probability") -> DataFrame:
    """Add the probability of a fitted logistic regression, by plain column expressions.

    The same value as the model's own, without vectors, so that it can be read, pushed into SQL and checked.
    """
    by_kind = {type(stage).__name__: stage for stage in model.stages}
    if "FeatureHasherModel" in by_kind or "FeatureHasher" in by_kind:
        raise ValueError("hashed columns have no coefficient per value")
    scaler, fit = by_kind["StandardScalerModel"], by_kind["LogisticRegressionModel"]
    indexers = [stage for stage in model.stages if isinstance(stage, StringIndexerModel)]
    weights = fit.coefficients.toArray().tolist()
    score: Column = F.lit(float(fit.intercept))
    for feature, mean, deviation in zip(S.NUMERIC_FEATURES, scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()):
        weight = weights.pop(0)
        if deviation:
            score = score + (F.col(f"{feature}_number") - F.lit(mean)) / F.lit(deviation) * F.lit(weight)
    encoders = [stage for stage in model.stages if isinstance(stage, OneHotEncoderModel)]
    kept = {name for encoder in encoders if not encoder.getDropLast() for name in encoder.getInputCols()}
    for indexer in indexers:
        effects = [part for label in indexer.labels for part in (F.lit(label), F.lit(weights.pop(0)))]
        rest = F.lit(weights.pop(0) if indexer.getOutputCol() in kept else 0.0)
        score = score + (F.coalesce(F.create_map(*effects)[F.col(indexer.getInputCol())], rest) if effects else rest)
    filled = model.stages[0].transform(bookings)
    return filled.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-score))).select(*bookings.columns, name)


def steepest(model: PipelineModel, train: DataFrame) -> DataFrame:
    """One row: the largest slope of the penalised loss at a fitted logistic regression, 0 at its optimum.

    `train` are the weighted rows of the fit. Slopes are weighted means of the features, so one pass sums them.
    """
    fit = model.stages[-1]
    rows = model.transform(train).select("features", "label", "weight", vector_to_array("probability")[1].alias("p"))
    mean = lambda weight: vector_to_array(Summarizer.mean(F.col("features"), weight))
    expected, seen = F.col("weight") * F.col("p"), F.col("weight") * F.col("label")
    sums = rows.agg(
        mean(expected).alias("expected"), mean(seen).alias("seen"), F.sum(expected).alias("e"), F.sum(seen).alias("s"),
        F.sum("weight").alias("w"),
    )
    weights = F.array(*(F.lit(float(value)) for value in fit.coefficients.toArray()))
    slopes = F.zip_with(
        F.zip_with("expected", "seen", lambda x, y: (x * F.col("e") - y * F.col("s")) / F.col("w")),
        weights,
        lambda slope, weight: F.abs(slope + weight * F.lit(float(fit.getRegParam()))),
    )
    return sums.select(F.greatest(F.array_max(slopes), F.abs(F.col("e") - F.col("s")) / F.col("w")).alias("slope"))


def prediction_records(bookings: DataFrame, model: PipelineModel, model_version: str) -> DataFrame:
    """The nine fields of a prediction record per booking."""
    return score(bookings, model, model_version).select(
        "booking_id", "model_version", "cancel_probability", "predicted_label", "predicted_label_name",
        "risk_level", "risk_level_name", "reason_tags", F.current_timestamp().alias("predicted_at"),
    )
