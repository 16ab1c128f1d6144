"""Forests that grow tree by tree from packed rows."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from staylens.operators import forests as G
from staylens.operators import models as T


def noisy(spark, n=3000, dense=False):
    """Rows of eleven features, some of them 0 or 1, whose label follows two of them for nine rows in ten."""
    random = np.random.default_rng(7)
    rows = []
    for key in range(n):
        numbers = [float(random.integers(0, 40)), float(random.normal()), 0.0, *(float(random.integers(0, 2)) for _ in range(8))]
        label = int((numbers[0] > 20) ^ (numbers[4] > 0)) if random.random() < 0.9 else int(random.integers(0, 2))
        listed = [(i, x) for i, x in enumerate(numbers) if x]
        rows.append((key, label, 0.5 + label, Vectors.dense(numbers) if dense or key % 2 else Vectors.sparse(11, listed)))
    frame = spark.createDataFrame(rows, ["booking_id", "label", "weight", "features"])
    return frame.withColumn("label", F.col("label").cast("int"))


def estimator(trees=20, depth=8, **more):
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=2, maxBins=256, seed=42, featureSubsetStrategy="sqrt", weightCol="weight", **more)


def impurity(mass):
    return mass.sum() - (mass * mass).sum() / mass.sum() if mass.sum() else 0.0


@pytest.mark.parametrize("by_class", [True, False])
def test_every_split_is_the_best_one(by_class):
    """With all features to choose from, a plain search over the sample of the tree finds no better split, and none where it stopped."""
    random = np.random.default_rng(3)
    n = 400
    matrix = np.column_stack((random.integers(0, 30, n), random.normal(size=n), *(random.integers(0, 2, n) for _ in range(5)), np.ones(n)))
    label = ((matrix[:, 0] > 14) ^ (random.random(n) < 0.2)).astype(np.int32) + (random.random(n) < 0.1).astype(np.int32)
    weight = np.array([0.7, 1.9, 1.1])[label] if by_class else random.random(n) + 0.5
    values = [np.unique(column) for column in matrix.T]
    bins = G.Bins([(v[1:] + v[:-1]) / 2 if len(v) < 100 else np.quantile(v, np.arange(1, 50) / 50) for v in values])
    growth = G.Growth(3, bins.size, 5, 2)
    feature, split, child, votes = G.grow_tree(bins.pack(matrix), label, weight, bins, growth, [42, 1])
    bag = np.random.default_rng([42, 1]).poisson(1.0, n)
    mass_of = lambda rows: np.bincount(label[rows], (bag * weight)[rows], 3)
    waiting, seen = [(0, np.flatnonzero(bag), 0)], 0
    while waiting:
        node, rows, depth = waiting.pop()
        seen += 1
        found = []
        for column, thresholds in enumerate(bins.thresholds):
            for place, threshold in enumerate(thresholds):
                left = matrix[rows, column] <= threshold
                if min(bag[rows[left]].sum(), bag[rows[~left]].sum()) >= 2:
                    gain = impurity(mass_of(rows)) - impurity(mass_of(rows[left])) - impurity(mass_of(rows[~left]))
                    found.append((gain, column, place))
        most = max(found, default=(0.0,))[0]
        if feature[node] == bins.size:
            assert depth == 5 or most < 1e-9 or len(np.unique(label[rows])) == 1
            assert votes[child[node]] == pytest.approx(mass_of(rows) / mass_of(rows).sum())
            continue
        own = next(gain for gain, column, place in found if (column, place) == (feature[node], split[node]))
        assert own == pytest.approx(most) and own > 0 and depth < 5
        left = matrix[rows, feature[node]] <= bins.thresholds[feature[node]][split[node]]
        waiting += [(child[node], rows[left], depth + 1), (child[node] + 1, rows[~left], depth + 1)]
    assert seen == len(feature) > 15
    got = G._vote(G._records((feature, split, child, votes), bins), bins.pack(matrix), bins)
    for row in range(n):
        node = 0
        while feature[node] < bins.size:
            node = child[node] + (matrix[row, feature[node]] > bins.thresholds[feature[node]][split[node]])
        assert (got[row] == votes[child[node]]).all()


def test_bins_part_all_rows_evenly(spark, monkeypatch):
    """Few values: a threshold between any two. Many: as many bins as allowed, of about as many rows each. Sparse and dense alike."""
    rows = noisy(spark, 2000)
    bins = G.find_bins(rows.repartition(3), 2000, 32)
    assert bins.thresholds[2].size == 0 and [len(found) for found in bins.thresholds[3:]] == [1] * 8
    assert bins.thresholds[3].tolist() == [0.5] and len(bins.thresholds[1]) == 31
    normal = np.sort([row.features[1] for row in rows.collect()])
    in_bins = np.diff(np.searchsorted(normal, [-np.inf, *bins.thresholds[1], np.inf]))
    assert in_bins.min() > 50 and in_bins.max() < 75
    monkeypatch.setattr(G, "SKETCHED_VALUES", 256)  # the sketches are coarser than the rows
    coarse = G.find_bins(rows.repartition(3), 2000, 32).thresholds[1]
    assert np.abs(np.searchsorted(normal, coarse) - np.searchsorted(normal, bins.thresholds[1])).max() < 25
    dense = G.find_bins(noisy(spark, 2000, dense=True), 2000, 32)
    assert all((a == b).all() for a, b in zip(bins.thresholds, dense.thresholds))


def test_trees_grow_in_tasks_not_level_by_level(spark, monkeypatch):
    """A few jobs whatever the depth, no node on the driver, the same trees with any number of tasks, as good as MLlib's."""
    rows = noisy(spark)
    train, test = rows.where("booking_id % 4 > 0").cache(), rows.where("booking_id % 4 = 0").cache()
    n, context, grown, right = train.count(), spark.sparkContext, [], []
    try:
        for tasks in (1, 3):
            monkeypatch.setattr(G, "TASKS_PER_CORE", tasks)
            context.setJobGroup(f"forest-{tasks}", "forest")
            grown.append(T.grow(estimator(trees=24, depth=25), train, n))
            assert len(context.statusTracker().getJobIdsForGroup(f"forest-{tasks}")) < 20
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(G, "MOST_BYTES", 0)  # rows that no task can hold: MLlib's own growth, and the same stages
    plain = T.grow(estimator(), train, n)
    for stages in (*grown, plain):
        out = T.PipelineModel(stages=stages).transform(test)
        right.append(out.where("prediction = label").count())
    forests = [[stage for stage in stages if isinstance(stage, G.TabledForest)] for stages in grown]
    assert [forest.getNumTrees for forest in forests[0]] == [10, 10, 4] and all(forest._java_obj is None for forest in forests[0])
    assert [f.toDebugString.split("\n", 1)[1] for f in forests[0]] == [f.toDebugString.split("\n", 1)[1] for f in forests[1]]
    assert not any(isinstance(stage, G.TabledForest) for stage in plain)
    assert right[0] == right[1] and abs(right[0] - right[2]) < 0.05 * 750 and right[0] > 0.8 * 750


def test_wide_vectors_and_other_weights(spark):
    """Vectors of more places than a byte can name, of one row each, with weights of their own; a forest without rows is refused."""
    rows = spark.range(600).select(
        F.col("id").alias("booking_id"), (F.col("id") % 2).cast("int").alias("label"), (1 + F.col("id") % 3).cast("double").alias("weight"),
        F.concat(F.lit("v"), F.col("id") % 2, F.lit("-"), F.col("id") % 7).alias("code"))
    hashed = T.FeatureHasher(inputCols=["code"], outputCol="features", numFeatures=1 << 10).transform(rows)
    out = T.PipelineModel(stages=T.grow(estimator(trees=30, depth=30), hashed, 600)).transform(hashed)
    assert out.where("prediction = label").count() > 500
    with pytest.raises(ValueError, match="rows"):
        T.grow(estimator(), hashed.where("false"), 0)
