"""Forests whose trees grow each in one task, over rows packed into a few bytes.

MLlib grows a forest level by level: in every pass over the rows each task holds the counts of all open nodes, the
driver handles each node and keeps all of them as objects. Where trees grow deep, their nodes grow with the rows. Here
a task holds all the rows, a byte for a feature with many bins and a bit for one with two, and grows whole trees from
them; the driver holds no node. The trees are those that MLlib describes: the same bins, a Poisson sample of the rows
per tree, a random subset of the features per node, the same gain, the same reasons to stop.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel, TaskContext, cloudpickle, inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import DataFrame, functions as F

from staylens.session import stored

# Task functions travel with their job, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Packed rows of a forest that one task holds at most; a larger one is left to MLlib.
MOST_BYTES = 128 << 20
# Different values of a feature that the rows of a partition are told apart by, when the bins are made.
SKETCHED_VALUES = 1 << 16
# Numbers in a matrix of features, and rows whose counts are made at once, so that both stay in the caches.
MATRIX_CELLS, ROWS_AT_ONCE = 1 << 20, 1 << 16
# Tasks that grow trees, for each core; each reads all the packed rows. Forests that pass through the driver at once.
TASKS_PER_CORE, SENT_AT_ONCE = 2, 4

_BLOCKS = "part int, block int, cells binary, label binary, weight binary"
_TREES = "tree int, feature binary, bin binary, child binary, votes binary"


class Bins:
    """The bins of the features, and where the bin of a feature lies among the packed bytes of a row.

    The bin of a value is the number of thresholds below it. Features with more than two bins come first with a cell
    each, then those with two with a bit each; one with a single bin takes none.
    """

    def __init__(self, thresholds: list[np.ndarray]):
        self.thresholds = [np.asarray(found, dtype=np.float64) for found in thresholds]
        self.size = len(thresholds)
        self.counts = np.array([len(found) + 1 for found in self.thresholds], dtype=np.int64)
        self.many, self.two = np.flatnonzero(self.counts > 2), np.flatnonzero(self.counts == 2)
        self.cell = np.uint8 if self.counts.max(initial=1) <= 256 else np.uint16
        self.width = max(1, len(self.many) + -(-len(self.two) // 8))
        self.column, self.shift = np.zeros(self.size, dtype=np.int64), np.zeros(self.size, dtype=self.cell)
        self.mask = np.zeros(self.size, dtype=self.cell)
        self.column[self.many], self.mask[self.many] = np.arange(len(self.many)), np.iinfo(self.cell).max
        place = np.arange(len(self.two))
        self.column[self.two], self.shift[self.two], self.mask[self.two] = len(self.many) + place // 8, place % 8, 1
        self.feature = np.min_scalar_type(self.size)  # a leaf has the number after the last feature

    def pack(self, matrix: np.ndarray) -> np.ndarray:
        """The cells of the rows of a matrix, one column per feature."""
        cells = np.zeros((len(matrix), self.width), dtype=self.cell)
        for column, feature in enumerate(self.many):
            cells[:, column] = np.searchsorted(self.thresholds[feature], matrix[:, feature])
        if len(self.two):
            above = matrix[:, self.two] > np.array([self.thresholds[feature][0] for feature in self.two])
            cells[:, len(self.many):] = np.packbits(above, axis=1, bitorder="little")
        return cells


def _matrices(vectors: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The rows of an array of vectors, sparse or dense, as matrices of MATRIX_CELLS numbers at most."""
    step = max(1, MATRIX_CELLS // max(size, 1))
    for at in range(0, len(vectors), step):
        rows, columns, values, n = _entries(vectors.slice(at, step))
        matrix = np.zeros((n, size))
        matrix[rows, columns] = values
        yield matrix


def _entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, feature and value of the listed numbers of an array of vectors, and its rows."""
    kind, _, indices, values = vectors.flatten()
    lengths = np.diff(values.offsets.to_numpy())
    rows = np.repeat(np.arange(len(vectors)), lengths)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sparse = kind.to_numpy(zero_copy_only=False) == 0
    columns = places.copy()
    columns[sparse[rows]] = indices.flatten().to_numpy()
    return rows, columns, values.flatten().to_numpy(), len(vectors)


def _counted(feature: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows per feature and value, in their order."""
    order = np.lexsort((value, feature))
    feature, value, n = feature[order], value[order], n[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (feature[1:] != feature[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(first)
    return feature[starts], value[starts], np.add.reduceat(n, starts) if len(starts) else n


def _sketch(most: int) -> Callable:
    """Per feature of a partition its values other than 0 in order and their rows; beyond `most` values, as many of even rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = (np.empty(0, dtype=np.int64), np.empty(0), np.empty(0)), []
        for batch in batches:
            _, feature, value, _ = _entries(batch.column(0))
            kept = value != 0
            waiting.append(_counted(feature[kept], value[kept], np.ones(int(kept.sum()))))
            if sum(len(part[0]) for part in waiting) > max(len(held[0]), 1 << 20):
                held, waiting = _counted(*(np.concatenate(parts) for parts in zip(held, *waiting))), []
        feature, value, n = _counted(*(np.concatenate(parts) for parts in zip(held, *waiting)))
        starts = np.flatnonzero(np.diff(feature, prepend=-1))
        out = []
        for start, end in zip(starts, [*starts[1:], len(feature)]):
            values, rows = value[start:end], n[start:end]
            if len(values) > most:
                upto = np.cumsum(rows)
                group = np.minimum((upto - rows / 2) * most // upto[-1], most - 1)
                last = np.flatnonzero(np.diff(group, append=most))
                values, rows = values[last], np.diff(upto[last], prepend=0)
            out.append((int(feature[start]), values, rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[i] for x in out], pa.list_(pa.float64())) for i in (1, 2))],
            ["feature", "value", "n"],
        )

    return run


def _thresholds(rows: int, most: int) -> Callable:
    """Of the sketches of a feature: midpoints between neighbouring values, at most `most`, then those that part the rows most evenly."""

    def run(found: pa.Table) -> pa.Table:
        value, n = (found.column(name).combine_chunks().flatten().to_numpy() for name in ("value", "n"))
        zeros = rows - n.sum()
        if zeros > 0:
            value, n = np.append(value, 0.0), np.append(n, zeros)
        _, value, n = _counted(np.zeros(len(value), dtype=np.int64), value, n)
        middle = (value[:-1] + value[1:]) / 2
        if len(middle) > most:
            upto = np.cumsum(n)[:-1]
            wanted = np.arange(1, most + 1) * (rows / (most + 1))
            after = np.clip(np.searchsorted(upto, wanted), 1, len(upto) - 1)
            nearest = np.where(wanted - upto[after - 1] < upto[after] - wanted, after - 1, after)
            middle = middle[np.unique(nearest)]
        return pa.table({"feature": found.column("feature")[:1], "thresholds": pa.array([middle], pa.list_(pa.float64()))})

    return run


def find_bins(features: DataFrame, rows: int, max_bins: int) -> Bins:
    """The bins of each place of the vectors in the column `features`, from all rows."""
    size = features.schema["features"].metadata.get("ml_attr", {}).get("num_attrs")
    if size is None:
        size = features.select(F.max(F.size(vector_to_array("features")))).first()[0] or 0
    sketches = features.select("features").mapInArrow(_sketch(SKETCHED_VALUES), "feature int, value array<double>, n array<double>")
    most = max(min(max_bins, rows) - 1, 0)
    found = sketches.groupBy("feature").applyInArrow(_thresholds(rows, most), "feature int, thresholds array<double>")
    thresholds = [np.empty(0)] * size
    for row in found.collect():  # one row per feature, each of max_bins numbers at most
        thresholds[row["feature"]] = np.array(row["thresholds"])
    return Bins(thresholds)


def _pack(bins: Bins) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            cells = b"".join(bins.pack(matrix).tobytes() for matrix in _matrices(batch.column(0), bins.size))
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
            weight = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), *(pa.array([x], pa.binary()) for x in (cells, label, weight))],
                ["part", "block", "cells", "label", "weight"],
            )

    return run


@dataclass(frozen=True)
class Growth:
    """What a tree may look like: the parameters of the estimator."""

    classes: int
    subset: int
    max_depth: int
    min_rows: int


def _subsets(random: np.random.Generator, n: int, size: int, wanted: int) -> np.ndarray:
    """`n` random subsets of `wanted` of `size` numbers, by Floyd's method."""
    chosen = np.empty((wanted, n), dtype=np.int64)
    for place, last in enumerate(range(size - wanted, size)):
        drawn = random.integers(0, last + 1, n)
        chosen[place] = np.where((chosen[:place] == drawn).any(axis=0), last, drawn)
    return chosen


def grow_tree(cells: np.ndarray, label: np.ndarray, weight: np.ndarray, bins: Bins, growth: Growth, seed: list[int]) -> tuple:
    """The nodes of a tree, level by level: feature, last bin that goes left, and left child (the right one follows).

    A leaf has no feature but `bins.size`, and in place of the child the row of the table of votes that it casts.
    The packed rows are kept in the order of their nodes, so a level is counted slice by slice, each in the caches.
    Gains are those of the Gini index.
    """
    random = np.random.default_rng(seed)
    drawn = random.poisson(1.0, len(label))
    kept = np.flatnonzero(drawn)
    classes, width = growth.classes, bins.width
    cells, bag, y = cells.take(kept, axis=0), drawn[kept].astype(np.float64), label[kept].astype(np.int64)
    mass = bag * weight[kept]
    of_class = np.zeros(classes)
    of_class[label] = weight
    by_class = bool((of_class[label] == weight).all())  # weights that depend on the class alone are put on counts, which are exact
    sizes = np.array([len(kept)])
    features, splits, children, shares, first = [], [], [], [], 1
    for depth in range(growth.max_depth + 1):
        nodes = len(sizes)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        node = np.repeat(np.arange(nodes), sizes)
        place = y * nodes + node
        counts = np.bincount(place, bag, classes * nodes).reshape(classes, nodes)
        total = counts * of_class[:, None] if by_class else np.bincount(place, mass, classes * nodes).reshape(classes, nodes)
        rows = counts.sum(axis=0)
        open_ = ((counts > 0).sum(axis=0) > 1) & (rows >= 2 * growth.min_rows) & (depth < growth.max_depth)
        feature, split = np.full(nodes, bins.size, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
        opened = np.flatnonzero(open_)
        chosen = _subsets(random, len(opened), bins.size, growth.subset)
        whole = total.sum(axis=0)
        best = (total * total).sum(axis=0) / np.where(whole > 0, whole, 1) * (1 + 1e-12)
        # Slices of about ROWS_AT_ONCE rows, whole nodes.
        slices = np.flatnonzero(np.diff(starts[opened] // ROWS_AT_ONCE, prepend=-1)) if len(opened) else opened
        for low, high in zip(slices, [*slices[1:], len(opened)]):
            own = opened[low:high]
            size = sizes[own]
            if own[-1] - own[0] + 1 == len(own):
                at = slice(starts[own[0]], ends[own[-1]])
            else:
                at = np.arange(size.sum()) + np.repeat(starts[own] - (np.cumsum(size) - size), size)
            flat, bag_, y_ = cells[at].ravel(), bag[at], y[at]
            base, mass_ = np.arange(0, len(flat), width), None if by_class else mass[at]
            row_node = np.repeat(np.arange(len(own)), size)
            to_rows = (lambda x: x.take(row_node)) if len(own) * 16 > len(row_node) else (lambda x: np.repeat(x, size))
            total_, rows_, best_, feature_, split_ = total[:, own], rows[own], best[own], feature[own], split[own]
            for of in chosen[:, low:high]:
                n_bins = bins.counts[of]
                upto = np.cumsum(n_bins)
                from_, n = upto - n_bins, int(upto[-1])
                cell = flat.take(base + to_rows(bins.column[of]))
                cell = (cell >> to_rows(bins.shift[of])) & to_rows(bins.mask[of])
                key = y_ * n + to_rows(from_) + cell
                seen = np.bincount(key, bag_, classes * n).reshape(classes, n)
                heavy = seen if by_class else np.bincount(key, mass_, classes * n).reshape(classes, n)
                # Bins without rows part them as the bin before does. Every node has a row, so it has a bin here.
                in_bin = seen.sum(axis=0)
                full = np.flatnonzero(in_bin)
                bin_node = np.repeat(np.arange(len(own)), n_bins)[full]
                starts_ = np.flatnonzero(np.diff(bin_node, prepend=-1))
                upto_rows = np.cumsum(in_bin[full])
                left_rows = upto_rows - np.concatenate(([0.0], upto_rows))[starts_][bin_node]
                ok = np.flatnonzero((left_rows >= growth.min_rows) & (rows_[bin_node] - left_rows >= growth.min_rows))
                if not len(ok):
                    continue
                at_node = bin_node[ok]
                left_all, right_all, left_score, right_score = (np.zeros(len(ok)) for _ in range(4))
                for index in range(classes):
                    sums = np.cumsum(heavy[index][full])  # of counts, which add up exactly, where they give the weights
                    left = sums[ok] - np.concatenate(([0.0], sums))[starts_][at_node]
                    left = left * of_class[index] if by_class else np.maximum(left, 0)
                    right = np.maximum(total_[index][at_node] - left, 0)
                    left_all += left
                    right_all += right
                    left_score += left * left
                    right_score += right * right
                gain = left_score / np.where(left_all > 0, left_all, 1) + right_score / np.where(right_all > 0, right_all, 1)
                heads = np.flatnonzero(np.diff(at_node, prepend=-1))
                most = np.maximum.reduceat(gain, heads)
                tops = np.flatnonzero(gain == np.repeat(most, np.diff(heads, append=len(gain))))
                tops = tops[np.diff(at_node[tops], prepend=-1) > 0]  # the first of equals
                better = most > best_[at_node[heads]]
                winner, top = at_node[heads][better], full[ok[tops[better]]]
                best_[winner], feature_[winner], split_[winner] = most[better], of[winner], top - from_[winner]
            feature[own], split[own] = feature_, split_
        parents = feature < bins.size
        leaf = np.flatnonzero(~parents)
        child = np.empty(nodes, dtype=np.int64)
        child[parents] = first + 2 * np.arange(int(parents.sum()))
        child[leaf] = sum(map(len, shares)) + np.arange(len(leaf))
        shares.append((total[:, leaf] / np.where(whole[leaf] > 0, whole[leaf], 1)).T)
        features.append(feature.astype(bins.feature))
        splits.append(split.astype(bins.cell))
        children.append(child)
        if not parents.any():
            break
        first += 2 * int(parents.sum())
        # The rows of the parents, those that go left first.
        stay = np.repeat(parents, sizes)
        stay = np.flatnonzero(stay)
        of, size = feature[parents], sizes[parents]
        cell = cells.ravel().take(stay * width + np.repeat(bins.column[of], size))
        right = ((cell >> np.repeat(bins.shift[of], size)) & np.repeat(bins.mask[of], size)) > np.repeat(split[parents], size)
        starts = np.cumsum(size) - size
        to_right = np.add.reduceat(right, starts, dtype=np.int64)
        before = np.cumsum(right) - right
        before -= np.repeat(before[starts], size)
        inside = np.arange(len(right)) - np.repeat(starts, size)
        to = np.repeat(starts, size) + np.where(right, np.repeat(size - to_right, size) + before, inside - before)
        order = np.empty(len(to), dtype=np.int64)
        order[to] = stay
        cells, bag, y, mass = cells.take(order, axis=0), bag[order], y[order], mass[order]
        sizes = np.column_stack((size - to_right, to_right)).ravel()
    feature, child = np.concatenate(features), np.concatenate(children)
    votes, same = np.concatenate(shares), np.zeros(int((feature == bins.size).sum()), dtype=np.int64)
    for share in votes.T:  # leaves of equal votes share a row
        alike = np.unique(share, return_inverse=True)[1]
        same = np.unique(same * len(alike) + alike, return_inverse=True)[1]
    _, where, same = np.unique(same, return_index=True, return_inverse=True)
    child[feature == bins.size] = same
    return feature, np.concatenate(splits), child.astype(np.int32), votes[where]


def _grow(bins: Bins, growth: Growth, seeds: list[list[int]], tasks: int) -> Callable:
    """The trees of a task from the blocks of all rows. Neighbours grow together, so a forest is read from few files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for batch in batches:
            for task, part, block, *columns in zip(*(batch.column(name).to_pylist() for name in ("task", "part", "block", "cells", "label", "weight"))):
                held.setdefault(task, {})[part, block] = columns if task == min(held, default=task) else None
        if not held:
            return
        blocks = [columns for _, columns in sorted(held[min(held)].items())]
        cells, label, weight = (
            np.frombuffer(b"".join(block[i] for block in blocks), kind) for i, kind in enumerate((bins.cell, np.int32, np.float64))
        )
        cells = cells.reshape(-1, bins.width)
        blocks.clear()
        for tree in (tree for tree in range(len(seeds)) if tree * tasks // len(seeds) in held):
            parts = grow_tree(cells, label, weight, bins, growth, seeds[tree])
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree], pa.int32()), *(pa.array([part.tobytes()], pa.binary()) for part in parts)],
                ["tree", "feature", "bin", "child", "votes"],
            )

    return run


def _records(tree: tuple, bins: Bins) -> tuple[np.ndarray, ...]:
    """The nodes of a tree as two numbers each, so that a row reads all of its node at once; the votes per node and the table of them.

    The first has the left child and the column of the feature, the second the mask, the shift and the last bin that
    goes left. A leaf is its own left child, and with a mask of 0 every row goes left.
    """
    feature, split, child, votes = tree
    inner = np.flatnonzero(feature < bins.size)
    of = feature[inner]
    step, test = np.arange(len(feature)) << 32, np.zeros(len(feature), dtype=np.int64)
    step[inner] = child[inner].astype(np.int64) << 32 | bins.column[of]
    test[inner] = bins.mask[of].astype(np.int64) << 32 | bins.shift[of].astype(np.int64) << 16 | split[inner]
    return step, test, child, votes


def _vote(records: tuple, cells: np.ndarray, bins: Bins) -> np.ndarray:
    """The votes of a tree for packed rows."""
    step, test, child, votes = records
    flat, out = cells.ravel(), np.empty(len(cells), dtype=np.int64)
    row, node = np.arange(len(cells)), np.zeros(len(cells), dtype=np.int64)
    base = row * bins.width
    while len(row):
        for _ in range(4):
            to, how = step.take(node), test.take(node)
            cell = flat.take(base + (to & 0xFFFFFFFF)).astype(np.int64)
            node = (to >> 32) + ((cell >> (how >> 16 & 0xFFFF) & how >> 32) > (how & 0xFFFF))
        ended = how == 0
        out[row[ended]] = node[ended]
        inner = np.flatnonzero(~ended)
        row, base, node = row[inner], base[inner], node[inner]
    return votes[child[out]]


class TabledForest(RandomForestClassificationModel):
    """A forest whose trees are the rows of a stored table, not objects on the driver.

    It adds the votes of its trees to a frame, as MLlib's model does; tasks get the trees by broadcast.
    """

    def __init__(self, bins: Bins | None = None, trees: DataFrame | None = None, n: int = 0, classes: int = 0):
        super().__init__()
        self.bins, self.trees, self._n, self._classes, self._sent = bins, trees, n, classes, (None, None)

    @property
    def getNumTrees(self) -> int:
        return self._n

    @property
    def treeWeights(self) -> list[float]:
        return [1.0] * self._n

    @property
    def numClasses(self) -> int:
        return self._classes

    @property
    def numFeatures(self) -> int:
        return self.bins.size

    @property
    def totalNumNodes(self) -> int:
        return sum(len(tree[0]) for tree in self._collected())

    def _collected(self) -> list[tuple]:
        kinds = (self.bins.feature, self.bins.cell, np.int32, np.float64)
        rows = sorted(self.trees.collect(), key=lambda row: row["tree"])  # six bytes per node
        trees = [tuple(np.frombuffer(row[name], kind) for name, kind in zip(("feature", "bin", "child", "votes"), kinds)) for row in rows]
        return [(*tree[:3], tree[3].reshape(-1, self._classes)) for tree in trees]

    def send(self) -> Broadcast:
        """The trees, broadcast once in an application."""
        context = self.trees.sparkSession.sparkContext
        if self._sent[0] != context.applicationId:
            self._sent = context.applicationId, context.broadcast({"trees": self._collected()})
        return self._sent[1]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bins, sent, classes = self.bins, self.send(), self._classes

        @F.arrow_udf("array<double>")
        def votes(vectors: pa.Array) -> pa.Array:
            out = np.zeros((len(vectors), classes))
            cells = np.concatenate([bins.pack(matrix) for matrix in _matrices(vectors, bins.size)] or [np.empty((0, bins.width), bins.cell)])
            held = sent.value
            if "records" not in held:  # a worker makes them once for all its tasks
                held["records"] = [_records(tree, bins) for tree in held.pop("trees")]
            for records in held["records"]:
                out += _vote(records, cells, bins)
            offsets = np.arange(len(vectors) + 1, dtype=np.int32) * classes
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

        return dataset.withColumn(self.getRawPredictionCol(), array_to_vector(votes(self.getFeaturesCol())))

    @property
    def toDebugString(self) -> str:
        lines = [f"TabledForest: uid={self.uid}, numTrees={self._n}, numClasses={self._classes}, numFeatures={self.bins.size}"]
        for number, (feature, split, child, votes) in enumerate(self._collected()):
            lines.append(f"  Tree {number} (weight 1.0):")
            waiting = [(0, 4, "")]
            while waiting:
                node, indent, said = waiting.pop()
                of = int(feature[node])
                lines += [" " * (indent - 1) + said] if said else []
                if of == self.bins.size:
                    lines.append(" " * indent + f"Predict: {float(votes[child[node]].argmax())}")
                    continue
                bound = f"{self.bins.thresholds[of][split[node]]!r})"
                waiting.append((int(child[node]) + 1, indent + 1, f"Else (feature {of} > {bound}"))
                waiting.append((int(child[node]), indent + 1, f"If (feature {of} <= {bound}"))
        return "\n".join(lines) + "\n"

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, forest: TabledForest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        forest = self.forest
        extra = {"numTrees": forest._n, "numClasses": forest._classes, "thresholds": [found.tolist() for found in forest.bins.thresholds]}
        DefaultParamsWriter.saveMetadata(forest, path, self.sparkSession, extra)
        forest.trees.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> TabledForest:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        bins = Bins([np.array(found) for found in metadata["thresholds"]])
        trees = self.sparkSession.read.schema(_TREES).parquet(f"{path}/trees")
        forest = self.kind(bins, trees, metadata["numTrees"], metadata["numClasses"])
        forest._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(forest, metadata)
        return forest


def grow_forests(forests: list[RandomForestClassifier], dealt: DataFrame, rows: int) -> list[TabledForest] | None:
    """The forests from weighted rows; none if the packed rows are more than a task may hold.

    A tree has a seed of its own, and the rows come in the order of their partitions, so the trees depend neither on
    the tasks nor on the cores.
    """
    if not rows:
        raise ValueError("a forest needs rows to grow from")
    first, dealt = forests[0], dealt.persist(StorageLevel.DISK_ONLY)
    bins = find_bins(dealt, rows, first.getMaxBins())
    if rows * bins.width * np.dtype(bins.cell).itemsize > MOST_BYTES:
        dealt.unpersist()
        return None
    classes = int(dealt.agg(F.max("label")).first()[0] or 0) + 1
    growth = Growth(max(classes, 2), int(np.ceil(np.sqrt(bins.size))), first.getMaxDepth(), first.getMinInstancesPerNode())
    seeds = [[forest.getSeed(), tree] for forest in forests for tree in range(forest.getNumTrees())]
    context = dealt.sparkSession.sparkContext
    tasks = min(len(seeds), TASKS_PER_CORE * max(context.defaultParallelism, 1))
    blocks = dealt.select("features", "label", "weight").mapInArrow(_pack(bins), _BLOCKS).persist(StorageLevel.DISK_ONLY)
    copies = blocks.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    grown = copies.repartitionById(tasks, "task").mapInArrow(_grow(bins, growth, seeds, tasks), _TREES)
    trees = stored(grown, "trees")
    blocks.unpersist()
    dealt.unpersist()
    models, at = [], 0
    for forest in forests:
        n = forest.getNumTrees()
        own = trees.where(F.col("tree").between(at, at + n - 1)).withColumn("tree", (F.col("tree") - at).cast("int"))
        model = TabledForest(bins, own, n, growth.classes)
        models.append(model.setFeaturesCol(forest.getFeaturesCol()))
        at += n
    with ThreadPool(min(SENT_AT_ONCE, len(models))) as pool:  # they are graded next
        pool.map(inheritable_thread_target(dealt.sparkSession)(lambda model: model.send()), models, chunksize=1)
    return models
