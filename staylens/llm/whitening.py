"""Whitening of embeddings: distributed centred covariance, leading eigenvectors, broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import materialize, prepare

#: An entry c becomes the integer floor(SCALE * c) + SHIFT.
SCALE = 1_024
SHIFT = 100_000
#: Entries beyond this size times SCALE count as this, so that integer sums stay exact.
MOST = float(1 << 40)
COMPONENTS = 8
#: Partial covariances that are summed together in a node of the tree.
FAN_IN = 32
#: Numbers of partial covariances that a task holds, and of projections that are broadcast at once.
HELD_NUMBERS = 1 << 22
#: A direction with less than this share of the largest variance has none.
LEAST_VARIANCE = 1e-12

_GRID = "vec_id long, v array<double>"
_PARTIAL = "dim int, node long, n long, sums binary, scatter binary"
_MODEL = "dim int, n long, sums binary, variances array<double>, explained array<double>, directions binary"
_PROJECTED = "vec_id long, dim int, n long, deviation long, whitened array<double>"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component.

    The rows of ``embeddings`` (vec_id, embedding) with a vector whose entries are all there and finite are
    the fit list and are projected; the others are left out. Entries become integers, see SCALE; n is the
    number of vectors, deviation the exact sum of (n * x - S)^2 over the dimensions, null where it exceeds a
    long. Components are eigenvectors of the covariance (divisor n), numbered by falling variance, their
    largest entry positive; whitened is the centred vector's coordinate over the deviation of the component,
    explained the component's share of all variance, identity_error the largest difference between the
    covariance of all whitened values and the identity, to 12 places, as far as sums in any order agree.

    Vectors of different lengths are fitted apart, each length with its own n and components. A direction
    without variance is no component, so equal vectors, a single one, or empty ones give no rows, and there
    are at most as many components as dimensions. Repeated rows count and come back each; a null vec_id is
    an id like others. An empty table gives an empty table; other columns are ignored. A task solves a
    covariance alone, of 8 bytes times the square of the vectors' length.
    """
    prepare(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    models = fit(rows, components)
    projected = materialize(_project(rows, models, components), "projected")
    errors = materialize(_identity_errors(projected, components), "errors")
    # A row per vector length in both, small tables of known size.
    out = projected.join(models.select("dim", "explained"), "dim").join(errors, "dim")
    return out.select(
        "vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "value")
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("value").alias("whitened"),
        F.get("explained", F.col("at")).alias("explained"),
        "identity_error",
    )


def fit(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per vector length of ``rows`` (vec_id, v): n, sums of the integers less SHIFT, and the components.

    Each task sums its batches' products about their own means and merges means and products pairwise, so
    nothing is multiplied before it is centred; the tasks' sums meet in a tree of fixed shape, so reruns agree.
    """

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for _, grid in grids(batch):
                held[grid.shape[1]] = merged([*held.pop(grid.shape[1], []), moments(grid)])
                if sum(dim * dim for dim in held) > HELD_NUMBERS:
                    yield _partial_rows(held, part)
                    held = {}
        if held:
            yield _partial_rows(held, part)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "n", "sums", "scatter"], kind="stable")
        dim, node = int(group["dim"].iat[0]), int(group["node"].iat[0])
        parts = [_moments_of(n, s, m, dim) for n, s, m in zip(group["n"], group["sums"], group["scatter"])]
        return pd.DataFrame([(dim, node, *_bytes_of(merged(parts)[0]))], columns=["dim", "node", "n", "sums", "scatter"])

    sums = materialize(rows.mapInArrow(partials, _PARTIAL), "covariances")
    while True:
        last = sums.agg(F.max("node")).first()[0] or 0
        grouped = sums.withColumnRenamed("node", "part").withColumn("node", F.floor(F.col("part") / FAN_IN))
        sums = materialize(grouped.groupBy("dim", "node").applyInPandas(add, _PARTIAL), "covariances")
        if last < FAN_IN:
            break

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        dim, n, sums = int(group["dim"].iat[0]), int(group["n"].iat[0]), group["sums"].iat[0]
        covariance = np.frombuffer(group["scatter"].iat[0]).reshape(dim, dim) / n
        variances, directions = leading_eigenpairs(covariance, components)
        trace = covariance.trace()
        shares = (variances / trace).tolist() if trace > 0 else []
        return pd.DataFrame(
            {"dim": [dim], "n": [n], "sums": [sums], "variances": [variances.tolist()], "explained": [shares],
             "directions": [directions.tobytes()]}
        )

    return materialize(sums.groupBy("dim").applyInPandas(solve, _MODEL), "components")


def grids(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """For each vector length of a batch (vec_id, v) the ids and integers (less SHIFT) of its usable rows."""
    vectors = batch.column("v")
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        chosen = np.flatnonzero(lengths == dim)
        values = pc.fill_null(vectors.take(pa.array(chosen)).flatten(), float("nan"))
        values = values.to_numpy(zero_copy_only=False).reshape(-1, dim)
        usable = np.isfinite(values).all(axis=1)
        if usable.any():
            integers = np.floor(np.clip(values[usable] * SCALE, -MOST, MOST)).astype(np.int64)
            yield batch.column("vec_id").take(pa.array(chosen[usable])), integers


Moments = tuple[int, np.ndarray, np.ndarray]


def moments(grid: np.ndarray) -> Moments:
    """Number, sums, and sums of products about the mean, of the rows of a grid of integers."""
    sums = grid.sum(axis=0)
    centred = grid - sums / len(grid)
    return len(grid), sums, centred.T @ centred


def merged(parts: list[Moments]) -> list[Moments]:
    """One set of moments, alone in a list, from several: products about the new mean from the distance of the means."""
    n, sums, scatter = parts[0]
    for more, other, products in parts[1:]:
        apart = other / more - sums / n
        scatter = scatter + products + np.outer(apart, apart) * (n / (n + more) * more)
        n, sums = n + more, sums + other
    return [(n, sums, scatter)]


def _bytes_of(found: Moments) -> tuple[int, bytes, bytes]:
    return found[0], found[1].tobytes(), found[2].tobytes()


def _moments_of(n: int, sums: bytes, scatter: bytes, dim: int) -> Moments:
    return int(n), np.frombuffer(sums, dtype=np.int64), np.frombuffer(scatter).reshape(dim, dim)


def _partial_rows(held: dict[int, list[Moments]], part: int) -> pa.RecordBatch:
    rows = [(dim, part, *_bytes_of(found[0])) for dim, found in held.items()]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["dim", "node", "n", "sums", "scatter"]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and unit Householder vectors of a symmetric matrix."""
    a, size = np.array(matrix, dtype=float), len(matrix)
    off, reflectors = np.zeros(max(size - 1, 0)), []
    for k in range(size - 2):
        column = a[k + 1 :, k].copy()
        length = np.sqrt(column @ column)
        if not np.any(column[1:]):
            off[k] = column[0]
            reflectors.append(None)
            continue
        off[k] = -length if column[0] > 0 else length
        column[0] -= off[k]
        v = column / np.sqrt(column @ column)
        rest = a[k + 1 :, k + 1 :]
        p = 2 * (rest @ v)
        q = p - (v @ p) * v
        rest -= np.outer(v, q) + np.outer(q, v)
        reflectors.append(v)
    if size > 1:
        off[size - 2] = a[size - 1, size - 2]
    return a.diagonal().copy(), off, reflectors


def count_above(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie above each of the points ``at``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    above = np.zeros(len(at), dtype=np.int64)
    pivot = np.ones(len(at))
    for i in range(len(diagonal)):
        pivot = diagonal[i] - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        above += pivot > 0
    return above


def leading_values(diagonal: np.ndarray, off: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` largest eigenvalues, falling, by bisection down to neighbouring numbers."""
    radius = np.zeros(len(diagonal))
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    edge = 1e-12 * max(np.abs(diagonal).max() + radius.max(), np.finfo(float).tiny)
    low = np.full(many, (diagonal - radius).min() - edge)
    high = np.full(many, (diagonal + radius).max() + edge)
    wanted = np.arange(1, many + 1)
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        reached = count_above(diagonal, off, middle) >= wanted
        low, high = np.where(reached, middle, low), np.where(reached, high, middle)


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x with (T - shift) x = right for the tridiagonal T, by elimination with row exchanges; no pivot below ``least``."""
    size = len(diagonal)
    main, upper, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * size
    x, lower = right.tolist(), off.tolist()
    for i in range(size - 1):
        if abs(lower[i]) > abs(main[i]):
            factor = main[i] / lower[i]
            main[i], upper[i], second[i], old = lower[i], main[i + 1], upper[i + 1], upper[i]
            main[i + 1], upper[i + 1] = old - factor * upper[i], -factor * second[i]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            main[i] = main[i] if abs(main[i]) >= least else least
            factor = lower[i] / main[i]
            main[i + 1] -= factor * upper[i]
            x[i + 1] -= factor * x[i]
    for i in range(size - 1, -1, -1):
        value = x[i]
        if i + 1 < size:
            value -= upper[i] * x[i + 1]
        if i + 2 < size:
            value -= second[i] * x[i + 2]
        x[i] = value / (main[i] if abs(main[i]) >= least else least)
    return np.array(x)


def leading_eigenpairs(matrix: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a positive semidefinite matrix, falling, and their unit eigenvectors as rows.

    Householder vectors make it tridiagonal, bisection on Sturm counts finds the values, and inverse
    iteration the vectors; those of values closer than a thousandth of the largest are kept orthogonal to each
    other in every step. Values below LEAST_VARIANCE of the largest are left out.
    """
    size = len(matrix)
    diagonal, off, reflectors = tridiagonal(matrix)
    values = leading_values(diagonal, off, min(many, size))
    values = values[(values > 0) & (values > LEAST_VARIANCE * values[0])]
    norm = float(np.abs(diagonal).max() + 2 * (np.abs(off).max() if len(off) else 0))
    least = np.finfo(float).eps * norm
    rng = np.random.default_rng(size)
    vectors: list[np.ndarray] = []
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first = k
        x = rng.standard_normal(size)
        for _ in range(6):
            for _ in range(2):
                for near in vectors[first:]:
                    x -= (near @ x) * near
            x /= np.sqrt(x @ x)
            x = solve_shifted(diagonal, off, float(value), x, least)
            x /= np.abs(x).max()
        for near in vectors[first:]:
            x -= (near @ x) * near
        vectors.append(x / np.sqrt(x @ x))
    out = np.array(vectors).reshape(len(values), size)
    for k in range(len(reflectors) - 1, -1, -1):
        if reflectors[k] is not None:
            out[:, k + 1 :] -= 2 * np.outer(out[:, k + 1 :] @ reflectors[k], reflectors[k])
    for row in out:
        row *= np.sign(row[np.argmax(np.abs(row))])
    return values, out


def _project(rows: DataFrame, models: DataFrame, components: int) -> DataFrame:
    """Coordinates of all usable rows. The projections of the vector lengths are broadcast, as many at once as are small."""
    spark, out = rows.sparkSession, None
    dims = [row["dim"] for row in models.select("dim").orderBy("dim").collect()]  # a number per vector length
    while dims or out is None:
        many = max(1, int(np.searchsorted(np.cumsum(dims) * (components + 1), HELD_NUMBERS)))
        chosen, dims = dims[:many], dims[many:]
        found = {
            row["dim"]: (
                row["n"],
                np.frombuffer(row["sums"], dtype=np.int64),
                np.frombuffer(row["directions"]).reshape(-1, row["dim"]).T / np.sqrt(row["variances"]),
            )
            for row in models.filter(F.col("dim").isin(chosen)).collect()
        }
        held = spark.sparkContext.broadcast(found)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, grid in grids(batch):
                    if grid.shape[1] in held.value:
                        yield _projected(ids, grid, *held.value[grid.shape[1]])

        part = rows.mapInArrow(project, _PROJECTED)
        out = part if out is None else out.union(part)
    return out


def _projected(ids: pa.Array, grid: np.ndarray, n: int, sums: np.ndarray, directions: np.ndarray) -> pa.RecordBatch:
    rough = grid - sums / n
    fits = n * (np.abs(rough) + 1).max() < 2.0**62 and n * float(np.abs(grid).max()) < 2.0**62
    deviation = [None] * len(grid)
    if fits:
        exact = n * grid - sums
        rough = exact / n
        size = (exact.astype(float) ** 2).sum(axis=1)
        whole = (exact**2).sum(axis=1).tolist()
        deviation = [value if about < 2.0**63 * 0.999 else None for value, about in zip(whole, size)]
    whitened = rough @ directions
    lists = pa.ListArray.from_arrays(
        pa.array(np.arange(len(grid) + 1) * whitened.shape[1], type=pa.int32()), pa.array(whitened.ravel())
    )
    many = len(grid)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([grid.shape[1]] * many, type=pa.int32()),
            pa.array([n] * many, type=pa.int64()),
            pa.array(deviation, type=pa.int64()),
            lists,
        ],
        names=["vec_id", "dim", "n", "deviation", "whitened"],
    )


def _identity_errors(projected: DataFrame, components: int) -> DataFrame:
    """(dim, identity_error) from the whitened values themselves: their means first, then products about the means."""
    at = range(components)
    means = materialize(
        projected.groupBy("dim").agg(*(F.avg(F.get("whitened", F.lit(i))).alias(f"m{i}") for i in at)), "means"
    )
    centred = [(F.get("whitened", F.lit(i)) - F.col(f"m{i}")) for i in at]
    pairs = [(i, j) for i in at for j in range(i, components)]
    gaps = [F.abs(F.avg(centred[i] * centred[j]) - float(i == j)) for i, j in pairs]
    gaps.append(F.lit(0.0))
    return projected.join(means, "dim").groupBy("dim").agg(F.round(F.greatest(*gaps), 12).alias("identity_error"))
