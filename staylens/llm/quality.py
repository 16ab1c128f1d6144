"""Quality classifier: random Fourier features of text statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import crc_remainder, materialize, prepare
from staylens.llm.samples import labelled_texts

#: At most so many labelled documents are used to fit.
FIT_ROWS = 20_000
FEATURES = 256
RIDGE = 1e-3
SEED = 7
#: Scores are counted in so many steps for the calibration.
STEPS = 1_000

SYMBOL = re.compile(r"[^\w\s]")


def statistics(text: str | None) -> list[float]:
    """Numbers that describe the form of a text, whatever its words; all are defined for an empty text."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * 14
    counts = Counter(words)
    symbols = len(SYMBOL.findall(text))
    upper = sum(map(str.isupper, words))
    letters = sum(map(len, words)) - symbols
    lines = [line for line in text.split("\n") if line]
    pairs = set(zip(words, words[1:]))
    return [
        math.log1p(n),
        math.log1p(letters / n),
        upper / n,
        math.log1p(symbols / n),
        math.log1p(len(counts)) / math.log1p(n),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(pairs) / max(n - 1, 1),
        sum(word.isalpha() for word in words) / n,
        sum(map(str.isdigit, words)) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        max(counts.values()) / n,
        math.log1p(max(map(len, words))),
        math.log1p(chars / max(len(lines), 1)),
        sum(len(word) < 4 for word in words) / n,
    ]


@dataclass
class QualityModel:
    """Everything that scoring needs: a few hundred numbers."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cosines whose inner products approximate a Gaussian kernel, and a constant."""
        z = np.cos(((x - self.mean) / self.scale) @ self.directions + self.phases)
        return np.hstack([z * math.sqrt(2 / z.shape[1]), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps, self.values), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, rows: int = FIT_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled documents for which ``use`` (a condition on doc_id) holds.

    Each partition sums its normal equations; only the sums, of a fixed size, reach the driver. Without
    any labelled document every score is 0.5.
    """
    prepare(docs.sparkSession)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [statistics(text) for text in batch["text"]], "y": batch["y"]})

    sample = labelled_texts(docs, labels, "quality", rows, use)
    data = materialize(sample.mapInPandas(describe, "x array<double>, y double"), "statistics")
    width = len(statistics(""))
    moments = data.agg(
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(width)],
    ).first()
    rng = np.random.default_rng(SEED)
    model = QualityModel(
        mean=np.array([moments[f"m{i}"] or 0.0 for i in range(width)]),
        scale=np.array([max(moments[f"s{i}"] or 0.0, 1e-6) for i in range(width)]),
        directions=rng.normal(size=(width, FEATURES)) / math.sqrt(width),
        phases=rng.uniform(0, 2 * math.pi, FEATURES),
        weights=np.zeros(FEATURES + 1),
        steps=np.array([0.0]),
        values=np.array([0.5]),
    )
    if moments["m0"] is None:
        return model
    model.weights = _ridge(data, model)
    model.steps, model.values = _calibrate(data, model)
    return model


def _ridge(data: DataFrame, model: QualityModel) -> np.ndarray:
    """Weights from the normal equations, whose rows are summed by partition and then by row number."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(model.weights)
        total = np.zeros((size, size + 1))
        for batch in batches:
            if len(batch):
                z = model.features(np.array(batch["x"].tolist()))
                total += z.T @ np.hstack([z, batch[["y"]].to_numpy()])
        yield pd.DataFrame({"i": range(size), "sums": [row.tobytes() for row in total]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s) for s in rows["sums"]], axis=0)
        return pd.DataFrame({"i": rows["i"].iloc[:1], "sums": [total.tobytes()]})

    schema = "i int, sums binary"
    rows = data.mapInPandas(sums, schema).groupBy("i").applyInPandas(add, schema).collect()
    total = np.array([np.frombuffer(row["sums"]) for row in sorted(rows, key=lambda row: row["i"])])
    gram = total[:, :-1] + RIDGE * total[-1, -2] * np.eye(len(total))
    return np.linalg.solve(gram, total[:, -1])


def _calibrate(data: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the label on the ridge score, from counts by score step."""

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = model.raw(np.array(batch["x"].tolist()))
                step = np.rint(np.clip(raw, -1, 2) * STEPS).astype(int)
                yield pd.DataFrame({"step": step, "y": batch["y"]})

    counted = data.mapInPandas(steps, "step int, y double").groupBy("step").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    rows = sorted((row["step"], row["y"], row["n"]) for row in counted.collect())
    pools: list[list[float]] = []  # label sum, count, first and last step
    for step, y, n in rows:
        pools.append([y, n, step, step])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y2, n2, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2], last]
    ends = [(end / STEPS, pool[0] / pool[1]) for pool in pools for end in sorted({pool[2], pool[3]})]
    return np.array([e[0] for e in ends]), np.array([e[1] for e in ends])


def score(text: Column, model: QualityModel) -> Column:
    """The probability of a good text, 0 to 1; null texts score as empty ones. It needs no shuffle."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array([statistics(t) for t in texts])))

    return scored(text)


def classify(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; held_out marks ids whose crc32 is divisible by 5.

    Null and empty texts get the score of an empty text, repeated rows are scored alike, a null doc_id isn't
    held out, and an empty table gives an empty table. Other columns are ignored.
    """
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    out = docs.select("doc_id", held_out.alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least the threshold."""
    return docs.filter(score(docs["text"], model) >= threshold)
