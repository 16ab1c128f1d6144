"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import crc_remainder, prepare
from staylens.llm.samples import labelled_texts

#: At most so many labelled documents are used to fit, and so many words and beginnings of words get a weight.
FIT_ROWS = 20_000
FIT_WORDS = 4_000
#: A word is weighed if its share of toxic documents differs by so many standard errors, in so many documents.
LEAST_DEVIATION = 4.0
LEAST_DOCUMENTS = 5
ROUNDS = 300
SHRINK = 2e-6
#: Besides a word, its beginning is a feature: inflected forms share it.
STEM = 4

SENTENCE = re.compile(r"[^.!?\n。！？]+")
WORD = re.compile(r"\w+")


def features(text: str) -> set[str]:
    """The words in lower case, and the beginnings of the longer ones with a star."""
    words = set(WORD.findall(text.lower()))
    return words | {word[:STEM] + "*" for word in words if len(word) > STEM}


@dataclass
class ToxicityModel:
    """Word weights and the intercept of the sentence score."""

    weights: dict[str, float]
    intercept: float

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of every sentence with a weighed word; all others have the score of the intercept."""
        out = []
        for found in SENTENCE.finditer(text or ""):
            hits = self.weights.keys() & features(found.group())
            if hits:
                z = self.intercept + sum(self.weights[word] for word in sorted(hits))
                out.append((found.start(), found.end(), float(1 / (1 + np.exp(-z)))))
        return out

    def score(self, sentences: list[tuple[int, int, float]], n_sentences: int) -> float:
        """Noisy-or: the chance that at least one sentence is toxic."""
        rest = (n_sentences - len(sentences)) * np.logaddexp(0, self.intercept)
        return float(1 - np.exp(-rest + sum(np.log1p(-min(p, 1 - 1e-12)) for _, _, p in sentences)))


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents for which ``use`` (a condition on doc_id) holds.

    Words are counted and screened by Spark; the driver gets at most FIT_WORDS words and, for the sampled
    documents, the sentences that hold one. Without labelled documents of both kinds every score is 0.
    """
    prepare(docs.sparkSession)
    sample = labelled_texts(docs, labels, "toxic", rows, use)
    totals = sample.agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).first()
    if not totals["toxic"] or totals["toxic"] == totals["n"]:
        return ToxicityModel({}, -50.0)
    words = _screen(sample, totals["toxic"], totals["n"])
    return _learn(sample, words, totals["toxic"] / totals["n"])


def _screen(sample: DataFrame, toxic: float, n: int) -> list[str]:
    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Documents by word, counted per batch."""
        for batch in batches:
            every, bad = Counter(), Counter()
            for text, y in zip(batch["text"], batch["y"]):
                found = features(text)
                every.update(found)
                if y:
                    bad.update(found)
            yield pd.DataFrame({"word": list(every), "n": list(every.values()), "bad": [bad[w] for w in every]})

    share = toxic / n
    counted = (
        sample.mapInPandas(bags, "word string, n long, bad long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .filter(F.col("n") >= LEAST_DOCUMENTS)
        .withColumn("deviation", F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share)))
        .filter(F.col("deviation") >= LEAST_DEVIATION)
        .orderBy(F.desc("deviation"), "word")
        .limit(FIT_WORDS)
    )
    return sorted(row["word"] for row in counted.select("word").collect())


def _learn(sample: DataFrame, words: list[str], share: float) -> ToxicityModel:
    """Maximise the likelihood of the document labels over word weights and intercept (Adam, full batch)."""
    index = {word: i for i, word in enumerate(words)}

    def incidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rest, hits = [], []
            for text in batch["text"]:
                found = [index.keys() & features(s) for s in SENTENCE.findall(text)]
                rest.append(sum(not words for words in found))
                hits.append([sorted(index[w] for w in words) for words in found if words])
            yield pd.DataFrame({"y": batch["y"], "rest": rest, "hits": hits})

    rows = sample.mapInPandas(incidence, "y double, rest long, hits array<array<int>>").toPandas()
    y, rest = rows["y"].to_numpy(), rows["rest"].to_numpy(dtype=float)
    sentences = [(d, list(s)) for d, hits in enumerate(rows["hits"]) for s in hits]
    doc = np.array([d for d, _ in sentences], dtype=int)
    sentence = np.repeat(np.arange(len(sentences)), [len(s) for _, s in sentences])
    word = np.array([w for _, s in sentences for w in s], dtype=int)

    theta = np.zeros(len(words) + 1)  # the intercept comes last
    theta[-1] = np.log(share / max(1.0, rest.mean()))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        z = theta[-1] + np.bincount(sentence, theta[word], minlength=len(sentences))
        total = rest * np.logaddexp(0, theta[-1]) + np.bincount(doc, np.logaddexp(0, z), minlength=len(y))
        total = np.maximum(total, 1e-9)  # minus the log of the chance that no sentence is toxic
        slope = np.where(y > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0) / len(y)
        by_sentence = slope[doc] / (1 + np.exp(-z))
        gradient = np.append(np.bincount(word, by_sentence[sentence], minlength=len(words)), 0.0) + SHRINK * theta
        gradient[-1] = by_sentence.sum() + (slope * rest).sum() / (1 + np.exp(-theta[-1]))
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        rate = 0.2 * (1 - step / (ROUNDS + 1))
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return ToxicityModel(dict(zip(words, theta[:-1].tolist())), float(theta[-1]))


def assess(text: Column, model: ToxicityModel, sentence_threshold: float = 0.5) -> Column:
    """Struct of score, 0 to 1, and offending: the (start, end, score) of the sentences at or over the threshold."""

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def assessed(texts: pd.Series) -> pd.DataFrame:
        scores, spans = [], []
        for text in texts:
            found = model.sentences(text)
            scores.append(model.score(found, sum(1 for _ in SENTENCE.finditer(text or ""))))
            spans.append([dict(zip(("start", "end", "score"), s)) for s in found if s[2] >= sentence_threshold])
        return pd.DataFrame({"score": pd.Series(scores, dtype="float64"), "offending": pd.Series(spans, dtype=object)})

    return assessed(text)


def classify(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) of every row; held_out marks ids with crc32 mod 3 = 1.

    Null and empty texts have no sentence and score 0; repeated rows are scored alike; a null doc_id isn't
    held out; an empty table gives an empty table. Other columns are ignored.
    """
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    out = docs.select("doc_id", held_out.alias("held_out"), assess(F.col("text"), model).alias("found"))
    out = out.select("doc_id", "held_out", "found.score", "found.offending")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold."""
    return docs.filter(assess(docs["text"], model)["score"] < threshold)
