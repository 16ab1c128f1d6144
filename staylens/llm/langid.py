"""Language of words, spans and documents: script ranges, word scores and a Viterbi path with a switching penalty."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import crc_remainder, prepare

#: Character n-grams are counted in so many buckets; a model has one number per bucket and language.
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: What a change of language between two words costs, in units of log likelihood.
SWITCH = 12.0
#: A language is a candidate for a word if so much of its training text is in the word's script.
LEAST_SHARE = 0.01
#: Characters worked on at a time.
CHUNK = 1 << 20

# First code point of ranges of the Unicode standard, and the script of each range.
SCRIPT_STARTS = [
    0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200,
    0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000, 0x30000,
]
SCRIPTS = [
    "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "other", "thai", "other",
    "georgian", "hangul", "other", "latin", "greek", "other", "kana", "other", "han", "other", "hangul", "other", "han",
    "other", "han", "other",
]
NAMES = sorted(set(SCRIPTS))


@dataclass
class LanguageModel:
    """Languages, log likelihoods by bucket and language, and the candidates by script."""

    languages: list[str]
    table: np.ndarray
    candidates: np.ndarray


class Words:
    """The words, their n-grams and scripts in a run of texts. A word is a run of letters, in lower case."""

    def __init__(self, texts: list[str], letters: np.ndarray) -> None:
        lowered = [lower(text) for text in texts]
        joined = " " + " ".join(lowered) + "   "
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        self.is_letter = letters[points]
        points[~self.is_letter] = 32
        self.points = points
        edges = np.diff(self.is_letter.astype(np.int8))
        self.start = np.flatnonzero(edges == 1) + 1
        self.end = np.flatnonzero(edges == -1) + 1
        lengths = np.array([len(text) + 1 for text in lowered], dtype=np.int64)
        self.text_start = np.concatenate([[1], 1 + np.cumsum(lengths)])
        #: Position of each text's first word; one more for the end.
        self.first_word = np.searchsorted(self.start, self.text_start)
        codes = np.array([NAMES.index(script) for script in SCRIPTS])
        self.script = codes[np.searchsorted(SCRIPT_STARTS, points[self.start], side="right") - 1]

    def ngrams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order, by position, whether an n-gram begins there and its bucket. None reaches over a word's edge."""
        points, letter = self.points.astype(np.uint64), self.is_letter
        for order in ORDERS:
            count = len(points) - order
            inside = letter[1 : count + 1] | letter[:count] if order == 2 else letter[1 : count + 1].copy()
            for k in range(2, order - 1):
                inside &= letter[k : count + k]
            value = np.full(count, order, dtype=np.uint64)
            for k in range(order):
                value *= np.uint64(0x9E3779B97F4A7C15)
                value += points[k : count + k]
                value ^= value >> np.uint64(29)
            value *= np.uint64(0xBF58476D1CE4E5B9)
            yield inside, (value >> np.uint64(48)).astype(np.int64)


def lower(text: str) -> str:
    """Lower case without a change of length, so that positions hold in the text itself."""
    lowered = text.lower()
    return lowered if len(lowered) == len(text) else "".join(char.lower()[0] for char in text)


def letter_table() -> np.ndarray:
    """For every code point whether it is a letter. There are none beyond the planes of the Han script."""
    known = 0x32000
    table = np.zeros(sys.maxunicode + 1, dtype=bool)
    table[:known] = np.fromiter((chr(point).isalpha() for point in range(known)), dtype=bool, count=known)
    return table


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of the list with about CHUNK characters each; a longer text is alone in its slice."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > CHUNK:
            yield begin, i
            begin, held = i, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def slices(text: str, letters: np.ndarray) -> Iterator[tuple[int, str]]:
    """A long text in pieces of at most CHUNK characters, each with its start, cut between words; a word of more than half a CHUNK is cut too."""
    at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        if end < len(text):
            cut = end
            while cut > at + CHUNK // 2 and letters[ord(text[cut - 1])] and letters[ord(text[cut])]:
                cut -= 1
            end = cut if cut > at + CHUNK // 2 else end
        yield at, text[at:end]
        at = end


def fit(docs: DataFrame, use: Column | None = None) -> LanguageModel:
    """Learn from all rows of ``docs`` (text, lang) for which ``use`` holds and neither column is null.

    Every partition counts its n-grams and letters by language in arrays of a fixed size, which Spark adds
    up; the driver gets the sums.
    """
    prepare(docs.sparkSession)
    if use is not None:
        docs = docs.filter(use)
    docs = docs.filter("text is not null and lang is not null").select("text", "lang")
    parts, scripts = 16, len(NAMES)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                total = sums.setdefault(lang, np.zeros(BUCKETS + scripts, dtype=np.int64))
                texts = [piece for text in rows["text"] for _, piece in slices(text, letters)]
                for a, b in chunks(texts):
                    words = Words(texts[a:b], letters)
                    for inside, bucket in words.ngrams():
                        total[:BUCKETS] += np.bincount(bucket[inside], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(
                        words.script, words.end - words.start, minlength=scripts
                    ).astype(np.int64)
        rows = [(lang, i, part.tobytes()) for lang, total in sums.items() for i, part in enumerate(np.array_split(total, parts))]
        yield pd.DataFrame(rows, columns=["lang", "part", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s, dtype=np.int64) for s in rows["sums"]], axis=0)
        return rows.iloc[:1].assign(sums=[total.tobytes()])

    schema = "lang string, part int, sums binary"
    rows = docs.mapInPandas(count, schema).groupBy("lang", "part").applyInPandas(add, schema).collect()
    languages = sorted({row["lang"] for row in rows})
    totals = np.zeros((len(languages), BUCKETS + scripts))
    for i, lang in enumerate(languages):
        own = sorted((row for row in rows if row["lang"] == lang), key=lambda row: row["part"])
        totals[i] = np.concatenate([np.frombuffer(row["sums"], dtype=np.int64) for row in own])
    counts, by_script = totals[:, :BUCKETS] + 0.5, totals[:, BUCKETS:]
    table = np.log(counts / counts.sum(axis=1, keepdims=True)).T
    candidates = (by_script >= LEAST_SHARE * np.maximum(by_script.sum(axis=1, keepdims=True), 1)).T
    candidates[~candidates.any(axis=1)] = True  # a script that no language was seen in narrows nothing
    return LanguageModel(languages, np.ascontiguousarray(table), candidates)


def word_scores(words: Words, model: LanguageModel) -> np.ndarray:
    """Log likelihood of each word by language; languages that the script rules out are far behind."""
    total = np.zeros((len(words.points) + 1, len(model.languages)))
    table = np.vstack([model.table, np.zeros(len(model.languages))])  # the last row is for no n-gram
    for inside, bucket in words.ngrams():
        total[1 : len(bucket) + 1] += table.take(np.where(inside, bucket, BUCKETS), axis=0)
    np.cumsum(total, axis=0, out=total)
    scores = total[words.end] - total[words.start - 1]
    return np.where(model.candidates[words.script], scores, scores - 1e6)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the best path of its text; ``first`` has each text's first word, and the end.

    All texts take a step at a time together, the longest first, so that a step is one operation on arrays.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    if not longest:
        return np.zeros(len(scores), dtype=np.int64)
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # texts with more than t words
    offset = np.concatenate([[0], np.cumsum(active)])
    # The words by their place in their text and then by text, so that a step is a slice.
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = offset[np.arange(len(scores)) - first[text]] + rank[text]
    ordered = np.empty((scores.shape[1], len(scores)))
    ordered[:, place] = scores.T
    stay = np.ones(ordered.shape, dtype=bool)
    jump = np.zeros(len(scores), dtype=np.int32)
    best = ordered[:, : active[0]].copy()
    for t in range(1, longest):
        n, at = active[t], slice(offset[t], offset[t + 1])
        previous = best[:, :n]
        moved = previous.max(axis=0) - switch
        np.greater_equal(previous, moved, out=stay[:, at])
        jump[at] = previous.argmax(axis=0)
        np.maximum(previous, moved, out=previous)
        previous += ordered[:, at]
    state = np.zeros(active[0], dtype=np.int64)
    found = np.zeros(len(scores), dtype=np.int64)
    for t in range(longest - 1, -1, -1):
        n, at = active[t], slice(offset[t], offset[t + 1])
        ending = active[t + 1] if t + 1 < longest else 0
        state[ending:n] = best[:, ending:n].argmax(axis=0)
        found[at] = state[:n]
        stays = stay[:, at][state[:n], np.arange(n)]
        state[:n] = np.where(stays, state[:n], jump[at])
    return found[place]


def long_path(text: str, model: LanguageModel, switch: float, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and language of each word of one long text, slice by slice.

    The scores of the best paths go from slice to slice; what is kept of a word are its place, a flag per
    language and the language to come from, so the scores of the whole text are never held.
    """
    many = len(model.languages)
    starts, ends, flags, comes_from = [], [], bytearray(), array("l")
    best: list[float] = []
    for at, piece in slices(text, letters):
        words = Words([piece], letters)
        starts.append(words.start - words.text_start[0] + at)
        ends.append(words.end - words.text_start[0] + at)
        for row in word_scores(words, model).tolist():
            if not best:
                best, leader, stays = row, 0, [True] * many
            else:
                top = max(best)
                leader, moved = best.index(top), top - switch
                stays = [old >= moved for old in best]
                best = [(old if stay else moved) + new for old, stay, new in zip(best, stays, row)]
            flags.extend(stays)
            comes_from.append(leader)
    labels = np.zeros(len(comes_from), dtype=np.int64)
    state = best.index(max(best)) if best else 0
    for t in range(len(labels) - 1, -1, -1):
        labels[t] = state
        if not flags[t * many + state]:
            state = comes_from[t]
    return np.concatenate([*starts, np.zeros(0, dtype=np.int64)]), np.concatenate([*ends, np.zeros(0, dtype=np.int64)]), labels


def identify(text: Column, model: LanguageModel, switch: float = SWITCH) -> Column:
    """Struct of lang_pred, score and spans: (start, end, lang) over runs of words in one language.

    lang_pred is the language with the most letters and score its share of all letters. Null texts and texts
    without a letter, and all texts if no language was learnt, are ``und`` with score 0 and no spans.
    """

    @F.pandas_udf("lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    def identified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for texts in batches:
            yield answers(texts, letters)

    def paths(texts: list[str], letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Start, end and language of the words of each text."""
        nothing = np.zeros(0, dtype=np.int64)
        if not model.languages:
            yield from [(nothing, nothing, nothing)] * len(texts)
        elif len(texts) == 1 and len(texts[0]) > CHUNK:
            yield long_path(texts[0], model, switch, letters)
        else:
            words = Words(texts, letters)
            labels = viterbi(word_scores(words, model), words.first_word, switch)
            for i in range(len(texts)):
                own = slice(words.first_word[i], words.first_word[i + 1])
                yield words.start[own] - words.text_start[i], words.end[own] - words.text_start[i], labels[own]

    def answers(texts: pd.Series, letters: np.ndarray) -> pd.DataFrame:
        values = ["" if text is None else text for text in texts]
        langs, scores, spans = [], [], []
        for a, b in chunks(values):
            for start, end, labels in paths(values[a:b], letters):
                if not len(labels):
                    langs.append("und"), scores.append(0.0), spans.append([])
                    continue
                share = np.bincount(labels, end - start, minlength=len(model.languages))
                top = int(share.argmax())
                langs.append(model.languages[top]), scores.append(float(share[top] / share.sum()))
                turns = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1])
                lasts = np.append(turns[1:], len(labels)) - 1
                spans.append(
                    [
                        {"start": int(s), "end": int(e), "lang": model.languages[int(k)]}
                        for s, e, k in zip(start[turns], end[lasts], labels[turns])
                    ]
                )
        return pd.DataFrame(
            {
                "lang_pred": pd.Series(langs, dtype=object),
                "score": pd.Series(scores, dtype="float64"),
                "spans": pd.Series(spans, dtype=object),
            }
        )

    return identified(text)


def predict(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) of every row; held_out marks ids whose crc32 is divisible by 5.

    A text of more than CHUNK characters is worked on in slices, so its size doesn't decide the memory it takes.
    Repeated rows get the same answer, a null doc_id isn't held out, an empty table gives an empty table, and
    other columns are ignored.
    """
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    out = docs.select("doc_id", held_out.alias("held_out"), identify(F.col("text"), model, switch).alias("found"))
    return out.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.spans")
