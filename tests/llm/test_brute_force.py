"""Packing, the noisy-or fit, the ridge fit and the isotonic step against plain references on small input."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.llm import embedding_dedup, mixing, packing, quality, toxicity


def packed_by_hand(sizes, lengths, sequence_cost):
    """Bins as (capacity in the end, pieces in the order they came): every step looks at all bins and all pieces to come."""
    coming = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    bins = []  # room, time of the last change, pieces
    for step, piece in enumerate(coming):
        size = sizes[piece]
        fitting = [b for b in bins if b[0] >= size]
        if fitting:
            chosen = min(fitting, key=lambda b: (b[0], -b[1]))
        else:
            costs = []
            for length in sorted(lengths):
                if length >= size:
                    filled, rest = size, [sizes[k] for k in coming[step + 1 :]]
                    while any(r <= length - filled for r in rest):
                        largest = max(r for r in rest if r <= length - filled)
                        rest.remove(largest)
                        filled += largest
                    costs.append(((length + sequence_cost) / filled, length))
            chosen = [min(costs)[1], step, []]
            bins.append(chosen)
        chosen[0] -= size
        chosen[1] = step
        chosen[2].append(piece)
    return sorted((min(n for n in lengths if n >= sum(sizes[p] for p in b[2])), b[2]) for b in bins)


@pytest.mark.parametrize("seed", range(12))
def test_packing_equals_the_plain_rule(seed):
    rng = np.random.default_rng(seed)
    lengths = [[8, 16, 40], [10], [7, 30, 31], [64, 16]][seed % 4]
    sizes = rng.integers(1, max(lengths) + 1, 60).tolist() if seed % 3 else rng.integers(1, 9, 60).clip(max=max(lengths)).tolist()
    bins, offsets, capacity = packing.pack(sizes, lengths, int(rng.integers(0, 9)))
    rng = np.random.default_rng(seed)
    rng.integers(1, max(lengths) + 1, 60) if seed % 3 else rng.integers(1, 9, 60)
    found = [(capacity[b], [p for p in sorted(range(60), key=lambda k: offsets[k]) if bins[p] == b]) for b in range(len(capacity))]
    assert sorted(found) == packed_by_hand(sizes, lengths, int(rng.integers(0, 9)))


def test_a_frequent_id_makes_no_large_packing_group(spark, monkeypatch):
    """A third of the rows have no id and one size; no task packs more than GROUP pieces and every row comes back."""
    monkeypatch.setattr(packing, "GROUP", 400)
    seen = spark.sparkContext.accumulator(0)
    pack = packing.pack

    def spied(sizes, lengths, cost):
        if len(sizes) > 400:
            seen.add(1)
        return pack(sizes, lengths, cost)

    monkeypatch.setattr(packing, "pack", spied)
    rows = [(None if i % 3 == 0 else i, "a b" if i % 3 == 0 else "c " * (i % 7 + 1)) for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.best_fit(docs)
    assert out.count() == 6_000 and out.where("doc_id is null").agg(F.sum("size")).first()[0] == 4_000
    ends = out.groupBy("bin_id").agg(F.sum("size").alias("filled"), F.max(F.col("bin_offset") + F.col("size")).alias("end"), F.max("bin_length").alias("n"))
    assert ends.where("filled != end or end > n").count() == 0
    assert seen.value == 0


def test_targets_of_very_many_sources(spark, monkeypatch):
    """Places and the level of sharing by hand; sources take several ranges, and many rounds until none is over its limit."""
    monkeypatch.setattr(mixing, "CHUNK", 40)
    rng = np.random.default_rng(2)
    sizes = {f"s{i:03d}": int(1.08 ** rng.integers(0, 180)) for i in range(200)} | {None: 50, "é": 7, "Z": 3, "z": 0}
    rows = [(1, source, size) for source, size in sizes.items()]
    got = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame(rows, "doc_id long, source string, size long"), (1, 2, 3)).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    assert {s: got[s]["place"] for s in order} == {s: i for i, s in enumerate(order)}
    full: set = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in order:
        assert abs(got[s]["target"] - (3 * sizes[s] if s in full else level * weight[s])) <= 1e-9 * sum(sizes.values())


def labelled(spark, rows, label):
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], f"doc_id long, {label} int")


def test_ridge_and_isotonic_steps_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "x", "12", "###", "gamma."]
    rows = [(" ".join(rng.choice(words, int(rng.integers(1, 30)))), int(rng.random() < 0.2 + 0.6 * (i % 2))) for i in range(60)]
    docs, labels = labelled(spark, rows, "quality")
    model = quality.fit(docs.repartition(5), labels)
    x = np.array([quality.statistics(text) for text, _ in rows])
    y = np.array([label for _, label in rows], dtype=float)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
    z = model.features(x)
    # Least squares over the rows and, for the penalty, a row per weight.
    penalty = math.sqrt(quality.RIDGE * len(rows)) * np.eye(z.shape[1])
    weights = np.linalg.lstsq(np.vstack([z, penalty]), np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ weights, atol=1e-6)
    step = np.rint(np.clip(z @ model.weights, -1, 2) * quality.STEPS).astype(int)
    at, inverse = np.unique(step, return_inverse=True)
    n, good = np.bincount(inverse), np.bincount(inverse, y)
    got = np.interp(at / quality.STEPS, model.steps, model.values)
    # The rising fit with the least squares, by dynamic programming over its pools.
    best = [(0.0, [])]
    for end in range(1, len(at) + 1):
        choices = []
        for start in range(end):
            mean = good[start:end].sum() / n[start:end].sum()
            before = best[start]
            if before is not None and (not before[1] or before[1][-1][2] <= mean + 1e-12):
                loss = sum(n[k] * mean**2 - 2 * mean * good[k] for k in range(start, end))
                choices.append((before[0] + loss, [*before[1], (start, end, mean)]))
        best.append(min(choices, key=lambda c: c[0]) if choices else None)
    wanted = np.concatenate([[mean] * (end - start) for start, end, mean in best[-1][1]])
    assert np.allclose(got, wanted)


def test_the_noisy_or_fit_is_at_the_optimum_of_a_plain_loss(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 1_500)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        sentences = [" ".join(rng.choice(["sun", "rain", "wind", "tree", "lake"], 4)) + "." for _ in range(int(rng.integers(1, 5)))]
        if i % 3 == 0:
            sentences[int(rng.integers(len(sentences)))] = "you vile " + str(rng.choice(["sun", "wind"])) + "."
        rows.append((" ".join(sentences), int(i % 3 == 0 and i % 21 != 0)))
    docs, labels = labelled(spark, rows, "toxic")
    model = toxicity.fit(docs, labels)
    words = sorted(model.weights)
    assert "vile" in words

    def loss(theta):
        total = 0.0
        for text, y in rows:
            alone = 1.0
            for sentence in toxicity.SENTENCE.findall(text):
                z = theta[-1] + sum(theta[k] for k, word in enumerate(words) if word in toxicity.features(sentence))
                alone *= 1 - 1 / (1 + math.exp(-z))
            total -= math.log(max(1 - alone, 1e-300)) if y else math.log(max(alone, 1e-300))
        return total / len(rows) + toxicity.SHRINK / 2 * sum(t * t for t in theta[:-1])

    theta = [model.weights[word] for word in words] + [model.intercept]
    here = loss(theta)
    for k, move in itertools.product(range(len(theta)), (-0.2, 0.2)):
        moved = list(theta)
        moved[k] += move
        assert loss(moved) > here - 1e-5, (k, move)
    score = {text: model.score(model.sentences(text), len(toxicity.SENTENCE.findall(text))) for text, _ in rows}
    for text, _ in rows[:20]:
        alone = math.prod(
            1 - 1 / (1 + math.exp(-(model.intercept + sum(model.weights.get(w, 0) for w in toxicity.features(s))))) for s in toxicity.SENTENCE.findall(text)
        )
        assert abs(score[text] - (1 - alone)) < 1e-9


def test_embedding_links_against_all_pairs(spark):
    """16,000 vectors, most in pairs and triples just above and below the threshold: every exact link is found, and no other."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((6_000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = []
    for at, cosine in zip(rng.integers(0, 6_000, 10_000), rng.uniform(0.88, 0.93, 10_000)):
        away = rng.standard_normal(32)
        away -= (away @ base[at]) * base[at]
        near.append(cosine * base[at] + math.sqrt(1 - cosine**2) * away / np.linalg.norm(away))
    vectors = np.vstack([base, near]) * rng.uniform(0.5, 4, (16_000, 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    links = np.zeros(16_000, dtype=int)
    for start in range(0, 16_000, 1_000):
        links[start : start + 1_000] = (unit[start : start + 1_000] @ unit.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(table.repartition(8)).collect()}
    found = np.array([got[i] for i in range(16_000)])
    assert links.sum() > 10_000 and (found <= links).all()
    assert found.sum() >= 0.999 * links.sum()
