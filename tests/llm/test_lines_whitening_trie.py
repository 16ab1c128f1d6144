"""Operators 11 to 13 against brute force, on odd rows, and with small bounds so that every route is taken."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.llm import line_dedup, prefix_trie, queries, whitening

WHITE = " \t\n\x0b\x0c\r"


# --- op11 ---------------------------------------------------------------------------------------


def lines_by_hand(rows, least_chars=40, least_docs=5):
    """(doc_id, text, n_lines, n_dropped) of (doc_id, text) rows."""

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    holders = defaultdict(set)
    below = -(1 << 63)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(below if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = below if doc_id is None else doc_id
        kept = [line for line in lines if not (len(holders[key(line)]) >= least_docs and max(holders[key(line)]) != own)]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def repeated_lines():
    rng = random.Random(5)
    common = [f"{word} line number {i} that many documents repeat in their text" for i, word in enumerate(("Alpha", "Élan", "ГАЗ", "x"))]
    common += ["é" * 39, "é" * 40, "short", "", "Z" * 40 + "İ"]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t\r"]) + rng.choice([str.upper, str])(rng.choice(common)) for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(None, common[0]), (None, common[0] + "\n" + common[1]), (None, None), (3, common[2]), (3, common[2]), (61, ""), (62, "\n"), (63, None)]
    rows += [(64, "\n".join([common[0]] * 3)), (65, "word " * 200_000 + "\n" + common[3]), (-7, common[3] + "\r\n" + common[3])]
    return rows


@pytest.mark.parametrize("broadcast_bytes", [line_dedup.BROADCAST_BYTES, 0])
def test_lines_against_brute_force(spark, monkeypatch, broadcast_bytes):
    if not broadcast_bytes:
        monkeypatch.setattr(line_dedup, "PROBES", 7)
        monkeypatch.setattr(line_dedup, "SHARD_LINES", 2)
    rows = repeated_lines()
    docs = spark.createDataFrame([(*row, 1, "x", "y") for row in rows], "doc_id long, text string, row int, dropped string, hi string")
    got = line_dedup.drop_repeated_lines(docs.repartition(6), broadcast_bytes=broadcast_bytes)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert Counter(map(tuple, got.collect())) == lines_by_hand(rows)
    assert line_dedup.drop_repeated_lines(docs.limit(0), broadcast_bytes=broadcast_bytes).count() == 0


def test_both_routes_agree_on_the_test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ways = [Counter(map(tuple, line_dedup.drop_repeated_lines(docs, 20, 2, size).collect())) for size in (1 << 20, 0)]
    assert ways[0] == ways[1] == lines_by_hand([(r.doc_id, r.text) for r in docs.collect()], 20, 2)


def test_the_hash_is_minimal_and_perfect_and_strangers_are_not_found():
    rng = np.random.default_rng(2)
    for many in (0, 1, 2, 63, 5_000):
        hashes = rng.integers(-(1 << 63), 1 << 63, (many, 2), dtype=np.int64)
        hashes[: many // 2, 0] = 7  # half of them differ in one word only
        levels = line_dedup.minimal_perfect_hash(hashes)
        at = line_dedup.places(levels, line_dedup.ranks(levels), hashes)
        assert sorted(at.tolist()) == list(range(many))
        fingerprints = np.empty(many, dtype=np.int64)
        fingerprints[at] = hashes[:, 1]
        zeros = np.zeros(many, dtype=np.int64)
        shard = line_dedup.Shard(0, [v.tobytes() for v in levels], fingerprints.tobytes(), zeros.astype(np.uint32).tobytes(), zeros.tobytes())
        strangers = rng.integers(-(1 << 63), 1 << 63, (9_000, 2), dtype=np.int64)
        assert not shard.is_dropped(strangers, np.ones(9_000, dtype=np.int64)).any() if many else True
        assert shard.is_dropped(hashes, np.ones(many, dtype=np.int64)).all()


# --- op12 ---------------------------------------------------------------------------------------


def whitened_by_hand(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, dtype=float)) + 100_000
    centred = x - x.mean(axis=0)
    covariance = centred.T @ centred / len(x)
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    exact = [sum((len(x) * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0))) for row in x]
    return centred @ directions / np.sqrt(values), values / covariance.trace(), exact


def test_whitening_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(4)
    spread = np.array([3, 1, 1.0001, 1, 0.5, 0.4, 0.3, 0.3, 0.2, 0.1])
    vectors = (rng.standard_normal((700, 10)) * spread @ np.linalg.qr(rng.standard_normal((10, 10)))[0] + 5).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(40)
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rows = whitening.whiten(table).orderBy("vec_id", "component").collect()
    got = np.array([r.whitened for r in rows]).reshape(700, 8)
    want, shares, exact = whitened_by_hand(vectors)
    assert np.allclose(got, want * np.sign((got * want).sum(axis=0)), atol=1e-9)
    assert np.allclose([r.explained for r in rows[:8]], shares, rtol=1e-12)
    assert [r.deviation for r in rows[::8]] == exact
    assert {(r.n, r.component) for r in rows} == {(700, c) for c in range(1, 9)}
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10
    assert sorted(map(tuple, whitening.whiten(table).collect())) == sorted(map(tuple, rows)), "reruns agree"


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.5]), (1, [0.1, 0.5]), (None, [0.4, -0.2]), (2, [0.9, 0.3]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [0.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 5.0]), (11, [4.0]), (12, [1e30, 1.0, -1e30])]
    table = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, n string, dim int")
    out = whitening.whiten(table).collect()
    assert Counter((r.vec_id, r.n) for r in out if r.n == 5) == {(1, 5): 4, (None, 5): 2, (2, 5): 2, (8, 5): 2}
    three = [r for r in out if r.n == 3]
    assert {r.vec_id for r in three} == {9, 10, 12} and {r.deviation for r in three} == {None}
    assert {r.vec_id for r in out} == {1, None, 2, 8, 9, 10, 12}, "a single vector has no component"
    assert all(r.identity_error < 1e-6 and r.whitened is not None for r in out)
    assert whitening.whiten(table.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0, "equal vectors have no component"


@pytest.mark.parametrize("values", [[5.0] * 6, [4, 4, 4, 1, 1, 0], [1, 0, 0, 0, 0, 0], [1e9, 1e3, 1, 1e-2, 0, 0], [7, 7 - 1e-9, 7 - 2e-9, 3, 3, 3]])
def test_eigenpairs_of_clusters(values):
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((6, 6)))[0]
    for matrix in (basis @ np.diag(values) @ basis.T, np.diag(np.array(values, dtype=float))):
        matrix = (matrix + matrix.T) / 2
        found, vectors = whitening.leading_eigenpairs(matrix, 8)
        wanted = np.sort(np.linalg.eigvalsh(matrix))[::-1]
        wanted = wanted[wanted > whitening.LEAST_VARIANCE * wanted[0]]
        assert np.allclose(found, wanted, rtol=0, atol=1e-13 * wanted[0])
        assert np.allclose(matrix @ vectors.T, vectors.T * found, rtol=0, atol=1e-12 * wanted[0])
        assert np.allclose(vectors @ vectors.T, np.eye(len(found)), atol=1e-12)


def test_sturm_counts():
    rng = np.random.default_rng(6)
    diagonal, off = rng.standard_normal(30), rng.standard_normal(29)
    off[11] = 0
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-4, 4, 50)
    assert whitening.count_above(diagonal, off, at).tolist() == [(values > x).sum() for x in at]


# --- op13 ---------------------------------------------------------------------------------------


def trie_by_hand(rows):
    """Nodes of rows (conv_id, turn, role, text) as the query returns them, in the order of its columns' names."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below = [sums[k] for k in kids[path]]
        sums[path] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = []
    for path, inside in members.items():
        ends = ",".join(str(c) for c in sorted(inside) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(inside), len(path), digest, len(kids[path]), len(inside), sums[path][0], parent, sums[path][1]))
    return Counter(out)


def trie_of(spark, tmp_path, rows, schema="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op13_prefix_trie(spark, str(tmp_path))
    return found.select("conv_id", "depth", "ends_sha256", "n_children", "n_convs", "n_leaves", "parent_conv_id", "saved_tokens")


@pytest.mark.parametrize(("fan_in", "parts", "letters", "longest"), [(64, 8, 3, 6), (2, 30, 2, 9), (3, 17, 1, 12), (2, 9, 5, 3)])
def test_trie_against_brute_force(spark, tmp_path, monkeypatch, fan_in, parts, letters, longest):
    monkeypatch.setattr(prefix_trie, "FAN_IN", fan_in)
    monkeypatch.setattr(prefix_trie, "LEAST_PARTS", parts)
    rng = random.Random(letters)
    rows = [(c, t, rng.choice(["user", "bot"][: letters]), "né"[: rng.randrange(1, 3)] * rng.randrange(1, letters + 1))
            for c in rng.sample(range(-40, 400), 180) for t in range(rng.randrange(1, longest + 1))]
    assert Counter(map(tuple, trie_of(spark, tmp_path, rows).collect())) == trie_by_hand(rows)


def test_trie_of_copies_and_nested_conversations(spark, tmp_path, monkeypatch):
    """Most conversations are equal or prefixes of each other; partitions then share long borders."""
    monkeypatch.setattr(prefix_trie, "FAN_IN", 2)
    rows = [(c, t, "user", f"turn {t}") for c in range(60) for t in range(c % 23 + 1)]
    rows += [(c, t, "user", "the same") for c in range(60, 200) for t in range(4)]
    assert Counter(map(tuple, trie_of(spark, tmp_path, rows).collect())) == trie_by_hand(rows)


def test_trie_of_odd_rows(spark, tmp_path):
    rows = [(5, 1, "user", "b"), (5, None, None, None), (5, 1, "user", "b"), (6, 2, "", "x" * 400_000), (6, 0, "user", ""),
            (None, 1, "user", "lost"), (10, 0, "u", "ser"), (15, 0, "us", "er"), (0, None, "user", "a"), (3, 9, "user", "a")]
    odd = [(*row, 1, "k", 2) for row in rows]
    schema = "conv_id long, turn long, role string, text string, depth int, kind string, grp int"
    assert Counter(map(tuple, trie_of(spark, tmp_path, odd, schema).collect())) == trie_by_hand(rows)
    assert trie_of(spark, tmp_path, [], schema).count() == 0
    assert trie_of(spark, tmp_path, [(None, 1, "user", "lost")]).count() == 0


def test_members_name_the_conversations_that_end_at_a_node(spark):
    turns = spark.createDataFrame([(c, [("aa" * 16, 3)] * (c % 3)) for c in range(7)], "conv_id long, turns array<struct<digest:string,bytes:bigint>>")
    trie = prefix_trie.build(turns)
    assert {(r.depth, r.ends, r.n_convs) for r in trie.nodes.collect()} == {(0, 0, 7), (1, 1, 4), (2, 2, 2)}
    assert {(r.ends, r.conv_id) for r in trie.members.collect()} == {(c % 3, c) for c in range(7)}
    hashes = prefix_trie.ends_sha256(trie.members).orderBy("ends").collect()
    assert [r.ends_sha256 for r in hashes] == [hashlib.sha256(t).hexdigest() for t in (b"0,3,6", b"1,4", b"2,5")]


def test_long_end_lists_stream_over_batches(spark):
    members = spark.range(5_000).select(F.lit(3).cast("long").alias("ends"), F.col("id").alias("conv_id"))
    want = hashlib.sha256(",".join(map(str, range(5_000))).encode()).hexdigest()
    assert prefix_trie.ends_sha256(members.repartition(7)).collect() == [(3, want)]
