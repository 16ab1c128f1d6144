"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm import (
    ann,
    embedding_dedup,
    langid,
    licenses,
    line_dedup,
    minhash_dedup,
    mixing,
    packing,
    prefix_trie,
    quality,
    sharding,
    toxicity,
    whitening,
)
from staylens.llm.common import crc_remainder, prepare

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.classify(docs, _toxicity_model(spark, docs, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), shards=8)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs, crc_remainder(F.col("doc_id"), 5) != 0))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, _quality_model(spark, docs, sf_dir))


def op10_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.build(_table(spark, sf_dir, "embeddings"))
    return ann.search(index, index.rows.filter("vec_id % 20 = 0"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    turns = prefix_trie.rebuild(prefix_trie.sequences(_table(spark, sf_dir, "conversations")))
    trie = prefix_trie.build(turns)
    digests = prefix_trie.ends_sha256(trie.members)
    nodes = trie.nodes.withColumnRenamed("saved_bytes", "saved_tokens").join(digests, "ends", "left")
    return nodes.drop("ends").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))


def _toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    return toxicity.fit(docs, _table(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 3) != 1)


def _quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.QualityModel:
    return quality.fit(docs, _table(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 5) != 0)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, _quality_model(spark, docs, sf_dir))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that aren't toxic."""
    return toxicity.keep_clean(docs, _toxicity_model(spark, docs, sf_dir))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: one document of each group of near-duplicates (five words, 0.8)."""
    return minhash_dedup.keep_first(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents as often as the mix of sources takes them."""
    return mixing.repeat_documents(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: where the words of each document go."""
    return packing.best_fit(docs)


STAGES = [
    ("quality", good_documents),
    ("toxicity", clean_documents),
    ("near_duplicates", distinct_documents),
    ("mixing", mixed_documents),
    ("packing", packed_documents),
]

QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_sharding": op7_sharding,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_permutation_search": op10_permutation_search,
    "op11_line_dedup": op11_line_dedup,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}

OP1_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
    FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION
    SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""

OP2_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
    SELECT vec_id AS x, vec_id AS y FROM embeddings
    UNION
    SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), groups AS (
    SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x
), counts AS (
    SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM groups LEFT JOIN counts USING (vec_id)
"""

OP11_SQL = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
    SELECT doc_id, pos, lines[pos] AS line,
        trim(translate(lines[pos], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM split)
), repeated AS (
    SELECT key, max(doc_id) AS holder FROM numbered WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT doc_id, pos, line, holder IS NOT NULL AND holder <> doc_id AS gone FROM numbered LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

# DuckDB has no crc32, so it is folded over the bytes of the decimal number.
OP13_SQL = r"""
WITH RECURSIVE ordered AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
        struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list(t ORDER BY pos) AS turns FROM ordered GROUP BY conv_id
), crc AS (
    SELECT conv_id, 0 AS step, 4294967295::BIGINT AS c FROM own
    UNION ALL
    SELECT conv_id, step + 1, list_reduce(
        list_concat([xor(c, ascii(substr(conv_id::VARCHAR, step + 1, 1))::BIGINT)], [0::BIGINT for i in range(8)]),
        lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))
    FROM crc WHERE step < length(conv_id::VARCHAR)
), heads AS (
    SELECT conv_id, (xor(c, 4294967295::BIGINT) % 9)::INT AS h FROM crc WHERE step = length(conv_id::VARCHAR)
), rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:h], o.turns[h + 1:]) AS turns
    FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), prefixes AS (
    SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt
), cut AS (
    SELECT conv_id, depth, turns[1:depth] AS prefix, turns, depth = len(turns) AS is_end FROM prefixes
), nodes AS (
    SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '') AS ends,
        count(DISTINCT turns[1:depth + 1]) FILTER (NOT is_end) AS n_children
    FROM cut GROUP BY depth, prefix
), sized AS (
    SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(prefix[depth].text) END AS saved FROM nodes
), below AS (
    SELECT unnest(range(0, depth + 1)) AS up, prefix, saved, n_children FROM sized
), sums AS (
    SELECT up AS depth, prefix[1:up] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM below GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
    sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.prefix = n.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""

ORACLES: dict[str, str] = {
    "op1_minhash_dedup": OP1_SQL,
    "op2_embedding_dedup": OP2_SQL,
    "op6_license_scan": licenses.oracle(),
    "op11_line_dedup": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
