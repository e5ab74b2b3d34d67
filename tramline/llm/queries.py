"""The queries of this subpackage, one for each operator, and what of them SQL can say."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, divergence, packing, personal_data, quality, simhash, sp_bpe, spelling, substring_dedup, suffix_dedup, syncmers, token_scan, toxicity
from .common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.digest(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_syncmer_fingerprints": op5_syncmer_fingerprints,
    "op6_token_counts": op6_token_counts,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_personal_data": op13_personal_data,
}

#: What SQL can say. The others hold models, tokenizers or hashes that it lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {
    # Every 400 bytes from every byte on, as hexadecimal digits; starts that occur twice; their union; what lies between.
    "op1_suffix_array_dedup": """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents), n AS (SELECT doc_id, hx, len(hx) // 2 AS n_bytes FROM d),
    w AS (SELECT doc_id, i, md5(substr(hx, 2 * i + 1, 800)) AS h FROM (SELECT doc_id, hx, unnest(range(0, n_bytes - 399)) AS i FROM n WHERE n_bytes >= 400) AS x),
    s AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM w) AS x WHERE c > 1),
    g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM s) AS x),
    r AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, k),
    p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_b, a AS to_b, b - a AS gone FROM r),
    t AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) AS n_spans, max(to_b + gone) AS last FROM p GROUP BY doc_id),
    k AS (SELECT p.doc_id AS doc_id, string_agg(substr(hx, 2 * from_b + 1, 2 * (to_b - from_b)), '' ORDER BY from_b) AS kept FROM p JOIN n ON p.doc_id = n.doc_id GROUP BY p.doc_id)
    SELECT n.doc_id AS doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM n LEFT JOIN t ON n.doc_id = t.doc_id LEFT JOIN k ON n.doc_id = k.doc_id
    """,
    # Counts of (lang, source, term) for all sources and kept terms; whole-number probabilities; pairs of sources and terms ranked.
    "op11_source_divergence": r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3), g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, source, term),
    x AS (SELECT g.lang AS lang, g.source AS source, k.term AS term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    gs AS (SELECT lang, source, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM x GROUP BY lang, source),
    p AS (SELECT x.lang AS lang, x.source AS source, term, n, 1 + 1000000000 * (n + 1) // (total + v) AS p FROM x JOIN gs ON x.lang = gs.lang AND x.source = gs.source),
    ls AS (SELECT lang, sum(total)::HUGEINT AS total, max(v)::HUGEINT AS v FROM gs GROUP BY lang),
    q AS (SELECT y.lang AS lang, term, 1 + 1000000000 * (n + 1) // (total + v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM x GROUP BY lang, term) AS y JOIN ls ON y.lang = ls.lang),
    f AS (SELECT a.lang AS lang, a.source AS source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
    pairs AS (SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (SELECT p.lang AS lang, source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) AS u)
    SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    # crc32 by its table, from the polynomial; near words by equal rests; forms followed by recursion.
    "op12_spelling_variants": r"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i)) AS tab),
    d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
    r AS (SELECT run, count(*) AS n, hex(encode(id || ':' || run)) AS hx FROM d WHERE length(run) >= 7 GROUP BY id, run),
    h AS (SELECT run, n, xor(list_reduce(list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM r, crc),
    o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    e AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w) AS x),
    near AS (SELECT a.word AS word, b.word AS other, b.n AS n FROM e AS a JOIN e AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT e.word AS word, w.word AS other, w.n AS n FROM e JOIN w ON e.rest = w.word UNION SELECT w.word AS word, e.word AS other, e.n AS n FROM e JOIN w ON e.rest = w.word),
    b AS (SELECT word, other, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
    f AS (SELECT w.word AS word, w.n AS n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n FROM w LEFT JOIN b ON b.word = w.word AND b.k = 1),
    t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word AS word, f.form AS root FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
    SELECT f.word AS word, f.form AS form, t.root AS root, f.n AS n, f.n_near AS n_near, f.form_n AS form_n FROM f JOIN t ON t.word = f.word JOIN f AS g ON g.word = t.root WHERE g.form IS NULL
    """,
}
