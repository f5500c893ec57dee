"""The queries of this subpackage for the registry, with SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlake.llm.gif import store_and_read
from siftlake.llm.grid_join import near_vectors
from siftlake.llm.license_scan import _votes, scan
from siftlake.llm.line_dedup import dedup_lines
from siftlake.llm.minhash import near_duplicates
from siftlake.llm.packing import pack
from siftlake.llm.quality import score_quality
from siftlake.llm.sentencepiece_fst import round_trip
from siftlake.llm.suffix_dedup import drop_repeats
from siftlake.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op5_toxicity_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"), digest=True)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(_table(spark, sf_dir, "documents"), digest=True)


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_grid_order_join": op2_grid_order_join,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_toxicity_classifier": op5_toxicity_classifier,
    "op6_sentencepiece_fst": op6_sentencepiece_fst,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_gif_media": op10_gif_media,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    """Base places by comparing words; the other labels by votes on diagonals."""
    votes = ", ".join(f"({t}, '{label}', {phrase}, {n}, {i}, '{a}', '{b}')" for t, label, phrase, n, i, a, b in _votes())
    return rf"""
WITH votes(t, label, phrase, votes, i, a, b) AS (VALUES {votes}),
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, unnest(range(0, len(w) - 1)) AS pos, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS b FROM w WHERE len(w) > 1),
base AS (SELECT r, pos, 'mit' AS label FROM p WHERE a = 'mit' AND b = 'license' UNION ALL SELECT r, pos, 'apache' FROM p WHERE a = 'apache' AND b = 'license'
 UNION ALL SELECT x.r, x.pos, 'gpl' FROM p x JOIN p y ON x.r = y.r AND y.pos = x.pos + 1 WHERE x.a = 'general' AND x.b = 'public' AND y.b = 'license'),
line AS (SELECT r, t, label, phrase, votes, pos - i AS d, count(*) AS got, min(pos) AS low, max(pos) AS high FROM p JOIN votes v ON p.a = v.a AND p.b = v.b GROUP BY ALL),
island AS (SELECT *, sum(c) OVER (PARTITION BY r, t ORDER BY d) AS island FROM (
 SELECT *, (phrase OR d - coalesce(lag(d) OVER (PARTITION BY r, t ORDER BY d), -1000000000) > 3)::INT AS c FROM line)),
span AS (SELECT r, label, phrase, sum(got)::BIGINT AS got, any_value(votes) AS votes, max(high) - min(low) + 1 AS wide FROM island GROUP BY r, t, label, phrase, island),
judged AS (SELECT r, label, phrase, least(got / votes, 1.0) AS share, CASE WHEN phrase THEN got = votes ELSE got / votes >= 0.75 AND 2 * got >= wide END AS found,
 CASE WHEN phrase THEN got = votes ELSE 2 * got >= wide END AS real FROM span),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
j AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found) AS labels, max(share) FILTER (real) AS score FROM judged GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
 coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN b ON b.r = w.r LEFT JOIN j ON j.r = w.r
"""


ORACLE_SQL: dict[str, str] = {
    "op2_grid_order_join": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
 WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
 WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM reach r JOIN link l ON l.a = r.node WHERE r.low < l.b),
comp AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node), near AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON node = vec_id LEFT JOIN near ON a = vec_id
""",
    "op3_minhash_near_dedup": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, md5(array_to_string(g, ' ')) AS g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM words)),
size AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT b.b, r.low FROM reach r JOIN both_ b ON b.a = r.node WHERE r.low < b.b),
comp AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON node = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id
""",
    "op4_license_scan": _license_sql(),
    "op9_suffix_array_dedup": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, start, md5(x[start + 1:start + 100]) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS start FROM d)),
dup AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY h ORDER BY doc_id, start) AS r FROM w) WHERE r > 1),
cut AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS span
 FROM (SELECT doc_id, start, (start - coalesce(lag(start) OVER (PARTITION BY doc_id ORDER BY start), -1000) > 100)::INT AS fresh FROM dup)),
span AS (SELECT doc_id, min(start) AS a, max(start) + 100 AS z FROM cut GROUP BY doc_id, span),
kept AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM span),
part AS (SELECT k.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last, string_agg(CASE WHEN a > from_ THEN hex(x[from_ + 1:a]) ELSE '' END, '' ORDER BY a) AS left_
 FROM kept k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(CASE WHEN p.doc_id IS NULL THEN x ELSE unhex(left_ || CASE WHEN n > last THEN hex(x[last + 1:n]) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN part p ON p.doc_id = d.doc_id
""",
    "op8_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), owner AS (
    SELECT key, min(doc_id) AS k FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
    SELECT l.*, length(l.key) < 10 OR l.doc_id = o.k AS kept
    FROM keyed l LEFT JOIN owner o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
