"""The queries opN_<name> of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, exact_dedup, fingerprint, jaccard_join, language_id, packing, quality, substring_dedup, token_counts, warc


def _multi() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *_multi())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, quality.grade(table(spark, sf_dir, "labels"))))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digests=True)


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_probe(table(spark, sf_dir, "documents"))


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = bpe.lengths(table(spark, sf_dir, "documents"), *_multi())
    return token_counts.suffix_sums(token_counts.histogram(lengths))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(a[i:i + 49], ' ')) AS h FROM w, unnest(generate_series(1, len(a) - 49)) AS t(i)),
m AS (SELECT h, min(doc_id) AS first_id FROM s GROUP BY h HAVING count(*) > 1),
b AS (SELECT doc_id, i FROM s JOIN m USING (h) WHERE first_id < doc_id),
g AS (SELECT DISTINCT doc_id, i + k AS p FROM b, generate_series(0, 49) AS r(k)),
l AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
k AS (SELECT w.doc_id, p, a[p] AS word FROM w JOIN l USING (doc_id), unnest(generate_series(1, len(a))) AS t(p)),
n AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM k ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(a) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(CASE WHEN l.doc_id IS NULL THEN array_to_string(a, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(a[i:i + 4], ' ')) AS h FROM w, unnest(generate_series(1, greatest(len(a) - 4, least(len(a), 1)))) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_quality_classifier, op3_fingerprints, op4_curve_packing, op5_exact_dedup, op6_language_id, op7_warc, op8_token_counts, op9_substring_dedup, op10_jaccard_join)}
ORACLES = {"op5_exact_dedup": OP5_SQL, "op7_warc": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op10_jaccard_join": OP10_SQL}
