"""The queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import directcodes, kneserney, langid, lineruns, passages, postings, secrets, sentencepieces, simhash, templates
from wardline.functions.shipping import ship

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.language_model_scores(_documents(spark, sf_dir), order=3)


def op2_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return postings.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.substring_dedup(_documents(spark, sf_dir))


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineruns.line_digest(_documents(spark, sf_dir))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_documents(spark, sf_dir))


def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.sentencepiece_digest(_documents(spark, sf_dir), f"{TOKENIZERS}/piece_bpe_32k.model")


def op8_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directcodes.direct_codes(_documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_documents(spark, sf_dir))


_ALL = (op1_kneser_ney, op2_postings, op3_passages, op4_line_runs, op5_langid, op6_templates, op7_sentencepiece, op8_direct_codes, op9_secrets, op10_simhash)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS home FROM h GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM h JOIN f USING (k) WHERE home < doc_id),
r AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
_OP4_SQL = r"""
WITH s AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
t AS (SELECT doc_id, n, x, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS y FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS n FROM s)),
b AS (SELECT doc_id, list(y ORDER BY n) AS y FROM t WHERE y <> '' GROUP BY doc_id),
p AS (SELECT doc_id, y, unnest(range(len(y))) AS a FROM b),
w AS (SELECT doc_id, a, k, list_slice(y, a + 1, a + k) AS run FROM (SELECT *, unnest(range(1, least(21, len(y) - a + 1))) AS k FROM p)),
f AS (SELECT doc_id, a, k, row_number() OVER (PARTITION BY k, md5(array_to_string(run, chr(10))) ORDER BY doc_id, a) > 1 AS late,
  k >= 2 AND length(array_to_string(run, '')) >= 20 OR k = 1 AND len(string_split_regex(run[1], '[ \t\r\x0b\x0c]+')) > 50 AS enough FROM w),
c AS (SELECT DISTINCT doc_id, unnest(range(a, a + k)) AS a FROM f WHERE late AND enough),
m AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS a FROM t WHERE y <> ''),
r AS (SELECT m.doc_id, m.n, m.a - row_number() OVER (PARTITION BY m.doc_id ORDER BY m.a) AS g FROM m JOIN c ON m.doc_id = c.doc_id AND m.a = c.a),
u AS (SELECT doc_id, min(n) AS p, max(n) AS q, count(*) AS k FROM r GROUP BY doc_id, g),
e AS (SELECT doc_id, count(*) AS n_runs, sum(k) AS n_deleted, max(k) AS longest_run FROM u GROUP BY doc_id),
o AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY n) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = t.doc_id AND t.n BETWEEN p AND q) GROUP BY doc_id)
SELECT s.doc_id, len(l) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted, coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM s LEFT JOIN e ON s.doc_id = e.doc_id LEFT JOIN o ON s.doc_id = o.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; tests hold the others against brute-force versions."""
    return {"op3_passages": _OP3_SQL, "op4_line_runs": _OP4_SQL}
