"""The registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lagwise.llm import collocations, decontaminate, fingerprint, langid, lm_score, ngram_join, packing, pii, prefix_trie, quality, secrets, token_counts, toxicity
from lagwise.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("node")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies", "links")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.branched(prefix_trie.conversations(table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_secrets, op2_quality, op3_packing, op4_fingerprints, op5_lm_score, op6_decontamination, op7_ngram_join, op8_language, op9_pii, op10_toxicity, op11_collocations, op12_token_counts,
    op13_prefix_trie, pipeline,
)
QUERIES = {f.__name__: f for f in _ALL}

#: Each phrase's occurrences, counted by splitting all texts.
_COLLOCATIONS = r"""
WITH pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
runs AS (SELECT lang, unnest(w) AS phrase, 1 AS k FROM pieces
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])), 2 FROM pieces
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])), 3 FROM pieces),
f AS (SELECT lang, phrase, k, count(*) AS f FROM runs GROUP BY ALL),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, w, f AS a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j+1:], ' ') AS tail FROM cand CROSS JOIN (SELECT unnest([1, 2]) AS j) WHERE j < k),
scored AS (SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, j, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
around AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM cand WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""

#: A node is the list of its turns; crc32 runs bit by bit over an id's digits (-1 stands for a bit).
_TRIE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS ref, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
own AS (SELECT ids.conv_id, 0 AS src, i, role, text FROM ids JOIN t ON t.conv_id = ids.ref AND i <= h UNION ALL SELECT ids.conv_id, 1, i, role, text FROM ids JOIN t USING (conv_id) WHERE i > h),
path AS (SELECT conv_id, row_number() OVER w AS depth, list({'r': role, 't': text}) OVER w AS key, text FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY src, i)),
member AS (SELECT conv_id, 0 AS depth, CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]) AS key, '' AS text FROM ids UNION ALL SELECT * FROM path),
last AS (SELECT conv_id, max(depth) AS depth FROM member GROUP BY 1),
ends AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM member JOIN last USING (conv_id, depth) GROUP BY 1),
node AS (SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS saved FROM member GROUP BY key),
kids AS (SELECT key[:depth-1] AS key, count(*) AS kids FROM node WHERE depth > 0 GROUP BY 1),
below AS (SELECT key[:d] AS key, sum(leaf) AS leaves, sum(saved) AS saved FROM (SELECT node.key, saved, CASE WHEN kids IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, depth + 1)) AS d FROM node LEFT JOIN kids USING (key)) GROUP BY 1)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(node.n AS BIGINT) AS n_convs, CAST(coalesce(kids, 0) AS BIGINT) AS n_children, CAST(below.leaves AS BIGINT) AS n_leaves,
CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM node JOIN below USING (key) LEFT JOIN kids USING (key) LEFT JOIN ends USING (key) LEFT JOIN node up ON node.depth > 0 AND up.key = node.key[:node.depth-1]"""

#: The others can't be told in SQL (trained models, tokenizers, EM, MD5-based order of ties); tests/llm compares them with plain versions.
ORACLE_SQL: dict[str, str] = {"op11_collocations": _COLLOCATIONS, "op13_prefix_trie": _TRIE}
