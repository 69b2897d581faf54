"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrain.llm import bpe, clustering, common, decontaminate, html_text, minmax, negatives, ngram_join, pii, quality, substring, token_orc, toxicity, warc

END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.components(_table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "cast(n_shingles as long) n_shingles", "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_folder(spark)
    token_orc.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_orc.read(spark, path)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit_pages(_table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row mines; every seventh has a wrong label."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, wrong)


def op12_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.components(_table(spark, sf_dir, "documents"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.digests(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_ngram_join, op3_decontamination, op4_substring_dedup, op5_byte_bpe, op6_html_text, op7_quality_rules, op8_token_orc, op9_pii, op10_warc_audit, op11_hard_negatives, op12_minmax_dedup, op13_delta_lloyd)
    return {f.__name__: f for f in own}


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingles
  FROM w
), n AS (SELECT doc_id, len(shingles) AS n FROM s),
x AS (SELECT doc_id, unnest(shingles) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id
FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = n.doc_id
"""

OP4_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35
), h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS d FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY d) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
gone AS (SELECT doc_id, list(j) AS js, count(*) AS n_removed FROM g GROUP BY doc_id),
q AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w),
kept AS (
  SELECT q.doc_id, string_agg(word, ' ' ORDER BY q.j) AS t FROM q LEFT JOIN g ON g.doc_id = q.doc_id AND g.j = q.j WHERE g.j IS NULL GROUP BY q.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


_WHOLE = "list_transform(embedding, lambda x: CAST(floor({} * x::DOUBLE) AS BIGINT))"
_FINITE = "len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"

OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE.format(256)} AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST({_DOT.format("a.q", "b.q")} AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
) SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def _lloyd_sql(rounds: int) -> str:
    """Whole rounds of the clustering, all distances anew in each."""
    steps = [
        f"v AS (SELECT vec_id, {_WHOLE.format(64)} AS q FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q FROM v QUALIFY c < 16)",
    ]
    for r in range(rounds + 1):
        d = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - k.q[i]) * (v.q[i] - k.q[i])))"
        steps.append(f"a{r} AS (SELECT v.vec_id, v.q, k.c, CAST({d} AS BIGINT) AS d FROM v, c{r} k QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY d, k.c) = 1)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT c, i, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x FROM (SELECT c, unnest(q) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i)")
            steps.append(f"c{r + 1} AS (SELECT k.c, coalesce(n.q, k.q) AS q FROM c{r} k LEFT JOIN (SELECT c, list(x ORDER BY i) AS q FROM m{r} GROUP BY c) n ON n.c = k.c)")
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON k.c = a.c"""


def oracle_sql() -> dict[str, str]:
    by_pairs = OP2_SQL.replace("85 *", "80 *").replace("m.component_id\n", "m.component_id, n.doc_id = m.component_id AS kept\n")
    return {"op2_ngram_join": OP2_SQL, "op12_minmax_dedup": by_pairs, "op4_substring_dedup": OP4_SQL, "op11_hard_negatives": OP11_SQL, "op13_delta_lloyd": _lloyd_sql(clustering.ROUNDS)}
