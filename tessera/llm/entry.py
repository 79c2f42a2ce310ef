"""The queries of the training-data operators and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, fingerprint, hard_negatives, html_text, language, packing, pii, sharding, simhash, token_counts, toxicity, vector_codes
from tessera.llm.common import table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_fingerprint, op2_pii, op3_token_counts, op4_packing, op5_toxicity, op6_exact_dedup, op7_bpe, op8_html, op9_simhash, op10_language)
    found += (op11_hard_negatives, op12_vector_codes, op13_sharding, pipeline)
    return {f.__name__: f for f in found}


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size,
       doc_id = keep_id AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""

FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11_SQL = f"""
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {FINITE}
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 10
"""


def _op12_sql(rounds: int = 4, entries: int = 256) -> str:
    """Each round's codebook as a step: nearest entries, then sums by entry and place."""
    dot = "list_dot_product"
    near = lambda i: f"SELECT p.vec_id, p.label, p.part, p.w, {dot}(w, w) - 2 * {dot}(w, c) + {dot}(c, c) AS far, e FROM p JOIN c{i} USING (part) QUALIFY row_number() OVER (PARTITION BY p.vec_id, p.part ORDER BY far, e) = 1"
    steps = [
        f"r AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE {FINITE})",
        "p AS (SELECT vec_id, label, part, list_slice(v, (part * (len(v) // 4) + 1)::INT, ((part + 1) * (len(v) // 4))::INT) AS w FROM r, range(4) t(part))",
        f"c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, w AS c FROM p QUALIFY e < {entries})",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS ({near(i)})",
            f"m{i} AS (SELECT part, e, k, floor(sum(w[k]) / count(*)) AS x FROM a{i}, (SELECT unnest(range(1, 1 + (SELECT max(len(w)) FROM p))) AS k) GROUP BY part, e, k)",
            f"c{i + 1} AS (SELECT part, e, coalesce((SELECT list(x ORDER BY k) FROM m{i} m WHERE m.part = c.part AND m.e = c.e), c.c) AS c FROM c{i} c)",
        ]
    return f"""WITH {", ".join(f"{x.replace(' AS (', ' AS MATERIALIZED (', 1)}" for x in steps)}, z AS MATERIALIZED ({near(rounds)}),
    y AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM z GROUP BY vec_id),
    h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM y, h"""


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op12_vector_codes": _op12_sql()}
