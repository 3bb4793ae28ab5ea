"""The registered queries of the operators, thin over them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    best_fit_packing,
    bpe,
    decontamination,
    fingerprints,
    interval_join,
    jaccard_join,
    lm_scoring,
    pii,
    quality,
    spelling,
    substring_dedup,
    token_output,
    toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def train_rows(doc_id):
    return toxicity.remainder(doc_id, 4) != 2


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), train_rows))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_join.sales_and_sessions(*(table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clicks")))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_quality,
        op3_pii,
        op4_ngram_jaccard,
        op5_token_output,
        op6_decontamination,
        op7_toxicity,
        op8_lm_scoring,
        op9_substring_dedup,
        op10_best_fit,
        op11_spelling,
        op12_interval_join,
        op13_bpe,
    )
}

#: The plain statement of op12: every pair of sale and session of a client, by exact times first and slots after.
#: crc32 is computed bit by bit, as the SQL has none.
OP12 = """
WITH spans AS (
  SELECT s.sale_id, s.client_id, s.status IS NOT DISTINCT FROM 'open' AS open,
         floor(epoch_us(s.sold_at) / 21600000000.0)::BIGINT AS a,
         floor(epoch_us(greatest(s.sold_at, coalesce(max(l.shipped_at), s.sold_at))) / 21600000000.0)::BIGINT AS b
  FROM (SELECT DISTINCT sale_id, client_id, status, sold_at FROM sales) s LEFT JOIN sale_lines l USING (sale_id)
  WHERE s.client_id IS NOT NULL AND s.sold_at IS NOT NULL
  GROUP BY s.sale_id, s.client_id, s.status, s.sold_at),
marked AS (
  SELECT client_id, ts, kind, coalesce(ts - lag(ts) OVER w > INTERVAL 15 MINUTE, true) AS fresh
  FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY client_id ORDER BY ts)),
numbered AS (
  SELECT *, sum(fresh::INT) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked),
ends AS (SELECT client_id, k, min(ts) AS first, max(ts) AS last FROM numbered GROUP BY client_id, k),
visits AS (
  SELECT e.client_id, floor(epoch_us(e.first) / 21600000000.0)::BIGINT AS a, floor(epoch_us(e.last) / 21600000000.0)::BIGINT AS b,
         EXISTS (SELECT 1 FROM clicks c WHERE c.client_id = e.client_id AND c.ts = e.last AND c.kind = 'error') AS open,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(epoch_us(e.first)::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda x, c: list_reduce(list_prepend(xor(x, c), [0, 0, 0, 0, 0, 0, 0, 0]),
                 lambda y, z: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS crc
  FROM ends e),
pairs AS (
  SELECT s.sale_id, v.crc, s.a AS s1, v.a AS s2, s.open AND v.open AS endless,
         CASE WHEN s.open THEN 9000000000000 ELSE s.b END AS e1, CASE WHEN v.open THEN 9000000000000 ELSE v.b END AS e2
  FROM spans s JOIN visits v USING (client_id))
SELECT sale_id,
       CASE WHEN s1 < s2 THEN CASE WHEN e1 < e2 THEN 'overlaps' WHEN e1 = e2 THEN 'finished_by' ELSE 'contains' END
            WHEN s1 = s2 THEN CASE WHEN e1 < e2 THEN 'starts' WHEN e1 = e2 THEN 'equals' ELSE 'started_by' END
            ELSE CASE WHEN e1 < e2 THEN 'during' WHEN e1 = e2 THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
       count(*) AS n_pairs,
       sum(CASE WHEN NOT endless THEN least(e1, e2) - greatest(s1, s2) + 1 END)::BIGINT AS overlap_slots,
       sum(crc)::BIGINT AS sessions_crc
FROM pairs WHERE s1 <= e2 AND s2 <= e1 GROUP BY 1, 2
"""
ORACLE_SQL: dict[str, str] = {"op12_interval_join": OP12}
