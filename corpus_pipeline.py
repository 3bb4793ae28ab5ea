"""A corpus pipeline of five stages: toxicity, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Null and empty texts aren't toxic,
have no near duplicates, aren't contaminated and hold no personal data, so they reach packing as their end id. Repeated
rows are judged alike; one of them stays after the near duplicates. Columns may have any names besides doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import best_fit_packing, decontamination, jaccard_join, pii, queries, toxicity
from quillspark.llm.flow import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return toxicity.accepted(docs, toxicity.fit(docs, queries.table(spark, sf_dir, "labels"), queries.train_rows))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with test items go."""
    return decontamination.without_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document gets its sequence and offset."""
    return best_fit_packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_duplicates), ("benchmark_decontamination", drop_contaminated), ("pii", mask_personal_data), ("best_fit_packing", pack)]
#: Learnt scores decide in the first stage, which SQL can't express; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if k + 1 < len(STAGES) else docs
    return docs
