"""Scoring variants held against one another: a primary one and shadows, over one set of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Variants:
    """Names of variants with the column expressions that score a candidate; `none` keeps the given order."""

    def __init__(self, **scores: Column):
        self.scores: dict[str, Column] = {"none": -F.col("position"), **scores}

    def register(self, name: str, score: Column) -> None:
        self.scores[name] = score

    def __getitem__(self, name: str) -> Column:
        if name not in self.scores:
            raise ValueError(f"unknown variant {name!r}")
        return self.scores[name]

    def ranked(self, candidates: DataFrame, primary: str, shadows: list[str] = ()) -> DataFrame:
        """(event_id, primary_variant, variant, note_id, score, rank) of each candidate under each variant, ranks from 1.

        candidates: event_id, note_id, position and what the expressions use. Null scores come last; ties keep the given
        order, then go by note. A repeated shadow counts once, and the primary isn't its own shadow."""
        names = dict.fromkeys([primary, *shadows])
        each = F.array(*[F.struct(F.lit(n).alias("variant"), self[n].cast("double").alias("score")) for n in names])
        rows = candidates.select("event_id", "note_id", "position", F.explode(each).alias("v")).select("event_id", "note_id", "position", "v.*")
        place = Window.partitionBy("event_id", "variant").orderBy(F.desc_nulls_last("score"), "position", "note_id")
        return rows.select("event_id", F.lit(primary).alias("primary_variant"), "variant", "note_id", "score", F.row_number().over(place).alias("rank"))

    def payloads(self, candidates: DataFrame, primary: str, shadows: list[str] = (), k: int | None = None) -> DataFrame:
        """(event_id, primary_variant, event_data): all variants' results as an event's JSON, the best k of each if k is given."""
        rows = self.ranked(candidates, primary, shadows)
        rows = rows if k is None else rows.filter(F.col("rank") <= k)
        listed = F.array_sort(F.collect_list(F.struct("rank", "note_id", F.col("score").alias("score_final"))))
        results = F.transform(listed, lambda x: F.struct(x["note_id"].cast("string").alias("note_id"), x["rank"].alias("rank"), x["score_final"].alias("score_final")))
        lists = rows.groupBy("event_id", "primary_variant", "variant").agg(F.struct(results.alias("results")).alias("list"))
        data = F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "list")))).alias("variants"))
        return lists.groupBy("event_id", "primary_variant").agg(F.to_json(data).alias("event_data"))
