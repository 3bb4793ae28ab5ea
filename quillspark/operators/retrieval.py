"""Retrieval lanes, their fusion and reranking. A lane is a DataFrame (id, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, tokens
from ..functions.vectors import chunks, cosine, maxsim, minmax
from ..shared import cut
from .nearest import candidates

K1, B, RRF = 1.2, 0.75, 60
SNIPPET = 32
MAX_PAIRS = 200_000


def top(lane: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """Ranked by falling score, ties by id: a per-partition top and a merge, no full sort."""
    return lane.orderBy(F.desc("score"), "id").offset(offset).limit(k) if offset else lane.orderBy(F.desc("score"), "id").limit(k)


def query_words(query: str) -> list[str]:
    """The distinct words of a query, quotes left out."""
    return sorted({w.lower() for w in query.replace('"', "").split()})


def counted(notes: DataFrame, words: list[str]) -> DataFrame:
    """(id, dl, tf) of notes (id, text): the number of words, and how often each asked word is among them."""
    tf = F.transform(F.array(*map(F.lit, words)), lambda w: F.size(F.filter("tokens", lambda t: t == w)))
    return notes.select("id", tokens(F.col("text")).alias("tokens")).select("id", F.size("tokens").alias("dl"), tf.alias("tf"))


def bm25(notes: DataFrame, query: str) -> DataFrame:
    """Notes (id, text) that have every word of the query. Texts are taken apart once; counting and scoring read a few numbers for each note."""
    words = query_words(query)
    rows = cut(counted(notes, words))
    facts = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col("tf")[i] > 0).cast("int")).alias(f"df{i}") for i in range(len(words))])
    score = F.lit(0.0)
    for i in range(len(words)):
        f, df = F.col("tf")[i], F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.filter(F.forall("tf", lambda f: f > 0)).crossJoin(F.broadcast(facts)).select("id", score.alias("score"))


def best_window(text: Column, words: list[str], size: int = SNIPPET) -> Column:
    """The part of a text around the query's words, of at most `size` words, with dots where text is left out.

    Of the windows that begin at a query word the one with most different ones is taken, then with most in all, then the
    first; what room it leaves is dealt to both sides. A text without these words gives its beginning, null gives null.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*"), F.lit(0))  # a word with what follows it

    def windowed(every: Column) -> Column:
        own = F.transform(every, lambda p, i: F.struct(i.alias("i"), F.lower(F.regexp_extract(p, r"^[\p{L}\p{N}]+", 0)).alias("w")))
        hits = F.filter(own, lambda x: x["w"].isin(*words))

        def chosen(found: Column) -> Column:
            def rated(h: Column) -> Column:
                inside = F.filter(found, lambda x: (x["i"] >= h["i"]) & (x["i"] < h["i"] + size))
                return F.struct(F.size(F.array_distinct(F.transform(inside, lambda x: x["w"]))).alias("k"), F.size(inside).alias("n"), (-h["i"]).alias("at"), F.array_max(F.transform(inside, lambda x: x["i"])).alias("to"))

            return let(F.array_max(F.transform(found, rated)), lambda b: F.when(b.isNull(), 0).otherwise(-b["at"] - F.floor((size - (b["to"] + b["at"] + 1)) / 2).cast("int")))

        def cut_out(wanted: Column) -> Column:
            begin = F.greatest(F.lit(0), F.least(wanted, F.size(every) - size))
            shown = F.regexp_replace(F.array_join(F.slice(every, begin + 1, size), ""), r"[^\p{L}\p{N}]+\z", "")
            return F.concat(F.when(begin > 0, "...").otherwise(""), shown, F.when(begin + size < F.size(every), "...").otherwise(""))

        return let(let(hits, chosen), cut_out)

    return let(pieces, windowed)


def with_snippets(hits: DataFrame, notes: DataFrame, query: str, size: int = SNIPPET) -> DataFrame:
    """A page of hits (id, ...) with the snippet of each one's text; texts of hits alone are taken apart."""
    texts = notes.select("id", "text").join(F.broadcast(hits.select("id")), "id", "left_semi")
    return hits.join(texts, "id", "left").withColumn("snippet", best_window(F.col("text"), query_words(query), size)).drop("text")


def page(lane: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """A page of a lane with scores normalised over the page."""
    rows = top(lane, k, offset)
    return rows.select("id", minmax(F.col("score"), Window.partitionBy()).alias("score"))


def dense(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Cosine of every vector (id, v) with the one query vector (q)."""
    return vectors.crossJoin(F.broadcast(query)).select("id", cosine(F.col("v"), F.col("q")).alias("score"))


def sparse(notes: DataFrame, weights: DataFrame) -> DataFrame:
    """Dot product of term counts with the query's weights (term, w), a few terms; notes without a common term score 0."""
    q = weights.agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("q"))
    terms = F.filter(tokens(F.col("text")), lambda t: F.map_contains_key("q", t))
    return notes.crossJoin(F.broadcast(q)).select("id", F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.element_at("q", t)).alias("score"))


def late_interaction(vectors: DataFrame, query: DataFrame, n: int, size: int) -> DataFrame:
    return vectors.crossJoin(F.broadcast(query)).select("id", maxsim(chunks(F.col("q"), n, size), chunks(F.col("v"), n, size)).alias("score"))


def fuse(lanes: dict[str, DataFrame], fetch: int = 100) -> DataFrame:
    """Mean-of-present reciprocal ranks: id, score, n_lanes. A union and one aggregation, not joins of lanes."""
    ranked = []
    for name, lane in lanes.items():
        rows = top(lane, fetch)  # at most `fetch` rows, so one partition ranks them
        ranked.append(rows.select(F.lit(name).alias("lane"), "id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank")))
    return reduce(DataFrame.union, ranked).groupBy("id").agg(F.avg(1.0 / (RRF + F.col("rank"))).alias("score"), F.count("*").alias("n_lanes"))


def rerank(candidates: DataFrame, activation: DataFrame, n: int = 10, alpha: float = 0.9, beta: float = 0.1) -> DataFrame:
    """Candidates (id, score) by both ranks; an activation of 0 or less counts as a rank past the last."""
    rows = top(candidates, n).join(F.broadcast(activation), "id", "left").withColumn("act", F.coalesce("activation", F.lit(0.0)))
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).withColumn("act_rank", F.row_number().over(Window.orderBy(F.desc("act"), "rank")))
    last = F.count("*").over(Window.partitionBy()) + 2
    final = alpha / (RRF + F.col("rank")) + beta / (RRF + F.when(F.col("act") > 0, F.col("act_rank")).otherwise(last))
    return rows.select("id", "rank", "act_rank", final.alias("final"))


def activation_lane(activation: DataFrame, notes: DataFrame, kind: str | None = None) -> DataFrame:
    """A lane (id, score) of notes (id, type) that were ever used, by their activation (id, activation) alone, whatever is asked; of one type if given.

    Scores are drawn out to 0 to 1, all 1 if they are equal. As lanes are fused by the mean of those present, it lifts or lowers what
    others find, and adds notes of its own."""
    used = activation.select("id", "activation").join(notes if kind is None else notes.filter(F.col("type") == kind), "id", "left_semi")
    ends = used.agg(F.min("activation").alias("low"), F.max("activation").alias("high"))  # one row
    span = F.col("high") - F.col("low")
    return used.crossJoin(F.broadcast(ends)).select("id", F.when(span > 0, (F.col("activation") - F.col("low")) / span).otherwise(1.0).alias("score"))


def assembled(keyword: DataFrame, activation: DataFrame | None = None, **stored: DataFrame | None) -> dict[str, DataFrame]:
    """The lanes of an ask by what a collection has: the keyword lane, and, if it has a dense one, the other stored ones (sparse, late) and the activation.

    stored: lanes by name; None stands for vectors that the collection hasn't got. Without a dense lane the keyword lane stands alone."""
    if stored.get("dense") is None:
        return {"bm25": keyword}
    given = {k: v for k, v in stored.items() if v is not None}
    return {"bm25": keyword, **given, **({} if activation is None else {"activation": activation})}


def gap_confidence(fused: DataFrame) -> DataFrame:
    """The label of the relative gap of the first and second hits' scores."""
    best = top(fused, 2).agg(F.max("score").alias("first"), F.min("score").alias("second"), F.count("*").alias("n"))
    gap = F.when(F.col("n") > 1, (F.col("first") - F.col("second")) / F.col("first")).otherwise(1.0)
    return best.select(gap.alias("gap")).withColumn("label", F.when(F.col("gap") >= 0.05, "high").when(F.col("gap") >= 0.015, "moderate").when(F.col("gap") >= 0.005, "low").otherwise("ambiguous"))


def noise_floor(vectors: DataFrame, probes: DataFrame) -> DataFrame:
    """The greatest cosine of any vector with any of a few probes (p)."""
    return vectors.crossJoin(F.broadcast(probes)).agg(F.max(cosine(F.col("v"), F.col("p"))).alias("noise_floor"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `at`, the place by id from 0: each range of ids is numbered for itself, from the sum of the counts before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, "id").withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("range").agg(F.count("*").alias("m"))  # a row for each range
    before = F.coalesce(F.sum("m").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1
    return ranged.withColumn("own", own).join(F.broadcast(counts.select("range", before.alias("first"))), "range").withColumn("at", F.col("first") + F.col("own")).drop("range", "own", "first")


def pair_spread(vectors: DataFrame, most: int = MAX_PAIRS) -> DataFrame:
    """Mean and population deviation of cosines over the pairs i < j of all vectors by id: every stride-th pair, the least stride that keeps `most` at most.

    Kept pairs come from their number alone, pair k of n vectors in row-wise order, so that no all-pairs join is needed.
    """
    placed = numbered(vectors.select("id", "v")).select("at", "v")
    k = F.expr("explode(sequence(0L, total - 1, stride))").alias("k")
    kept = vectors.agg(F.count("*").alias("n")).filter("n > 1").withColumn("total", F.expr("n * (n - 1) div 2")).withColumn("stride", F.expr(f"(total + {most - 1}) div {most}")).select("n", k)
    near = kept.withColumn("i", F.expr("cast((2 * n - 1 - sqrt((2 * n - 1) * (2 * n - 1) - 8 * k)) / 2 as bigint)"))
    begin = "({0}) * (2 * n - ({0}) - 1) div 2"  # the number of row i's first pair
    row = near.withColumn("i", F.expr(f"i + CASE WHEN {begin.format('i')} > k THEN -1 WHEN {begin.format('i + 1')} <= k THEN 1 ELSE 0 END"))
    pairs = row.select("i", F.expr(f"i + 1 + k - {begin.format('i')}").alias("j"))
    one, two = placed.select(F.col("at").alias("i"), F.col("v").alias("a")), placed.select(F.col("at").alias("j"), F.col("v").alias("b"))
    return pairs.join(one, "i").join(two, "j").select(cosine(F.col("a"), F.col("b")).alias("c")).agg(F.avg("c").alias("mu"), F.stddev_pop("c").alias("sigma"), F.count("*").alias("n_pairs"))


def nearest(texts: DataFrame, arcs: DataFrame, k: int = 3, few: str = "arcs") -> DataFrame:
    """The k nearest arcs (arc_id, arc_v) of each vector (id, v); few: which side is a bounded set, that every part of the other is held against.

    All pairs are weighed, block by block; of a block only the k best of each vector go on."""
    scored = candidates(texts, arcs, k, few)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "arc_id"))).filter(F.col("rank") <= k)


def search(lanes: dict[str, DataFrame], mode: str = "auto", fetch: int = 100) -> DataFrame:
    """(id, score) of the keyword lane, the dense lane, or all fused; auto fuses if there is a lane beside the keyword one. Other modes are errors."""
    if mode == "auto":
        mode = "hybrid" if lanes.keys() - {"bm25"} else "keyword"
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValueError(f"mode {mode!r} is none of keyword, semantic, hybrid, auto")
    if mode != "keyword" and not lanes.keys() - {"bm25"}:
        raise ValueError(f"no vectors for mode {mode!r}")
    return lanes["bm25"] if mode == "keyword" else lanes["dense"] if mode == "semantic" else fuse(lanes, fetch).select("id", "score")


def ask(lanes: dict[str, DataFrame], similarities: DataFrame, k: int = 10, mode: str = "auto") -> DataFrame:
    """(rank, id, score, similarity, confidence) of the best k hits; the label is the gap's after the first. similarities: (id, score)."""
    hits = cut(top(search(lanes, mode), k))  # k rows, for all that follows
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    near = similarities.select("id", F.col("score").alias("similarity"))
    found = near.join(F.broadcast(hits.select("id")), "id", "left_semi")
    return ranked.join(F.broadcast(found), "id", "left").crossJoin(F.broadcast(gap_confidence(hits).select(F.col("label").alias("confidence")))).select("rank", "id", "score", "similarity", "confidence")
