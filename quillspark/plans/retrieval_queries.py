"""Queries of the retrieval lanes and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import clamp_sigma, cosine, l2_normalise, relevance
from ..operators import retrieval as R
from ..operators.analytics import activation
from .tables import NOW, accesses, notes, query_vector, read, vectors

QUERY = "the of"


def dense_topk(spark, d):
    return R.top(R.dense(vectors(spark, d), query_vector(spark, d)), 10).select("id", F.round("score", 6).alias("score"))


def bm25_topk(spark, d):
    return R.page(R.bm25(notes(spark, d), QUERY), 10).select("id", F.round("score", 6).alias("score"))


def search_snippets(spark, d):
    """The best ten notes with the parts of their texts that are around the query's words."""
    return R.with_snippets(R.top(R.bm25(notes(spark, d), QUERY), 10).select("id", F.round("score", 6).alias("score")), notes(spark, d), QUERY)


def bm25_count(spark, d):
    return R.bm25(notes(spark, d), QUERY).agg(F.count("*").alias("n"))


def bm25_filtered(spark, d):
    return R.page(R.bm25(notes(spark, d).filter("type = 'src1' and tag = 'en'"), QUERY), 5, 2).select("id", F.round("score", 6).alias("score"))


def _sparse_weights(spark, d):
    first = notes(spark, d).filter("id = 0").select(F.explode(tokens(F.col("text"))).alias("term"))
    return first.groupBy("term").agg(F.count("*").cast("double").alias("w")).orderBy(F.desc("w"), "term").limit(32)


def sparse_topk(spark, d):
    return R.top(R.sparse(notes(spark, d), _sparse_weights(spark, d)), 10)


def maxsim_topk(spark, d):
    return R.top(R.late_interaction(vectors(spark, d), query_vector(spark, d), 4, 16), 10).select("id", F.round("score", 6).alias("score"))


def _lanes(spark, d):
    return {
        "bm25": R.bm25(notes(spark, d), QUERY).select("id", F.round("score", 9).alias("score")),
        "dense": R.dense(vectors(spark, d), query_vector(spark, d)).select("id", F.round("score", 9).alias("score")),
        "maxsim": R.late_interaction(vectors(spark, d), query_vector(spark, d), 4, 16).select("id", F.round("score", 9).alias("score")),
        "sparse": R.sparse(notes(spark, d), _sparse_weights(spark, d)),
    }


def _fused(spark, d):
    return R.fuse(_lanes(spark, d)).withColumn("score", F.round("score", 9))


def rrf_hybrid(spark, d):
    return R.top(_fused(spark, d), 10)


def rrf_gap_confidence(spark, d):
    return R.gap_confidence(_fused(spark, d)).select(F.round("gap", 6).alias("gap"), "label")


def activation_rerank(spark, d):
    act = activation(accesses(spark, d), NOW).select("id", F.round("activation", 9).alias("activation"))
    return R.rerank(R.dense(vectors(spark, d), query_vector(spark, d)), act).select("id", "rank", "act_rank", F.round("final", 9).alias("final"))


def noise_floor_stats(spark, d):
    v = vectors(spark, d)
    floor = R.noise_floor(v.filter("id >= 8"), v.filter("id < 8").select(F.col("v").alias("p")))
    return floor.crossJoin(R.pair_spread(v)).select(F.round("noise_floor", 6).alias("noise_floor"), F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), "n_pairs", F.round(clamp_sigma(F.col("sigma")), 6).alias("sigma_eff"))


def relevance_label(spark, d):
    v = vectors(spark, d)
    stats = R.noise_floor(v.filter("id >= 8"), v.filter("id < 8").select(F.col("v").alias("p"))).crossJoin(R.pair_spread(v))
    probes = R.nearest(v.filter("id < 8").select("id", "v"), v.filter("id >= 8").select(F.col("id").alias("arc_id"), F.col("v").alias("arc_v")), 1, few="texts")
    x = relevance(F.col("score"), F.col("noise_floor"), clamp_sigma(F.col("sigma")), 0.3)
    return probes.crossJoin(F.broadcast(stats)).select("id", x["label"].alias("label"), F.round(x["z"], 4).alias("z"))


def nearest_arcs(spark, d):
    v = vectors(spark, d)
    return R.nearest(v.filter("label <> 0").select("id", "v"), v.filter("label = 0").select(F.col("id").alias("arc_id"), F.col("v").alias("arc_v"))).select("id", "arc_id", "rank", F.round("score", 5).alias("score"))


def query_similarities(spark, d):
    return R.dense(vectors(spark, d), query_vector(spark, d)).select("id", F.round("score", 6).alias("score"))


def embedding_dims(spark, d):
    return vectors(spark, d).groupBy(F.size("v").cast("long").alias("dims")).agg(F.count("*").alias("n"))


def vector_norms(spark, d):
    """The length of each vector made one long, and its first and last number."""
    v = vectors(spark, d).select("id", l2_normalise(F.col("v")).alias("u"))
    length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("id", F.round(length, 5).alias("length"), F.round(F.get("u", F.lit(0)), 5).alias("first"), F.round(F.element_at("u", -1), 5).alias("last"))


def golden_hits(spark, d):
    """Hit@5 and reciprocal rank of each of ten probes, whose expected ids are those of its label."""
    v = vectors(spark, d)
    found = R.nearest(v.filter("id < 10").select("id", "v"), v.filter("id >= 10").select(F.col("id").alias("arc_id"), F.col("v").alias("arc_v")), 10, few="texts")
    rows = found.join(F.broadcast(v.filter("id < 10").select("id", F.col("label").alias("want"))), "id").join(v.select(F.col("id").alias("arc_id"), "label"), "arc_id")
    rank = F.min(F.when(F.col("label") == F.col("want"), F.col("rank")))
    return rows.groupBy("id").agg(F.coalesce((rank <= 5).cast("double"), F.lit(0.0)).alias("hit"), F.round(F.coalesce(1.0 / rank, F.lit(0.0)), 6).alias("rr"))


def fuzzy_titles(spark, d):
    """Part names by words in common with a query, shorter names first."""
    want = F.array(*[F.lit(w) for w in ("small", "red", "widget")])
    p = read(spark, d, "part").select("p_partkey", "p_name", F.size(F.array_intersect(F.filter(F.array_distinct(tokens(F.col("p_name"))), lambda t: F.octet_length(t) >= 3), want)).alias("overlap"))
    return p.filter("overlap > 0").orderBy(F.desc("overlap"), F.char_length("p_name"), "p_partkey").limit(10)


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_BM25 = r"""tok AS (SELECT doc_id AS id, source, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents %s),
cnt AS (SELECT id, len(t) AS dl, len(list_filter(t, lambda x: x = 'of')) AS f0, len(list_filter(t, lambda x: x = 'the')) AS f1 FROM tok),
facts AS (SELECT count(*) AS n, avg(dl) AS avgdl, sum((f0 > 0)::INT) AS d0, sum((f1 > 0)::INT) AS d1 FROM cnt),
bm25 AS (SELECT id, greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
 + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM cnt, facts WHERE f0 > 0 AND f1 > 0)"""
_PAGE = """, page AS (SELECT * FROM bm25 ORDER BY score DESC, id LIMIT %d OFFSET %d)
SELECT id, round(CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END, 6) AS score FROM page"""
_SPARSE = r"""qt AS (SELECT term, count(*)::DOUBLE AS w FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE doc_id = 0) GROUP BY term ORDER BY w DESC, term LIMIT 32),
dt AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
sparse AS (SELECT doc_id AS id, coalesce(s.score, 0.0) AS score FROM documents LEFT JOIN (SELECT id, sum(w) AS score FROM dt JOIN qt USING (term) GROUP BY id) s ON doc_id = s.id)"""
_CHUNK = "list_slice(%s.embedding::DOUBLE[], {i} * 16 + 1, {i} * 16 + 16)"


def _maxsim() -> str:
    part = lambda t, i: (_CHUNK % t).format(i=i)
    return " + ".join(f"(SELECT CASE WHEN m > -1 THEN m ELSE 0 END FROM (SELECT greatest({', '.join(f'list_dot_product({part('q', i)}, {part('e', j)})' for j in range(4))}) AS m))" for i in range(4))


_FUSED = f"""WITH {_BM25 % ''}, {_SPARSE},
lanes AS (SELECT 'bm25' AS lane, id, round(score, 9) AS score FROM bm25
 UNION ALL SELECT 'dense', e.vec_id, round({_COS}, 9) FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q
 UNION ALL SELECT 'maxsim', e.vec_id, round({_maxsim()}, 9) FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q
 UNION ALL SELECT 'sparse', id, score FROM sparse),
ranked AS (SELECT lane, id, row_number() OVER (PARTITION BY lane ORDER BY score DESC, id) AS r FROM lanes),
fused AS (SELECT id, round(avg(1.0::DOUBLE / (60 + r)), 9) AS score, count(*) AS n_lanes FROM ranked WHERE r <= 100 GROUP BY id)"""
_STATS = f"""floor AS (SELECT max({_COS}) AS noise_floor FROM embeddings e, embeddings q WHERE e.vec_id >= 8 AND q.vec_id < 8),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings),
spread AS (SELECT avg(c) AS mu, stddev_pop(c) AS sigma, count(*) AS n_pairs FROM (SELECT {_COS} AS c FROM numbered e, numbered q WHERE e.i < q.i
 AND (e.i * (2 * e.n - e.i - 1) // 2 + q.i - e.i - 1) % ((e.n * (e.n - 1) // 2 + 199999) // 200000) = 0))"""
_EFF = "greatest(0.03, least(0.12, sigma))"

QUERIES = {f.__name__: f for f in (dense_topk, bm25_topk, search_snippets, bm25_count, bm25_filtered, sparse_topk, maxsim_topk, rrf_hybrid, rrf_gap_confidence, activation_rerank, noise_floor_stats, relevance_label, nearest_arcs, query_similarities, embedding_dims, vector_norms, golden_hits, fuzzy_titles)}
ORACLE_SQL = {
    "dense_topk": f"SELECT e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, id LIMIT 10",
    "bm25_topk": f"WITH {_BM25 % ''}{_PAGE % (10, 0)}",
    "search_snippets": rf"""WITH {_BM25 % ''}, best AS (SELECT id, round(score, 6) AS score, score AS s FROM bm25 ORDER BY s DESC, id LIMIT 10),
p AS (SELECT id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]*') AS every, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)) AS w FROM documents JOIN best ON doc_id = id),
h AS (SELECT * FROM (SELECT id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS w FROM p) WHERE w IN ('the', 'of')),
r AS (SELECT a.id, a.i, count(DISTINCT b.w) AS k, count(*) AS n, max(b.i) AS e FROM h a JOIN h b ON a.id = b.id AND b.i BETWEEN a.i AND a.i + 31 GROUP BY a.id, a.i),
c AS (SELECT id, i - (32 - (e - i + 1)) // 2 AS b FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC, n DESC, i) = 1),
f AS (SELECT id, every, greatest(1, least(b, len(every) - 31)) AS b FROM c JOIN p USING (id))
SELECT id, score, CASE WHEN b > 1 THEN '...' ELSE '' END || regexp_replace(array_to_string(list_slice(every, b, b + 31), ''), '[^\p{{L}}\p{{N}}]+$', '') || CASE WHEN b + 31 < len(every) THEN '...' ELSE '' END AS snippet FROM best JOIN f USING (id)""",
    "bm25_count": f"WITH {_BM25 % ''} SELECT count(*) AS n FROM bm25",
    "bm25_filtered": f"WITH {_BM25 % chr(32)}{_PAGE % (5, 2)}".replace("FROM documents ", "FROM documents WHERE source = 'src1' AND lang = 'en' ", 1),
    "sparse_topk": f"WITH {_SPARSE} SELECT id, score FROM sparse ORDER BY score DESC, id LIMIT 10",
    "maxsim_topk": f"WITH s AS (SELECT e.vec_id AS id, {_maxsim()} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10",
    "rrf_hybrid": f"{_FUSED} SELECT id, score, n_lanes FROM fused ORDER BY score DESC, id LIMIT 10",
    "rrf_gap_confidence": f"""{_FUSED}, best AS (SELECT score FROM fused ORDER BY score DESC, id LIMIT 2), g AS (SELECT CASE WHEN count(*) > 1 THEN (max(score) - min(score)) / max(score) ELSE 1.0 END AS gap FROM best)
SELECT round(gap, 6) AS gap, CASE WHEN gap >= 0.05 THEN 'high' WHEN gap >= 0.015 THEN 'moderate' WHEN gap >= 0.005 THEN 'low' ELSE 'ambiguous' END AS label FROM g""",
    "activation_rerank": f"""WITH act AS (SELECT user_id AS id, round(0.6 * ln(sum(power((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6 / 3600, -0.5))) + 0.4 * ln(1 + count(*)), 9) AS activation FROM events WHERE event_type = 'view' GROUP BY user_id),
c AS (SELECT e.vec_id AS id, {_COS} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, id LIMIT 10),
r AS (SELECT c.id, row_number() OVER (ORDER BY score DESC, c.id) AS rank, coalesce(activation, 0.0) AS a FROM c LEFT JOIN act ON act.id = c.id),
s AS (SELECT *, row_number() OVER (ORDER BY a DESC, rank) AS act_rank, count(*) OVER () + 2 AS last FROM r)
SELECT id, rank, act_rank, round(0.9::DOUBLE / (60 + rank) + 0.1::DOUBLE / (60 + CASE WHEN a > 0 THEN act_rank ELSE last END), 9) AS final FROM s""",
    "noise_floor_stats": f"WITH {_STATS} SELECT round(noise_floor, 6) AS noise_floor, round(mu, 6) AS mu, round(sigma, 6) AS sigma, n_pairs, round({_EFF}, 6) AS sigma_eff FROM floor, spread",
    "relevance_label": f"""WITH {_STATS}, top AS (SELECT q.vec_id AS id, max({_COS}) AS score FROM embeddings e, embeddings q WHERE e.vec_id >= 8 AND q.vec_id < 8 GROUP BY q.vec_id)
SELECT id, CASE WHEN score < least(noise_floor - 0.5 * {_EFF}, 0.3) THEN 'no_match' WHEN (score - noise_floor) / {_EFF} <= 1 THEN 'weak' WHEN (score - noise_floor) / {_EFF} <= 2.5 THEN 'moderate' ELSE 'strong' END AS label, round((score - noise_floor) / {_EFF}, 4) AS z FROM top, floor, spread""",
    "nearest_arcs": f"SELECT id, arc_id, rank, round(score, 5) AS score FROM (SELECT q.vec_id AS id, e.vec_id AS arc_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.label <> 0 AND e.label = 0) WHERE rank <= 3",
    "query_similarities": f"SELECT e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q",
    "embedding_dims": "SELECT len(embedding) AS dims, count(*) AS n FROM embeddings GROUP BY 1",
    "vector_norms": """WITH n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
SELECT id, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length, round(CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END, 5) AS first, round(CASE WHEN n > 0 THEN v[-1] / n ELSE v[-1] END, 5) AS last FROM n""",
    "golden_hits": f"""WITH n AS (SELECT q.vec_id AS id, q.label AS want, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id < 10 AND e.vec_id >= 10),
r AS (SELECT id, min(CASE WHEN label = want THEN rank END) AS rank FROM n WHERE rank <= 10 GROUP BY id) SELECT id, coalesce((rank <= 5)::INT::DOUBLE, 0.0) AS hit, round(coalesce(1.0::DOUBLE / rank, 0.0), 6) AS rr FROM r""",
    "fuzzy_titles": r"""SELECT p_partkey, p_name, overlap FROM (SELECT p_partkey, p_name, len(list_intersect(list_filter(list_distinct(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+')), lambda x: strlen(x) >= 3), ['small', 'red', 'widget']))::INT AS overlap FROM part) WHERE overlap > 0 ORDER BY overlap DESC, length(p_name), p_partkey LIMIT 10""",
}
