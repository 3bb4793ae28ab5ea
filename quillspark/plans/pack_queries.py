"""Queries of context packs, asks, nested results and the registry, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import checks as C
from ..operators import delivery as D
from ..operators import graph as G
from ..operators import packing as P
from ..operators import retrieval as R
from ..operators.variants import Variants
from .retrieval_queries import _COS, _FUSED, _lanes
from .tables import NOW, accesses, log, query_vector, read, vectors

BUDGET, ITEMS = 1500, 4


def _notes(spark, d):
    i = F.col("doc_id")
    front = F.concat(F.lit('{"title":"Doc '), i.cast("string"), F.lit('","type":"'), F.col("source"), F.lit('"}'))
    return read(spark, d, "documents").select(i.alias("id"), front.alias("frontmatter"), F.col("text").alias("body"), F.concat(F.lit("2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0")).alias("updated"))


def _edges(spark, d):
    """Documents' relations to a tenth of their number, links to one of a hundred, and inferred edges to the next but one."""
    i = F.col("doc_id")
    docs = read(spark, d, "documents").select("doc_id")
    edge = lambda to, kind, sure, k: docs.select(i.alias("src"), to.alias("dst"), F.lit(kind).alias("edge_type"), sure.alias("confidence"), (i * 3 + k).alias("at"))
    sure = F.when(i % 2 == 0, "medium").otherwise("low")
    return edge(F.floor(i / 10), "explicit_relation", F.lit("high"), 0).union(edge((i * 7 + 3) % 100, "explicit_link", F.lit("high"), 1)).union(edge(i + 2, "tag_overlap", sure, 2))


def context_pack_targets(spark, d):
    return P.targets(_notes(spark, d), BUDGET).drop("body")


def _packed(spark, d):
    n = _notes(spark, d)
    return P.targets(n, BUDGET), P.direct_candidates(_edges(spark, d)), n


def context_pack_two_pass(spark, d):
    return P.two_pass(*_packed(spark, d), BUDGET).drop("allowed")


def context_pack_body_first(spark, d):
    return P.body_first(*_packed(spark, d), ITEMS).drop("allowed")


def ask_hits(spark, d):
    sims = R.dense(vectors(spark, d), query_vector(spark, d))
    rounded = {k: v.withColumn("score", F.round("score", 9)) for k, v in _lanes(spark, d).items()}
    return R.ask(rounded, sims, 10).select("rank", "id", F.round("score", 9).alias("score"), F.round("similarity", 6).alias("similarity"), "confidence")


def _questions(spark, d):
    """A question for each language and source: its first hit is the document nearest to 3,000 letters. Who asks and how goes by the hit's number."""
    w = Window.partitionBy("lang", "source").orderBy(F.abs(F.length("text") - 3000), "doc_id")
    docs = read(spark, d, "documents").withColumn("rank", F.row_number().over(w))
    hits = docs.select(F.concat_ws("/", "lang", "source").alias("question"), "rank", F.col("doc_id").alias("id"))
    first, i = hits.filter("rank = 1"), F.col("id")
    label = F.element_at(F.array(*map(F.lit, ("strong", "weak", "no_match", "moderate"))), (i % 4 + 1).cast("int"))
    caller = F.when(i % 2 == 0, "agent").otherwise("hook")
    asks = first.select("question", F.lit(NOW).cast("timestamp").alias("ts"), caller.alias("caller"), label.alias("confidence"), (i % 5 == 0).alias("pointers_only"), (i % 3 == 0).alias("json"), F.lit(100).alias("notes"), (i % 7 < 3).alias("tight"), F.lit(True).alias("floor_applied"))
    return hits, asks


def ask_packs(spark, d):
    """The pack of each question, its texts by their digests."""
    hits, _ = _questions(spark, d)
    pack = D.packs(hits, _notes(spark, d), _edges(spark, d), BUDGET)
    return pack.select("question", "position", "id", "edge_type", "fm_tokens", F.sha2("body", 256).alias("body"), "body_tokens", "excerpted")


def ask_accesses(spark, d):
    """What the questions add to the access log."""
    hits, asks = _questions(spark, d)
    return D.access_rows(D.packs(hits, _notes(spark, d), _edges(spark, d), BUDGET), asks).drop("ts")


def ask_deliveries(spark, d):
    hits, asks = _questions(spark, d)
    return D.counts(D.packs(hits, _notes(spark, d), _edges(spark, d), BUDGET), asks)


def delivered_notes(spark, d):
    """Clicks as accesses of the items of their kind's number, logged with delivery or from before it was."""
    c = read(spark, d, "clicks").filter("client_id is not null and ts is not null")
    log_ = c.select(F.col("client_id").alias("note_id"), "ts", F.when(F.col("kind") == "view", "agent").otherwise("hook").alias("caller"), F.when(F.col("value") > 50, True).when(F.col("value") > 20, False).alias("body_delivered"))
    people = read(spark, d, "clients").groupBy(F.col("client_id").alias("id")).agg(F.min("name").alias("title"), F.min("segment").alias("type"))
    return D.delivered_notes(log_, people).withColumn("last", F.unix_micros("last"))


def _payload(spark, d):
    """An event for each user and day, whose JSON has two lists of ten notes: by value and by time, newest first."""
    e = log(spark, d).select(F.concat_ws("-", F.col("user").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("key"), F.get_json_object("props", "$.k").alias("note_id"), "value", "ts", "event_id")
    place = lambda *by: F.row_number().over(Window.partitionBy("key").orderBy(*by))
    ranked = e.withColumn("x", place(F.desc("value"), "event_id")).withColumn("y", place(F.desc("ts"), "event_id"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= 10, F.struct(F.col(c).alias("rank"), "note_id")))), lambda r: F.struct(r["note_id"].alias("note_id"), r["rank"].alias("rank")))
    data = F.to_json(F.struct(F.struct(F.struct(listed("x").alias("results")).alias("value"), F.struct(listed("y").alias("results")).alias("recent")).alias("variants")))
    events = ranked.filter("x <= 10 or y <= 10").groupBy(F.col("key").alias("event_id")).agg(data.alias("event_data"))
    return events.select("event_id", F.when(F.substring_index("event_id", "-", 1).cast("int") % 5 == 0, "").when(F.substring_index("event_id", "-", 1).cast("int") % 2 == 0, "recent").otherwise("value").alias("primary_variant"), "event_data")


def shadow_payloads(spark, d):
    """Each user's events of a day under four variants in one pass, read back from the JSON that is logged."""
    e = log(spark, d).select(F.concat_ws("-", F.col("user").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("event_id"), F.col("event_id").alias("note_id"), "ts", "value")
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("ts", "note_id"))
    v = Variants(value=F.col("value"), recent=F.unix_micros("ts"), mixed=F.round(F.col("value") - F.col("position") * 10, 6))
    data = v.payloads(e.withColumn("position", place), "mixed", ["none", "value", "recent"], 5)
    return A.payload(data).withColumn("rank", F.col("rank").cast("long"))


def nested_note_stats(spark, d):
    return A.payload(_payload(spark, d)).groupBy(F.col("note_id").alias("note")).agg(F.count_distinct("event_id").alias("n"), F.min("rank").cast("long").alias("best"))


def nested_compare(spark, d):
    p = _payload(spark, d)
    return A.comparisons(A.payload(p), p.select("event_id", "primary_variant"), 5).select("event_id", "shadow_variant", F.round("jaccard", 6).alias("jaccard"), F.round("tau", 6).alias("tau"), F.col("shared").cast("long").alias("shared"))


def nested_compare_means(spark, d):
    p = _payload(spark, d)
    return A.mean_comparisons(A.comparisons(A.payload(p), p.select("event_id", "primary_variant"), 5)).select("primary_variant", "shadow_variant", "events", F.round("jaccard", 6).alias("jaccard"), F.round("tau", 6).alias("tau"), "tau_events")


def outcome_performance(spark, d):
    """Outcomes are results whose note is a multiple of three."""
    p = _payload(spark, d)
    return A.outcome_performance(p.select("event_id", "primary_variant"), A.payload(p).filter(F.col("note_id").cast("int") % 3 == 0)).select("variant", "events", "outcomes", *[F.round(c, 6).alias(c) for c in ("hit_5", "hit_10", "mrr")])


def activation_compressed(spark, d):
    spans = A.session_spans(log(spark, d))
    return A.compressed_activation(accesses(spark, d), spans, NOW, 0.2).select("id", "n", F.round("retrieval", 6).alias("retrieval"), F.round("activation", 6).alias("activation"))


def registry_issues(spark, d):
    types = spark.createDataFrame([(f"src{i}", ["quality"] if i % 2 else ["quality", "status"], ["en", "de"] if i % 3 == 0 else []) for i in range(12)], "type string, required array<string>, statuses array<string>")
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("q"))
    field = F.when(F.col("doc_id") % 3 == 0, "grade").otherwise("quality")
    notes = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("source").alias("type"), F.col("lang").alias("status"), F.create_map(field, "q").alias("fields"))
    return C.registry_issues(notes, types, {"quality": ["grade"]})


def neighbors_confident(spark, d):
    return G.neighbours(_edges(spark, d), 17, 2, confidence="medium").select("id", "distance")


QUERIES = {f.__name__: f for f in (context_pack_targets, context_pack_two_pass, context_pack_body_first, ask_hits, ask_packs, ask_accesses, ask_deliveries, delivered_notes, shadow_payloads, nested_note_stats, nested_compare, nested_compare_means, outcome_performance, activation_compressed, registry_issues, neighbors_confident)}

_GRAPH = """e AS (SELECT doc_id AS src, doc_id // 10 AS dst, 'explicit_relation' AS edge_type, 'high' AS confidence, doc_id * 3 AS "at" FROM documents
 UNION ALL SELECT doc_id, (doc_id * 7 + 3) % 100, 'explicit_link', 'high', doc_id * 3 + 1 FROM documents UNION ALL SELECT doc_id, doc_id + 2, 'tag_overlap', CASE WHEN doc_id % 2 = 0 THEN 'medium' ELSE 'low' END, doc_id * 3 + 2 FROM documents)"""
_TARGETS = f"""n AS (SELECT doc_id AS id, ceil(strlen('{{"title":"Doc ' || doc_id || '","type":"' || source || '"}}') / 4.0)::BIGINT AS fm_tokens, strlen(text) AS bytes, ceil(strlen(text) / 4.0)::BIGINT AS tokens, doc_id % 28 AS updated FROM documents),
t AS (SELECT id AS target, fm_tokens, least(tokens, {BUDGET} - fm_tokens) AS body_tokens, bytes = 0 OR tokens > {BUDGET} - fm_tokens AS truncated, {BUDGET} - fm_tokens - least(tokens, {BUDGET} - fm_tokens) AS remaining FROM n)"""
_CANDIDATES = f"""WITH RECURSIVE {_GRAPH}, {_TARGETS},
both_ways AS (SELECT src AS target, dst AS id, edge_type, confidence, "at" AS o FROM e UNION ALL SELECT dst, src, edge_type, confidence, "at" + 1000000000000 FROM e),
c AS (SELECT target, id, arg_min(edge_type, o) AS edge_type, arg_min(confidence, o) AS confidence, min(o) AS o FROM both_ways WHERE target <> id GROUP BY target, id),
p AS (SELECT c.target, c.id, edge_type, confidence, n.fm_tokens, n.tokens, t.remaining, row_number() OVER (PARTITION BY c.target ORDER BY CASE edge_type WHEN 'explicit_relation' THEN 0 WHEN 'explicit_link' THEN 1 ELSE CASE WHEN confidence = 'medium' THEN 2 ELSE 3 END END, updated DESC, o) AS position
 FROM c JOIN n ON n.id = c.id JOIN t ON t.target = c.target WHERE t.remaining > 0)"""
_TWO = f"""{_CANDIDATES}, k AS (SELECT * FROM (SELECT *, sum(fm_tokens) OVER (PARTITION BY target ORDER BY position) AS used FROM p) WHERE used <= remaining),
s AS (SELECT *, remaining - max(used) OVER (PARTITION BY target) AS start FROM k),
f AS (SELECT target, position, id, edge_type, confidence, fm_tokens, CASE WHEN tokens > 0 AND tokens <= start THEN tokens END AS body_tokens, CASE WHEN tokens <= start THEN start - tokens ELSE start END AS room FROM s WHERE position = 1
 UNION ALL SELECT s.target, s.position, s.id, s.edge_type, s.confidence, s.fm_tokens, CASE WHEN tokens > 0 AND tokens <= room THEN tokens END, CASE WHEN tokens <= room THEN room - tokens ELSE room END FROM f JOIN s ON s.target = f.target AND s.position = f.position + 1)"""
_PACKS = f"""{_TWO}, q AS (SELECT concat_ws('/', lang, source) AS question, doc_id AS target, text FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY abs(length(text) - 3000), doc_id) = 1),
own AS (SELECT question, 0 AS position, target AS id, NULL AS edge_type, fm_tokens, text AS whole, body_tokens,
 CASE WHEN strlen(text) > 4 * ({BUDGET} - fm_tokens) THEN (SELECT max(left(text, i::BIGINT)) FROM range(4 * ({BUDGET} - fm_tokens) + 1) r(i) WHERE strlen(left(text, i::BIGINT)) <= 4 * ({BUDGET} - fm_tokens)) ELSE nullif(text, '') END AS body FROM q JOIN t USING (target)),
more AS (SELECT question, position, f.id, edge_type, fm_tokens, d.text AS whole, body_tokens, CASE WHEN body_tokens IS NOT NULL THEN d.text END AS body FROM q JOIN f USING (target) JOIN documents d ON d.doc_id = f.id),
pack AS (SELECT question, position::INT AS position, id, edge_type, fm_tokens, body, CASE WHEN body IS NOT NULL THEN body_tokens END::BIGINT AS body_tokens, coalesce(body <> whole, false) AS excerpted FROM (SELECT * FROM own UNION ALL SELECT * FROM more)),
asks AS (SELECT question, CASE WHEN target % 2 = 0 THEN 'agent' ELSE 'hook' END AS caller, ['strong', 'weak', 'no_match', 'moderate'][(target % 4 + 1)::INT] AS label, target % 5 = 0 AS pointers_only, target % 3 = 0 AS json, target % 7 < 3 AS tight FROM q)"""
_LISTS = f"""e AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS event_id, user_id, json_extract_string(props, '$.k') AS note, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY value DESC, event_id) AS x, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id) AS y FROM events),
r AS (SELECT event_id, user_id, 'value' AS variant, note, x AS rank FROM e WHERE x <= 10 UNION ALL SELECT event_id, user_id, 'recent', note, y FROM e WHERE y <= 10),
pv AS (SELECT DISTINCT event_id, CASE WHEN user_id % 5 = 0 THEN '' WHEN user_id % 2 = 0 THEN 'recent' ELSE 'value' END AS pv FROM r)"""
_COMPARED = f"""{_LISTS}, b AS (SELECT event_id, variant, note, min(rank) AS rank FROM r GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY event_id, variant ORDER BY rank) AS place FROM b),
w AS (SELECT event_id, count(DISTINCT note) AS either, count(*) - count(DISTINCT note) AS common FROM o WHERE place <= 5 GROUP BY event_id),
s AS (SELECT a.event_id, a.note, a.place AS p, z.place AS q FROM o a JOIN o z ON a.event_id = z.event_id AND a.note = z.note AND a.variant = 'value' AND z.variant = 'recent'),
k AS (SELECT a.event_id, sum(sign((a.p - z.p) * (a.q - z.q))) / count(*) AS tau FROM s a JOIN s z ON a.event_id = z.event_id AND a.note < z.note GROUP BY a.event_id),
m AS (SELECT pv.event_id, pv AS primary_variant, CASE WHEN pv = 'value' THEN 'recent' ELSE 'value' END AS shadow_variant, w.common / w.either AS jaccard, tau, (SELECT count(*) FROM s WHERE s.event_id = pv.event_id) AS shared FROM pv JOIN w ON w.event_id = pv.event_id LEFT JOIN k ON k.event_id = pv.event_id WHERE pv <> '')"""
_SEEN = """l1 AS (SELECT DISTINCT dst AS id FROM g WHERE src = 17 AND dst <> 17), l2 AS (SELECT DISTINCT dst AS id FROM g WHERE src IN (SELECT id FROM l1) AND dst <> 17 AND dst NOT IN (SELECT id FROM l1))"""
ORACLE_SQL = {
    "context_pack_targets": f"WITH {_TARGETS} SELECT * FROM t",
    "context_pack_two_pass": f"""{_TWO}
SELECT target, position, id, edge_type, confidence, fm_tokens, body_tokens::BIGINT AS body_tokens FROM f""",
    "context_pack_body_first": f"""{_CANDIDATES},
f AS (SELECT target, position, id, edge_type, confidence, fm_tokens, CASE WHEN tokens > 0 AND tokens <= remaining - fm_tokens THEN tokens END AS body_tokens, remaining - fm_tokens - CASE WHEN tokens <= remaining - fm_tokens THEN tokens ELSE 0 END AS room FROM p WHERE position = 1 AND fm_tokens <= remaining
 UNION ALL SELECT p.target, p.position, p.id, p.edge_type, p.confidence, p.fm_tokens, CASE WHEN tokens > 0 AND tokens <= room - p.fm_tokens THEN tokens END, room - p.fm_tokens - CASE WHEN tokens <= room - p.fm_tokens THEN tokens ELSE 0 END FROM f JOIN p ON p.target = f.target AND p.position = f.position + 1 AND p.position <= {ITEMS} AND p.fm_tokens <= room)
SELECT target, position, id, edge_type, confidence, fm_tokens, body_tokens::BIGINT AS body_tokens FROM f""",
    "ask_hits": f"""{_FUSED}, h AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM fused ORDER BY score DESC, id LIMIT 10), g AS (SELECT (max(score) - min(score)) / max(score) AS gap FROM h WHERE rank <= 2)
SELECT rank, id, round(score, 9) AS score, (SELECT round({_COS}, 6) FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id = h.id) AS similarity, CASE WHEN gap >= 0.05 THEN 'high' WHEN gap >= 0.015 THEN 'moderate' WHEN gap >= 0.005 THEN 'low' ELSE 'ambiguous' END AS confidence FROM h, g""",
    "ask_packs": f"{_PACKS} SELECT question, position, id, edge_type, fm_tokens, sha256(body) AS body, body_tokens, excerpted FROM pack",
    "ask_accesses": f"""{_PACKS}, r AS (SELECT *, CASE WHEN NOT bool_or(body IS NOT NULL) OVER (PARTITION BY question) THEN 'below_floor' WHEN json THEN NULL WHEN pointers_only THEN 'pointers_only' WHEN label = 'no_match' OR label = 'weak' AND NOT tight THEN 'below_floor' END AS reason FROM pack JOIN asks USING (question))
SELECT question, id AS note_id, caller, reason IS NULL AND body IS NOT NULL AS body_delivered, reason FROM r""",
    "ask_deliveries": f"""{_PACKS}, told AS (SELECT question, count(*) AS notes, sum((NOT pointers_only AND body IS NOT NULL)::INT)::BIGINT AS delivered, sum((NOT pointers_only AND body IS NOT NULL AND excerpted)::INT)::BIGINT AS excerpted FROM pack JOIN asks USING (question) GROUP BY question),
said AS (SELECT *, notes - delivered AS titles_only FROM told)
SELECT question, notes, delivered, excerpted, titles_only, delivered || ' delivered' || CASE WHEN delivered = 0 THEN '' WHEN excerpted = delivered THEN ' as excerpt' || CASE WHEN excerpted > 1 THEN 's' ELSE '' END WHEN excerpted > 0 THEN ', ' || excerpted || ' as excerpt' || CASE WHEN excerpted > 1 THEN 's' ELSE '' END ELSE ' in full' END
 || CASE WHEN delivered > 0 AND titles_only > 0 THEN ', ' || titles_only || CASE WHEN titles_only = 1 THEN ' title only' ELSE ' titles only' END ELSE '' END AS phrase FROM said""",
    "delivered_notes": """WITH a AS (SELECT client_id AS id, ts FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND (value > 50 OR ((value IS NULL OR value <= 20) AND kind = 'view'))), p AS (SELECT client_id AS id, coalesce(min(name), '') AS title, coalesce(min(segment), '') AS type FROM clients GROUP BY client_id)
SELECT id, count(*) AS accesses, epoch_us(max(ts)) AS last, any_value(title) AS title, any_value(type) AS type FROM a JOIN p USING (id) GROUP BY id""",
    "shadow_payloads": """WITH c AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS event_id, event_id AS note, ts, value, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS p FROM events),
r AS (SELECT event_id, 'none' AS variant, note, p AS rank FROM c UNION ALL SELECT event_id, 'value', note, row_number() OVER (PARTITION BY event_id ORDER BY value DESC NULLS LAST, p) FROM c
 UNION ALL SELECT event_id, 'recent', note, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, p) FROM c UNION ALL SELECT event_id, 'mixed', note, row_number() OVER (PARTITION BY event_id ORDER BY round(value - p * 10, 6) DESC NULLS LAST, p) FROM c)
SELECT event_id, variant, note::VARCHAR AS note_id, rank FROM r WHERE rank <= 5""",
    "nested_note_stats": f"WITH {_LISTS} SELECT note, count(DISTINCT event_id) AS n, min(rank) AS best FROM r GROUP BY note",
    "nested_compare": f"WITH {_COMPARED} SELECT event_id, shadow_variant, round(jaccard, 6) AS jaccard, round(tau, 6) AS tau, shared FROM m",
    "nested_compare_means": f"WITH {_COMPARED} SELECT primary_variant, shadow_variant, count(*) AS events, round(avg(jaccard), 6) AS jaccard, round(avg(tau), 6) AS tau, count(tau) AS tau_events FROM m GROUP BY ALL",
    "outcome_performance": f"""WITH {_LISTS}, c AS (SELECT pv AS variant, count(*) AS events FROM pv WHERE pv <> '' GROUP BY pv), w AS (SELECT variant, rank FROM r JOIN pv USING (event_id) WHERE variant = pv AND note::INT % 3 = 0)
SELECT c.variant, any_value(events) AS events, count(rank) AS outcomes, round(coalesce(avg((rank <= 5)::INT), 0), 6) AS hit_5, round(coalesce(avg((rank <= 10)::INT), 0), 6) AS hit_10, round(coalesce(avg(1.0 / rank), 0), 6) AS mrr FROM c LEFT JOIN w ON w.variant = c.variant GROUP BY c.variant""",
    "activation_compressed": """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER u <= 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g), w AS (SELECT min(ts) AS a, max(ts) AS b FROM s GROUP BY user_id, no ORDER BY a DESC, b DESC LIMIT 100),
i AS (SELECT min(a) AS a, max(b) AS b FROM (SELECT a, b, sum(new) OVER (ORDER BY a, b) AS island FROM (SELECT a, b, CASE WHEN a <= max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM w)) GROUP BY island),
x AS (SELECT event_id, user_id AS id, epoch_us(TIMESTAMP '2024-02-01') / 1e6 - epoch_us(ts) / 1e6 AS total, (SELECT sum(greatest(0, epoch_us(least(b, TIMESTAMP '2024-02-01')) / 1e6 - epoch_us(greatest(a, e.ts)) / 1e6)) FROM i) AS active FROM events e WHERE event_type = 'view'),
y AS (SELECT id, count(*) AS n, ln(sum(power((active + 0.2 * (total - active)) / 3600, -0.5))) AS r FROM x GROUP BY id)
SELECT id, n, round(r, 6) AS retrieval, round(0.6 * r + 0.4 * ln(1 + n), 6) AS activation FROM y""",
    "registry_issues": """WITH n AS (SELECT d.doc_id AS id, source, TRY_CAST(substring(source, 4) AS INT) AS i, lang, q FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)
SELECT id, 'unknown_type' AS rule, 'warning' AS severity, 'type' AS field FROM n WHERE i IS NULL OR i >= 12 UNION ALL SELECT id, 'missing_required_field', 'error', 'quality' FROM n WHERE i < 12 AND q IS NULL
UNION ALL SELECT id, 'missing_required_field', 'error', 'status' FROM n WHERE i < 12 AND i % 2 = 0 AND coalesce(lang, '') = '' UNION ALL SELECT id, 'invalid_status', 'warning', 'status' FROM n WHERE i < 12 AND i % 3 = 0 AND lang <> '' AND lang NOT IN ('en', 'de')""",
    "neighbors_confident": f"WITH {_GRAPH}, g AS (SELECT src, dst FROM e WHERE confidence <> 'low' UNION SELECT dst, src FROM e WHERE confidence <> 'low'), {_SEEN} SELECT 17 AS id, 0 AS distance UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2",
}
