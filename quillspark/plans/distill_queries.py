"""Queries of episodes and desks, exports, calibrations and the activation lane, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import calibration as K
from ..operators import distill as D
from ..operators import retrieval as R
from ..sources import export as X
from .tables import NOW, accesses, log, notes, query_vector, read, vectors


def _episodes(spark, d):
    """Each conversation as an episode's Markdown, its turns by role; every third turn of a user grants authority or names a principle."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    more = F.when(F.col("turn") % 3 == 0, " You DECIDE, full autonomy").when(F.col("turn") % 3 == 1, " by Principle  4 if you're sure").otherwise("")
    user = F.col("role") == "user"
    text = F.when(user, F.concat(F.lit("> "), F.replace(F.concat("text", more), F.lit("\n"), F.lit("\n> ")))).otherwise(F.col("text"))
    one = F.concat(F.lit("### "), "turn", F.lit(" — t"), "turn", F.lit("\n\n"), text, F.lit("\n\n"))
    listed = lambda wanted: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("turn", one.alias("one"))))), lambda x: x["one"]), "")
    rows = c.groupBy("conv_id").agg(listed(user).alias("u"), listed(F.col("role") == "assistant").alias("a"))
    head = F.concat(F.lit("---\nid: e"), "conv_id", F.lit("\ntype: episode\n---\n\n# Episode\n\n"))
    return rows.select(F.concat(F.lit("x/c"), "conv_id", F.lit(".md")).alias("path"), F.concat(head, F.lit(f"{D.USER}\n\n"), "u", F.lit(f"{D.ASSISTANT}\n\n"), "a").alias("content"))


def episode_turns(spark, d):
    return D.turns(_episodes(spark, d)).select("episode", "section", "turn", "ts", F.sha2("text", 256).alias("text"))


def push_candidates(spark, d):
    return D.pushes(D.turns(_episodes(spark, d)).filter("section = 'user'")).select("rule", "episode", "turn", "ts", "trigger")


def signal_segments(spark, d):
    n = notes(spark, d).select(F.concat(F.lit("e"), "id", F.when(F.col("id") % 5 == 0, "-part00000001").otherwise(""), F.lit(".md")).alias("path"), F.octet_length("text").cast("long").alias("size"))
    return D.signal(n)


def desk_entries(spark, d):
    """Documents as journal entries, of which some are distilled, dated otherwise, hidden, or no entries."""
    docs = read(spark, d, "documents").filter("text is not null")
    k = F.col("doc_id") % 7
    day = F.format_string("2024-01-%02d", F.col("doc_id") % 28 + 1)
    front = F.concat(F.lit("---\nid: d"), "doc_id", F.lit("\ntype: "), F.when(k == 1, "note").otherwise("Journal"), F.when(k == 2, F.concat(F.lit("\ncreated: "), day, F.lit("T10:00:00Z"))).otherwise(F.concat(F.lit("\ndate: '"), day, F.lit("'"))), F.when(k == 3, "\ndistilled_to: arc-1").otherwise(""), F.lit("\ntitle: T\n---\n"), "text")
    path = F.concat(F.when(k == 4, ".hidden/").otherwise("j/"), "doc_id", F.lit(".md"))
    return D.desk(docs.select(path.alias("path"), front.alias("content"))).select("path", "id", "title", "date", F.sha2("snippet", 256).alias("snippet"))


def proposal_arcs(spark, d):
    """What every vector resembles among the first 25, the arcs; every tenth proposal has no text and so no vector."""
    v = vectors(spark, d)
    arcs = v.filter("id < 25").select(F.col("id").alias("arc_id"), F.col("v").alias("arc_v"))
    found = D.annotated(v.select("id", F.when(F.col("id") % 10 != 9, F.col("v")).alias("v")), arcs)
    return found.select("id", F.array_join(F.transform("nearest", lambda x: x["arc_id"].cast("string")), " ").alias("nearest"))


def _events(spark, d):
    """Events with a payload of two variants, and one that is no object for every ninth."""
    e = log(spark, d).withColumn("k", F.get_json_object("props", "$.k"))
    result = lambda rank: F.concat(F.lit('{"note_id":"n'), "k", F.lit(f'","rank":{rank},"path":"p"}}'))
    data = F.concat(F.lit('{"query":"q","variants":{"none":{"results":['), result(1), F.lit(","), result(2), F.lit(']},"odd":{"results":7,"path":"kept"}}}'))
    return e.withColumn("event_data", F.when(F.col("event_id") % 9 == 0, "[1]").otherwise(data))


def export_records(spark, d):
    e = _events(spark, d)
    at, text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    sessions = e.filter("event_type = 'signup'").select(text("event_id").alias("session_id"), at.alias("started_at"), none.alias("ended_at"), F.lit("hook").alias("caller"), none.alias("caller_meta"), text("user").alias("user_session_id"), F.lit("/r").alias("root"))
    events = e.filter("event_type = 'view'").select(text("event_id").alias("event_id"), text("user").alias("session_id"), "event_type", at.alias("timestamp"), F.lit("secret").alias("query_text"), none.alias("query_mode"), F.lit("none").alias("primary_variant"), "event_data", F.lit("/r").alias("root"))
    outcomes = e.filter("event_type = 'purchase'").select(F.concat(F.lit("o"), "event_id").alias("outcome_id"), text("event_id").alias("event_id"), F.col("k").alias("note_id"), F.lit("none").alias("variant"), (F.col("event_id") % 5 + 1).alias("rank"), at.alias("accessed_at"), text("user").alias("session_id"))
    return X.records(sessions, events, outcomes, X.ANONYMOUS, NOW)


def rollup_record(spark, d):
    e = log(spark, d)
    primary = e.filter("event_type <> 'signup'").select("event_id", F.col("event_type").alias("primary_variant"))
    outcomes = e.filter("event_id % 3 = 0").select("event_id", F.col("event_type").alias("variant"), (F.col("event_id") % 12).alias("rank"))
    links = read(spark, d, "labels").select("doc_id")
    n = notes(spark, d).select("id", F.col("tag").alias("type"))
    x = X.rollup(n, links, read(spark, d, "pages"), vectors(spark, d), e.select("user").distinct(), e, outcomes, A.outcome_performance(primary, outcomes), "f", X.ANONYMOUS, NOW)
    listed = lambda c, form: F.array_join(F.transform(F.map_entries(c), form), " ")
    stats = lambda s: F.concat_ws("/", s["key"], s["value"]["event_count"], s["value"]["outcome_count"], *[F.format_string("%.6f", s["value"][c]) for c in ("hit_at_5", "hit_at_10", "mrr")])
    return x.withColumns({"type_distribution": listed("type_distribution", lambda t: F.concat_ws("=", t["key"], t["value"])), "variant_stats": listed("variant_stats", stats)})


def calibration_measure(spark, d):
    v = vectors(spark, d)
    x = K.measured(v, v.filter("id < 8").select((F.transform("v", lambda a: -a)).alias("p")), "all", NOW)
    return x.select("key", "dims", "notes", "probes", "pairs", *[F.round(c, 6).alias(c) for c in ("noise_floor", "mu", "sigma")])


def _snapshots(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return log(spark, d).select(F.col("user").alias("key"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"), k.alias("notes"), (k * 3).alias("pairs"), (F.col("value") / 100).alias("noise_floor"), (k / 100).alias("mu"), (k / 400).alias("sigma"), F.when(k % 4 == 0, 0).otherwise(1).alias("probes_version"))


def floors_resolved(spark, d):
    """Users as collections, their events as snapshots; a third has vectors of either known length."""
    found = K.resolved(read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.element_at(F.array(F.lit(1024), F.lit(384), F.lit(8)), (F.col("c_custkey") % 3 + 1).cast("int")).alias("dims")), K.latest(_snapshots(spark, d)))
    return found.select("key", F.round("noise_floor", 6).alias("noise_floor"), F.round("sigma", 6).alias("sigma"), "tight", "measured")


def calibrations_due(spark, d):
    users = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 6 == 0).cast("int").alias("embedded"), F.when(F.col("c_custkey") % 7 == 0, 1).alias("deleted"))
    return K.due(users, K.latest(_snapshots(spark, d)))


def activation_fused(spark, d):
    """The dense and the keyword lane with that of use, fused."""
    act = A.activation(accesses(spark, d), NOW).select("id", F.round("activation", 9).alias("activation"))
    n = notes(spark, d)
    dense = R.dense(vectors(spark, d), query_vector(spark, d)).select("id", F.round("score", 9).alias("score"))
    lanes = R.assembled(n.filter(F.col("text").contains("the ")).select("id", F.length("text").cast("double").alias("score")), R.activation_lane(act, n), dense=dense, sparse=None)
    return R.top(R.fuse(lanes), 50).select("id", F.round("score", 9).alias("score"), "n_lanes")


QUERIES = {f.__name__: f for f in (episode_turns, push_candidates, signal_segments, desk_entries, proposal_arcs, export_records, rollup_record, calibration_measure, floors_resolved, calibrations_due, activation_fused)}

_K = "CAST(json_extract_string(props, '$.k') AS INT)"
_TURNS = r"""c AS (SELECT conv_id, turn, role, regexp_replace(concat(text, CASE WHEN role <> 'user' THEN '' WHEN turn % 3 = 0 THEN ' You DECIDE, full autonomy' WHEN turn % 3 = 1 THEN ' by Principle  4 if you''re sure' ELSE '' END), '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE role IN ('user', 'assistant'))"""
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SNAPSHOTS = f"""s AS (SELECT user_id AS key, {_K} AS k, value / 100 AS floor, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), newest AS (SELECT * FROM s WHERE n = 1)"""
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_COSINE = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
ORACLE_SQL = {
    "episode_turns": f"WITH {_TURNS} SELECT 'e' || conv_id AS episode, role AS section, turn::BIGINT AS turn, 't' || turn AS ts, sha256(text) AS text FROM c",
    "push_candidates": f"""WITH {_TURNS} SELECT rule, 'e' || conv_id AS episode, turn::BIGINT AS turn, 't' || turn AS ts, trigger FROM c, (VALUES (0, 'authority-grant', 'full autonomy'), (1, 'manifesto-lens', 'principle  4'), (1, 'evidence-gate', 'if you''re sure')) v(m, rule, trigger) WHERE role = 'user' AND turn % 3 = m""",
    "signal_segments": "SELECT concat('e', doc_id, CASE WHEN doc_id % 5 = 0 THEN '-part00000001' ELSE '' END, '.md') AS path, strlen(text) AS size FROM documents WHERE doc_id % 5 = 0 OR text IS NULL OR strlen(text) >= 6000",
    "desk_entries": f"""SELECT concat('j/', doc_id, '.md') AS path, 'd' || doc_id AS id, 'T' AS title, printf('2024-01-%02d', doc_id % 28 + 1) AS date, sha256(left({_TRIM.format('text')}, 1200)) AS snippet FROM documents WHERE text IS NOT NULL AND doc_id % 7 NOT IN (1, 3, 4)""",
    "proposal_arcs": f"""WITH r AS (SELECT e.vec_id AS id, q.vec_id AS arc, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_COSINE} DESC, q.vec_id) AS n FROM embeddings e, embeddings q WHERE q.vec_id < 25 AND e.vec_id % 10 <> 9),
g AS (SELECT id, string_agg(arc::VARCHAR, ' ' ORDER BY n) AS nearest FROM r WHERE n <= 3 GROUP BY id) SELECT vec_id AS id, coalesce(nearest, '') AS nearest FROM embeddings LEFT JOIN g ON id = vec_id""",
    "export_records": f"""WITH n AS (SELECT count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'view') AS e, count(*) FILTER (event_type = 'purchase') AS o FROM events)
SELECT 0 AS part, NULL AS at, concat('{{"kind":"manifest","tier":"anonymous","exported_at":"2024-02-01 00:00:00","session_count":', s, ',"event_count":', e, ',"outcome_count":', o, ',"schema_version":1}}') AS value FROM n
UNION ALL SELECT 1, {_ISO}, concat('{{"kind":"session","session_id":"', event_id, '","started_at":"', {_ISO}, '","caller":"hook","user_session_id":"', user_id, '"}}') FROM events WHERE event_type = 'signup'
UNION ALL SELECT 2, {_ISO}, concat('{{"kind":"event","event_id":"', event_id, '","session_id":"', user_id, '","event_type":"view","timestamp":"', {_ISO}, '","primary_variant":"none"', CASE WHEN event_id % 9 = 0 THEN '' ELSE ',"data":{{"query":"q","variants":{{"none":{{"results":[{{"rank":1}},{{"rank":2}}]}},"odd":{{"path":"kept","results":7}}}}}}' END, '}}') FROM events WHERE event_type = 'view'
UNION ALL SELECT 3, {_ISO}, concat('{{"kind":"outcome","outcome_id":"o', event_id, '","event_id":"', event_id, '","variant":"none","rank":', event_id % 5 + 1, ',"accessed_at":"', {_ISO}, '","session_id":"', user_id, '"}}') FROM events WHERE event_type = 'purchase'""",
    "rollup_record": """WITH t AS (SELECT coalesce(nullif(lang, ''), 'unstructured') AS type, count(*) AS n FROM documents GROUP BY 1),
v AS (SELECT event_type AS variant, count(*) AS events, count(*) FILTER (event_id % 3 = 0) AS outcomes, avg((event_id % 12 BETWEEN 1 AND 5)::INT) FILTER (event_id % 3 = 0) AS h5, avg((event_id % 12 BETWEEN 1 AND 10)::INT) FILTER (event_id % 3 = 0) AS h10,
 avg(CASE WHEN event_id % 12 > 0 THEN 1.0::DOUBLE / (event_id % 12) ELSE 0 END) FILTER (event_id % 3 = 0) AS mrr FROM events WHERE event_type <> 'signup' GROUP BY 1)
SELECT 'rollup' AS kind, 1 AS schema_version, 'anonymous' AS tier, 'f' AS fingerprint, (SELECT count(*) FROM documents) AS note_count, (SELECT string_agg(type || '=' || n, ' ' ORDER BY type) FROM t) AS type_distribution,
(SELECT count(*) FROM labels) AS link_count, (SELECT count(*) FROM pages) AS alias_count, (SELECT count(*) FROM embeddings) AS embedding_count, (SELECT max(len(embedding)) FROM embeddings)::INT AS embedding_dims,
(SELECT string_agg(concat_ws('/', variant, events, outcomes, printf('%.6f', coalesce(h5, 0)), printf('%.6f', coalesce(h10, 0)), printf('%.6f', coalesce(mrr, 0))), ' ' ORDER BY variant) FROM v) AS variant_stats,
'2024-02-01 00:00:00' AS exported_at, (SELECT count(DISTINCT user_id) FROM events) AS session_count, (SELECT count(*) FROM events) AS event_count, (SELECT count(*) FROM events WHERE event_id % 3 = 0) AS outcome_count""",
    "calibration_measure": f"""WITH f AS (SELECT greatest(0, max(-({_COSINE}))) AS floor FROM embeddings e, embeddings q WHERE q.vec_id < 8),
b AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding, (SELECT count(*) FROM embeddings) AS n FROM embeddings), st AS (SELECT max(n) AS n, (max(n) * (max(n) - 1) // 2 + 199999) // 200000 AS stride FROM b),
p AS (SELECT {_COSINE} AS c FROM b e JOIN b q ON e.i < q.i, st WHERE (e.i * (2 * st.n - e.i - 1) // 2 + q.i - e.i - 1) % stride = 0)
SELECT 'all' AS key, (SELECT max(len(embedding)) FROM embeddings)::INT AS dims, (SELECT count(*) FROM embeddings) AS notes, 8::BIGINT AS probes, count(*) AS pairs, round((SELECT floor FROM f), 6) AS noise_floor, round(avg(c), 6) AS mu, round(stddev_pop(c), 6) AS sigma FROM p""",
    "floors_resolved": f"""WITH {_SNAPSHOTS}, x AS (SELECT c_custkey AS key, k, floor, coalesce(k >= 30 AND k * 3 >= 100, false) AS m, c_custkey % 3 AS dims FROM customer LEFT JOIN newest ON key = c_custkey)
SELECT key, round(CASE WHEN m THEN floor WHEN dims = 0 THEN 0.45 ELSE 0 END, 6) AS noise_floor, round(greatest(0.03, least(0.12, CASE WHEN m THEN k / 400 WHEN dims = 0 THEN 0.073 ELSE 0 END)), 6) AS sigma, m AND k / 100 >= 0.58 AS tight, m AS measured FROM x""",
    "calibrations_due": f"WITH {_SNAPSHOTS} SELECT c_custkey AS key FROM customer LEFT JOIN newest ON key = c_custkey WHERE c_custkey % 6 = 0 OR c_custkey % 7 = 0 OR k IS NULL OR k % 4 = 0",
    "activation_fused": f"""WITH a AS (SELECT user_id AS id, round(0.6 * ln(sum(power((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6 / 3600, -0.5))) + 0.4 * ln(1 + count(*)), 9) AS s FROM events WHERE event_type = 'view' AND user_id IN (SELECT doc_id FROM documents) GROUP BY user_id),
l AS (SELECT 'bm25' AS lane, doc_id AS id, length(text)::DOUBLE AS s FROM documents WHERE contains(text, 'the ') UNION ALL SELECT 'dense', e.vec_id, round({_COSINE}, 9) FROM embeddings e, embeddings q WHERE q.vec_id = 0 UNION ALL SELECT 'activation', id, s FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY s DESC, id) AS rank FROM l), f AS (SELECT id, avg(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS n_lanes FROM r WHERE rank <= 100 GROUP BY id)
SELECT id, round(score, 9) AS score, n_lanes FROM f ORDER BY score DESC, id LIMIT 50""",
}
