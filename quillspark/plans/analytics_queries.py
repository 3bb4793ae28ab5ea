"""Queries of usage analytics, episodes and checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import ago
from ..operators import analytics as A
from ..operators import checks as C
from .tables import NOW, accesses, log, notes, read, vectors




def activation_scores(spark, d):
    x = A.activation(accesses(spark, d), NOW)
    return x.select("id", "n", *[F.round(c, 6).alias(c) for c in ("retrieval", "storage", "activation")])


def self_hot_stale(spark, d):
    """The hottest ten notes by activation from the last access only, and whether a week has passed."""
    x = accesses(spark, d).groupBy("id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    age = A.seconds(F.to_timestamp(F.lit(NOW))) - A.seconds(F.col("last"))
    x = x.select("id", "n", age.alias("age"), F.log(F.col("n") * F.pow(age / 3600, F.lit(-0.5))).alias("hot"))
    return x.orderBy(F.desc("hot"), "id").limit(10).select("id", "n", F.round("hot", 6).alias("hot"), (F.col("age") > 7 * 86400).alias("stale"), ago(F.col("age")).alias("ago"))


def session_gaps(spark, d):
    return A.gaps(A.session_spans(log(spark, d))).select("user", "session_no", "gap")


def gap_percentiles(spark, d):
    return A.gaps(A.session_spans(log(spark, d))).agg(F.count("*").alias("n"), *[F.expr(f"percentile_disc({p}) within group (order by gap)").cast("long").alias(n) for n, p in (("median", 0.5), ("p90", 0.9))], F.max("gap").alias("largest"))


def user_sessions(spark, d):
    return A.session_spans(log(spark, d)).select("user", "session_no", "n", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"))


def _meter(spark, d):
    e = log(spark, d)
    inj = e.filter("event_type = 'view'").select(F.col("event_id").alias("inj_id"), F.col("user").alias("key"), "ts", (F.get_json_object("props", "$.k").cast("int") % 4).alias("caller"))
    return A.consumed(inj, e.filter("event_type = 'purchase'").select(F.col("user").alias("key"), "ts"), 6 * 3600)


def memory_use(spark, d):
    return _meter(spark, d).agg(F.count("*").alias("n"), F.sum(F.col("consumed").cast("int")).alias("n_consumed"))


def memory_use_by_caller(spark, d):
    return _meter(spark, d).groupBy("caller").agg(F.count("*").alias("n"), F.sum(F.col("consumed").cast("int")).alias("n_consumed"))


def per_note_stats(spark, d):
    e = log(spark, d).select("event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("note")).distinct()
    return e.groupBy("note").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last"))


def session_trace(spark, d):
    s = A.sessions(log(spark, d)).filter("user = 8 and session_no <= 5")
    return s.withColumn("note", F.get_json_object("props", "$.k").cast("int")).groupBy("session_no", "note").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


def note_trace(spark, d):
    s = A.sessions(log(spark, d)).withColumn("note", F.get_json_object("props", "$.k").cast("int")).filter("note = 69")
    return s.select("event_id", "user", "session_no", "event_type")


def _ranks(spark, d):
    """Ranks from events: the note is props' k, the rank within a user's day by value; variant by event type."""
    e = log(spark, d).withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("user", "day").orderBy(F.desc("value"), "event_id")
    return e.select(F.concat_ws("-", F.col("user").cast("string"), F.date_format("day", "yyyyMMdd")).alias("event_id"), F.col("event_type").alias("variant"), F.row_number().over(w).alias("rank"))


def hit_mrr_report(spark, d):
    r = _ranks(spark, d)
    return A.hit_mrr(r, None, 3).select("variant", F.round("hit_at_k", 6).alias("hit_at_k"), F.round("mrr", 6).alias("mrr"))


def variant_performance(spark, d):
    r = _ranks(spark, d)
    return r.groupBy("variant").agg(F.count("*").alias("n"), *[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"hit_{k}") for k in (5, 10)], F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"))


def distinct_variants(spark, d):
    return _ranks(spark, d).select("variant").distinct().orderBy("variant")


def _two_rankings(spark, d):
    """Each label's vectors ranked by their first and by their second element."""
    v = vectors(spark, d).select("id", F.col("label").alias("key"), F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    rank = lambda c: F.row_number().over(Window.partitionBy("key").orderBy(F.desc(c), "id"))
    return v.select("key", "id", rank("x").alias("rank_a"), rank("y").alias("rank_b"))


def compare_kendall(spark, d):
    return A.kendall(_two_rankings(spark, d)).select("key", F.round("tau", 6).alias("tau"))


def compare_jaccard(spark, d):
    r = _two_rankings(spark, d)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(c, "id"))), lambda x: x["id"])
    g = r.groupBy("key").agg(listed("rank_a").alias("a"), listed("rank_b").alias("b"))
    return g.select("key", F.round(A.jaccard_at(F.col("a"), F.col("b"), 10), 6).alias("jaccard"))


def outcome_links(spark, d):
    """Purchases with the views of the same note in the user's same or previous session before them."""
    s = A.sessions(log(spark, d)).withColumn("note", F.get_json_object("props", "$.k").cast("int") % 5)
    acc = s.filter("event_type = 'purchase'").select(F.col("event_id").alias("access_id"), "user", "note", F.col("session_no").alias("at"), F.col("ts").alias("t"))
    hits = s.filter("event_type = 'view'").select("event_id", F.col("user").alias("u"), F.col("note").alias("m"), "session_no", "ts")
    return acc.join(hits, (F.col("user") == F.col("u")) & (F.col("note") == F.col("m")) & F.col("session_no").between(F.col("at") - 1, F.col("at")) & (F.col("ts") <= F.col("t"))).select("access_id", "event_id")


def orphan_sessions(spark, d):
    e = log(spark, d)
    starts = e.filter("event_type = 'signup'").select(F.col("event_id").alias("session_id"), F.col("ts").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"))
    ends = e.filter("event_type <> 'signup'").select((F.col("event_id") - F.get_json_object("props", "$.k").cast("int")).alias("session_id"), "ts")
    return A.recovered(starts, ends).select("session_id", F.unix_micros("started_at").alias("started"), F.unix_micros("ended_at").alias("ended"))


def merged_windows(spark, d):
    x = log(spark, d).select(F.col("user").alias("key"), F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(mins=F.floor(F.col("value")).cast("int"))).alias("end"))
    return A.merged(x).select("key", "island", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"))


def export_redacted(spark, d):
    """Anonymous tier: identities hashed, payloads dropped."""
    return log(spark, d).select("event_id", F.sha2(F.col("user").cast("string"), 256).alias("user_hash"), "event_type", F.unix_micros("ts").alias("at"))


def usage_summary(spark, d):
    e = log(spark, d)
    return e.agg(F.count("*").alias("n_events"), F.count_distinct("user").alias("n_users"), F.count_distinct(F.to_date("ts")).alias("n_days"), F.sum((F.col("event_type") == "view").cast("int")).alias("n_views"))


def bank_rate(spark, d):
    return read(spark, d, "orders").agg(F.count("*").alias("total"), F.sum((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).cast("int")).alias("added"))


def latest_calibration(spark, d):
    return log(spark, d).groupBy("user").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def activation_signal(spark, d):
    """The truth table of an access's source and delivery: what counts as a use."""
    k = F.get_json_object("props", "$.k").cast("int")
    delivered = F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False))
    counts = F.when(F.col("event_type") == "view", delivered.isNull() | delivered).when(F.col("event_type").isin("click", "purchase"), delivered.isNotNull() & delivered).otherwise(False)
    return log(spark, d).select("event_id", counts.alias("counts"))


def exclude_callers(spark, d):
    return log(spark, d).filter(~F.col("event_type").isin("error", "signup")).groupBy("user").agg(F.count("*").alias("n"), F.unix_micros(F.max("ts")).alias("last"))


def validate_rules(spark, d):
    o = read(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    rules = {"invalid_status": ("error", ~F.col("o_orderstatus").isin("O", "F")), "missing_required": ("error", F.col("o_orderpriority").isNull() | (F.col("o_orderpriority") == "4-NOT SPECIFIED")), "large": ("warning", F.col("o_totalprice") > 450000)}
    return C.issues(o, rules)


def severity_counts(spark, d):
    return validate_rules(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


def broken_refs(spark, d):
    refs = read(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 2).alias("ref"))
    return C.broken_references(refs, read(spark, d, "documents").select(F.col("doc_id").alias("target")))


def reconcile_drift(spark, d):
    x = read(spark, d, "documents")
    disk = x.filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    index = x.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return C.reconcile(disk, index)


def duplicate_ids(spark, d):
    return C.duplicates(read(spark, d, "documents").select(F.md5("text").alias("hash"), "doc_id"), "hash", "doc_id")


def status_types(spark, d):
    types = spark.createDataFrame([(f"src{i}",) for i in range(25)], "type string")
    return types.join(notes(spark, d).groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def type_distribution(spark, d):
    return read(spark, d, "documents").groupBy(F.coalesce(F.nullif("lang", F.lit("")), F.lit("unstructured")).alias("type")).agg(F.count("*").alias("n"))


def modality_coverage(spark, d):
    return C.coverage(notes(spark, d).select("id"), {"labels": read(spark, d, "labels").select(F.col("doc_id").alias("id")), "vectors": vectors(spark, d).select("id")})


def doctor_summary(spark, d):
    rows = [("drift", reconcile_drift(spark, d)), ("duplicates", duplicate_ids(spark, d)), ("broken_refs", broken_refs(spark, d)), ("issues", validate_rules(spark, d))]
    out = None
    for name, x in rows:
        one = x.agg(F.lit(name).alias("metric"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


def episode_summary(spark, d):
    c = read(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum((F.col("role") == "user").cast("int")).alias("user_turns"), F.sum((F.col("role") == "assistant").cast("int")).alias("assistant_turns"), F.sum(F.char_length("text")).alias("chars"))


def episode_roles(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("last_user"))


def signal_filter(spark, d):
    return notes(spark, d).filter(F.octet_length("text") >= 6000).select("id", F.octet_length("text").cast("long").alias("bytes"))


def rule_candidates(spark, d):
    """Turns that hold a lexeme of a rule, with the first such lexeme."""
    rules = {"loss": ["perdu", "verloren", "lost"], "that": ["that ", "que ", "dass "]}
    low = F.lower("text")
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.get(F.filter(F.array(*map(F.lit, words)), lambda x: F.contains(low, x)), 0).alias("lexeme")) for r, words in rules.items()])
    return read(spark, d, "conversations").select("conv_id", "turn", F.explode(each).alias("x")).filter("x.lexeme is not null").select("conv_id", "turn", "x.rule", "x.lexeme")


QUERIES = {f.__name__: f for f in (activation_scores, self_hot_stale, session_gaps, gap_percentiles, user_sessions, memory_use, memory_use_by_caller, per_note_stats, session_trace, note_trace, hit_mrr_report, variant_performance, distinct_variants, compare_kendall, compare_jaccard, outcome_links, orphan_sessions, merged_windows, export_redacted, usage_summary, bank_rate, latest_calibration, activation_signal, exclude_callers, validate_rules, severity_counts, broken_refs, reconcile_drift, duplicate_ids, status_types, type_distribution, modality_coverage, doctor_summary, episode_summary, episode_roles, signal_filter, rule_candidates)}
_K = "CAST(json_extract_string(props, '$.k') AS INT)"
_S = """s0 AS (SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 <= 1800 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM s0),
spans AS (SELECT user_id, session_no, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY ALL),
gaps AS (SELECT * FROM (SELECT user_id, session_no, round(epoch_us(started) / 1e6 - epoch_us(lag(started) OVER (PARTITION BY user_id ORDER BY started)) / 1e6)::BIGINT AS gap FROM spans) WHERE gap IS NOT NULL)"""
_METER = f"""m AS (SELECT e.event_id, {_K} % 4 AS caller, EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts >= e.ts AND epoch_us(p.ts) <= epoch_us(e.ts) + 21600000000) AS hit FROM events e WHERE e.event_type = 'view')"""
_R = "r AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS event_id, event_type AS variant, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY value DESC, event_id) AS rank FROM events)"
_TWO = "t AS (SELECT label AS key, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank_a, row_number() OVER (PARTITION BY label ORDER BY embedding[2] DESC, vec_id) AS rank_b FROM embeddings)"
_ISSUES = """issues AS (SELECT o_orderkey AS id, 'invalid_status' AS rule, 'error' AS severity FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT o_orderkey, 'missing_required', 'error' FROM orders WHERE o_orderpriority IS NULL OR o_orderpriority = '4-NOT SPECIFIED'
 UNION ALL SELECT o_orderkey, 'large', 'warning' FROM orders WHERE o_totalprice > 450000)"""
_BROKEN = "broken AS (SELECT doc_id AS id, doc_id * 2 AS ref FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents))"
_DRIFT = """drift AS (SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN b.doc_id IS NULL THEN 'unindexed' WHEN a.doc_id IS NULL THEN 'orphaned' ELSE 'drifted' END AS state
 FROM (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0) a FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.doc_id % 11 = 0)"""
_DUP = "dup AS (SELECT * FROM (SELECT md5(text) AS hash, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1)"
ORACLE_SQL = {
    "activation_scores": """SELECT user_id AS id, count(*) AS n, round(ln(sum(power((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6 / 3600, -0.5))), 6) AS retrieval, round(ln(1 + count(*)), 6) AS storage,
round(0.6 * ln(sum(power((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6 / 3600, -0.5))) + 0.4 * ln(1 + count(*)), 6) AS activation FROM events WHERE event_type = 'view' GROUP BY user_id""",
    "self_hot_stale": """WITH x AS (SELECT user_id AS id, count(*) AS n, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1e6 AS age FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT id, n, round(ln(n * power(age / 3600, -0.5)), 6) AS hot, age > 604800 AS stale, CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN floor(age / 60)::BIGINT || 'm ago' WHEN age < 86400 THEN floor(age / 3600)::BIGINT || 'h ago' ELSE floor(age / 86400)::BIGINT || 'd ago' END AS ago
FROM x ORDER BY ln(n * power(age / 3600, -0.5)) DESC, id LIMIT 10""",
    "session_gaps": f'WITH {_S} SELECT user_id AS "user", session_no, gap FROM gaps',
    "gap_percentiles": f"WITH {_S} SELECT count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY gap) AS median, percentile_disc(0.9) WITHIN GROUP (ORDER BY gap) AS p90, max(gap) AS largest FROM gaps",
    "user_sessions": f'WITH {_S} SELECT user_id AS "user", session_no, n, epoch_us(started) AS started, epoch_us(ended) AS ended FROM spans',
    "memory_use": f"WITH {_METER} SELECT count(*) AS n, sum(hit::INT)::BIGINT AS n_consumed FROM m",
    "memory_use_by_caller": f"WITH {_METER} SELECT caller, count(*) AS n, sum(hit::INT)::BIGINT AS n_consumed FROM m GROUP BY caller",
    "per_note_stats": f"SELECT {_K} AS note, count(DISTINCT event_id) AS n, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events GROUP BY 1",
    "session_trace": f"WITH {_S} SELECT session_no, {_K} AS note, min(event_id) AS first_event, count(*) AS n FROM s WHERE user_id = 8 AND session_no <= 5 GROUP BY ALL",
    "note_trace": f'WITH {_S} SELECT event_id, user_id AS "user", session_no, event_type FROM s WHERE {_K} = 69',
    "hit_mrr_report": f"WITH {_R}, b AS (SELECT event_id, variant, min(rank) AS rank FROM r GROUP BY ALL), n AS (SELECT count(DISTINCT event_id) AS t FROM r) SELECT variant, round(sum((rank <= 3)::INT) / max(t), 6) AS hit_at_k, round(sum(1.0::DOUBLE / rank) / max(t), 6) AS mrr FROM b, n GROUP BY variant",
    "variant_performance": f"WITH {_R} SELECT variant, count(*) AS n, round(avg((rank <= 5)::INT), 6) AS hit_5, round(avg((rank <= 10)::INT), 6) AS hit_10, round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM r GROUP BY variant",
    "distinct_variants": "SELECT DISTINCT event_type AS variant FROM events ORDER BY 1",
    "compare_kendall": f"WITH {_TWO}, p AS (SELECT a.key, sum(sign((a.rank_a - b.rank_a) * (a.rank_b - b.rank_b))) / count(*) AS tau FROM t a JOIN t b ON a.key = b.key AND a.id < b.id GROUP BY a.key) SELECT k.key, round(tau, 6) AS tau FROM (SELECT DISTINCT key FROM t) k LEFT JOIN p ON p.key = k.key",
    "compare_jaccard": f"WITH {_TWO}, g AS (SELECT key, list(id ORDER BY rank_a) FILTER (rank_a <= 10) AS a, list(id ORDER BY rank_b) FILTER (rank_b <= 10) AS b FROM t GROUP BY key) SELECT key, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS jaccard FROM g",
    "outcome_links": f"""WITH {_S} SELECT a.event_id AS access_id, h.event_id FROM s a JOIN s h ON a.user_id = h.user_id AND CAST(json_extract_string(a.props, '$.k') AS INT) % 5 = CAST(json_extract_string(h.props, '$.k') AS INT) % 5
 AND h.session_no BETWEEN a.session_no - 1 AND a.session_no AND h.ts <= a.ts WHERE a.event_type = 'purchase' AND h.event_type = 'view'""",
    "orphan_sessions": f"""WITH e AS (SELECT event_id - {_K} AS session_id, max(ts) AS last FROM events WHERE event_type <> 'signup' GROUP BY 1)
SELECT event_id AS session_id, epoch_us(ts) AS started, epoch_us(coalesce(last, ts + INTERVAL 1 MINUTE)) AS ended FROM events LEFT JOIN e ON event_id = session_id WHERE event_type = 'signup'""",
    "merged_windows": """WITH x AS (SELECT user_id AS key, ts AS s, ts + to_minutes(floor(value)::BIGINT) AS e FROM events),
y AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x),
z AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM y) SELECT key, island, epoch_us(min(s)) AS start, epoch_us(max(e)) AS "end" FROM z GROUP BY key, island""",
    "export_redacted": "SELECT event_id, sha256(user_id::VARCHAR) AS user_hash, event_type, epoch_us(ts) AS at FROM events",
    "usage_summary": "SELECT count(*) AS n_events, count(DISTINCT user_id) AS n_users, count(DISTINCT ts::DATE) AS n_days, sum((event_type = 'view')::INT)::BIGINT AS n_views FROM events",
    "bank_rate": "SELECT count(*) AS total, sum((o_orderdate >= TIMESTAMP '1998-01-01')::INT)::BIGINT AS added FROM orders",
    "latest_calibration": 'SELECT user_id AS "user", arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id',
    "activation_signal": f"WITH x AS (SELECT event_id, event_type, {_K} % 3 AS k FROM events) SELECT event_id, CASE WHEN event_type = 'view' THEN k <> 1 WHEN event_type IN ('click', 'purchase') THEN k = 0 ELSE false END AS counts FROM x",
    "exclude_callers": "SELECT user_id AS \"user\", count(*) AS n, epoch_us(max(ts)) AS last FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY user_id",
    "validate_rules": f"WITH {_ISSUES} SELECT * FROM issues",
    "severity_counts": f"WITH {_ISSUES} SELECT severity, count(*) AS n FROM issues GROUP BY severity",
    "broken_refs": f"WITH {_BROKEN} SELECT * FROM broken",
    "reconcile_drift": f"WITH {_DRIFT} SELECT * FROM drift",
    "duplicate_ids": f"WITH {_DUP} SELECT hash, doc_id FROM dup",
    "status_types": "SELECT t.type, count(doc_id) AS n FROM (SELECT 'src' || i AS type FROM range(25) x(i)) t LEFT JOIN documents ON source = t.type GROUP BY t.type",
    "type_distribution": "SELECT coalesce(nullif(lang, ''), 'unstructured') AS type, count(*) AS n FROM documents GROUP BY 1",
    "modality_coverage": "SELECT count(*) AS n_notes, count(l.doc_id) AS n_labels, count(vec_id) AS n_vectors, sum((l.doc_id IS NOT NULL AND vec_id IS NOT NULL)::INT)::BIGINT AS n_all FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings ON vec_id = d.doc_id",
    "doctor_summary": f"WITH {_DRIFT}, {_DUP}, {_BROKEN}, {_ISSUES} SELECT 'drift' AS metric, count(*) AS n FROM drift UNION ALL SELECT 'duplicates', count(*) FROM dup UNION ALL SELECT 'broken_refs', count(*) FROM broken UNION ALL SELECT 'issues', count(*) FROM issues",
    "episode_summary": "SELECT conv_id, count(*) AS turns, sum((role = 'user')::INT)::BIGINT AS user_turns, sum((role = 'assistant')::INT)::BIGINT AS assistant_turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id",
    "episode_roles": "SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations",
    "signal_filter": "SELECT doc_id AS id, strlen(text) AS bytes FROM documents WHERE strlen(text) >= 6000",
    "rule_candidates": "SELECT conv_id, turn, rule, lexeme FROM (SELECT conv_id, turn, rule, list_filter(words, lambda x: contains(lower(text), x))[1] AS lexeme FROM conversations, (VALUES ('loss', ['perdu', 'verloren', 'lost']), ('that', ['that ', 'que ', 'dass '])) r(rule, words)) WHERE lexeme IS NOT NULL",
}
