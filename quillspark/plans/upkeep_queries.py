"""Queries of the index's upkeep and of episodes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shell import outside_quotes
from ..sources import episodes as E
from ..sources import index as I
from .tables import read


def index_plan(spark, d):
    """What a run would do: documents as files, against an index that has seen all but the German ones, some since changed or moved.

    Two documents that follow one another declare one id. Of every language the index knows other hashes or times."""
    docs = read(spark, d, "documents")
    path = F.concat_ws("/", "source", F.concat("doc_id", F.lit(".md")))
    name = F.concat(F.lit("n"), F.col("doc_id") - F.col("doc_id") % 2)
    files = docs.select(path.alias("path"), F.when(F.col("lang") == "en", 2).otherwise(1).cast("long").alias("mtime"), F.sha2("text", 256).alias("hash"), name.alias("id"))
    old_path = F.when(F.col("lang") == "es", F.concat(F.lit("old/"), path)).otherwise(path)
    old_hash = F.when(F.length("text") % 2 == 0, F.lit("before")).otherwise(F.sha2("text", 256))
    old_id = F.when(F.col("doc_id") % 2 == 0, name).otherwise(F.concat(F.lit("_path:"), path))
    catalog = docs.filter("lang <> 'de'").select(old_path.alias("path"), old_hash.alias("hash"), F.lit(1).cast("long").alias("mtime"), old_id.alias("id"))
    changes = I.classified(files, catalog)
    parsed = files.join(changes.filter("change in ('added', 'changed')"), "path", "left_semi").select("path", "id")
    return I.settled(changes, parsed)


def _lines(spark, d):
    """Conversations as lines of transcripts: assistants also call a tool, which one by the turn."""
    c = read(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    tool = F.element_at(F.array(*map(F.lit, ("Bash", "Edit", "Other"))), (F.col("turn") % 3 + 1).cast("int"))
    given = F.struct(F.concat(F.lit('git commit -m "'), F.regexp_extract("text", "^([^ \n]*)", 1), F.lit('"')).alias("command"), F.concat(F.lit("/f"), "turn").alias("file_path"))
    said = F.concat(F.lit('{"role":"assistant","content":['), F.to_json(F.struct(F.lit("text").alias("type"), "text")), F.lit(","), F.to_json(F.struct(F.lit("tool_use").alias("type"), tool.alias("name"), given.alias("input"))), F.lit("]}"))
    message = F.when(F.col("role") == "assistant", said).otherwise(F.to_json(F.struct("role", F.col("text").alias("content"))))
    head = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("s"), F.floor(F.col("conv_id") / 2).cast("string")).alias("sessionId"), F.format_string("2024-01-%02dT10:00:%02dZ", F.col("conv_id").bitwiseAND(15) + 1, "turn").alias("timestamp"), (F.col("conv_id") % 10 == 3).alias("isSidechain")))
    value = F.concat(F.substring_index(head, "}", 1), F.lit(',"message":'), message, F.lit("}"))
    return c.select(F.concat(F.lit("c"), "conv_id").alias("path"), F.lit(0).cast("long").alias("start"), F.col("turn").alias("offset"), value.alias("value"))


def episode_records(spark, d):
    found = E.episodes(_lines(spark, d))
    said = lambda c: F.array_join(F.transform(c, lambda m: m["text"]), "|")
    return found.join(E.captured(found).select("path", "outcome", "first_path"), "path").select(
        *("path", "id", "segment_id", "session_id", "started_at", "ended_at", "outcome", "first_path"),
        said("user_messages").alias("asked"),
        said("assistant_messages").alias("answered"),
        E.tool_text(F.col("tool_counts")).alias("tools"),
        F.array_join("commits", "|").alias("commits"),
        F.array_join("files_touched", "|").alias("files"),
    )


def shell_skeletons(spark, d):
    """Documents as commands in which some words open or close quotes, and what of each stands outside of them."""
    command = F.regexp_replace(F.regexp_replace("text", " (the|la|die) ", " '$1 "), " (and|et|und) ", ' "\\\\" $1 ')
    return read(spark, d, "documents").select("doc_id", outside_quotes(command).alias("outside"))


QUERIES = {f.__name__: f for f in (index_plan, episode_records, shell_skeletons)}
ORACLE_SQL = {
    "shell_skeletons": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, ' (the|la|die) ', ' ''\1 ', 'g'), ' (and|et|und) ', ' "\\" \1 ', 'g'), '(?s)''[^'']*(?:''|$)|"(?:[^"\\]|\\.)*(?:\\)?(?:"|$)', '', 'g') AS outside FROM documents""",
    "index_plan": """WITH f AS (SELECT source || '/' || doc_id || '.md' AS path, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS m, sha256(text) AS h, 'n' || (doc_id - doc_id % 2) AS id FROM documents),
k AS (SELECT CASE WHEN lang = 'es' THEN 'old/' ELSE '' END || source || '/' || doc_id || '.md' AS path, CASE WHEN length(text) % 2 = 0 THEN 'before' ELSE sha256(text) END AS h, 1 AS m,
 CASE WHEN doc_id % 2 = 0 THEN 'n' || doc_id ELSE '_path:' || source || '/' || doc_id || '.md' END AS old_id FROM documents WHERE lang <> 'de'),
c AS (SELECT coalesce(f.path, k.path) AS path, k.old_id, f.id, f.path IS NOT NULL AS here, CASE WHEN k.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'gone' WHEN f.m = k.m THEN 'same' WHEN f.h = k.h THEN 'touched' ELSE 'new' END AS change FROM f FULL JOIN k ON f.path = k.path),
held AS (SELECT old_id AS id, path, 0 AS o FROM c WHERE here AND old_id IS NOT NULL UNION ALL SELECT id, path, 1 FROM c WHERE change = 'new'),
first AS (SELECT id, path AS holder FROM held QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, path) = 1),
w AS (SELECT c.path, change, CASE WHEN change = 'new' THEN c.id ELSE old_id END AS id, old_id FROM c WHERE change <> 'same'),
a AS (SELECT w.*, holder, CASE WHEN change = 'touched' THEN 'touch' WHEN change = 'gone' THEN CASE WHEN holder IS NULL THEN 'delete' ELSE 'move' END WHEN holder = path THEN 'store' ELSE 'duplicate' END AS action FROM w LEFT JOIN first USING (id))
SELECT path, action, id, old_id, CASE WHEN action IN ('duplicate', 'move') THEN holder END AS holder FROM a""",
    "episode_records": r"""WITH c AS (SELECT *, ['Bash', 'Edit', 'Other'][(turn % 3 + 1)::INT] AS tool, printf('2024-01-%02dT10:00:%02dZ', (conv_id & 15) + 1, turn) AS ts FROM conversations),
t AS (SELECT conv_id, tool, count(*) AS n FROM c WHERE role = 'assistant' GROUP BY ALL),
tools AS (SELECT conv_id, string_agg(tool || '=' || n, ', ' ORDER BY n DESC, tool) AS tools FROM t GROUP BY conv_id),
e AS (SELECT conv_id, min(ts) AS started_at, max(ts) AS ended_at, coalesce(string_agg(text, '|' ORDER BY turn) FILTER (WHERE role = 'user' AND trim(text) <> ''), '') AS asked, coalesce(string_agg(text, '|' ORDER BY turn) FILTER (WHERE role = 'assistant' AND trim(text) <> ''), '') AS answered,
 coalesce(string_agg('' || CASE WHEN regexp_matches(text, '^[ \n]') OR text = '' THEN 'git commit -m ""' ELSE regexp_extract(text, '^([^ \n]*)', 1) END, '|' ORDER BY turn) FILTER (WHERE role = 'assistant' AND tool = 'Bash'), '') AS commits,
 coalesce(string_agg(DISTINCT '/f' || turn, '|' ORDER BY '/f' || turn) FILTER (WHERE role = 'assistant' AND tool = 'Edit'), '') AS files FROM c GROUP BY conv_id),
n AS (SELECT *, 'c' || conv_id AS path, 's' || conv_id // 2 AS session_id, 'episode-' || substring(started_at, 1, 10) || '-s' || substring((conv_id // 2)::VARCHAR, 1, 7) AS id FROM e),
o AS (SELECT *, min(CASE WHEN conv_id % 10 <> 3 THEN path END) OVER (PARTITION BY id) AS first FROM n)
SELECT path, id, id || '-part00000000' AS segment_id, session_id, started_at, ended_at, CASE WHEN conv_id % 10 = 3 THEN 'sidechain' WHEN path = first THEN 'captured' ELSE 'collision' END AS outcome,
 CASE WHEN conv_id % 10 <> 3 AND path <> first THEN first END AS first_path, asked, answered, coalesce(tools, 'none') AS tools, commits, files FROM o LEFT JOIN tools USING (conv_id)""",
}
