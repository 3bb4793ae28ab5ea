"""Queries of changes to notes, plans of them and generated regions, and their SQL. Documents stand in for notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frontmatter as FM
from ..operators import policy as PO
from ..operators import regions as RG
from .tables import read


def _documents(spark, d):
    return read(spark, d, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("en")).alias("lang"), F.coalesce("source", F.lit("src0")).alias("source"), F.concat(F.lit("d/"), "doc_id").alias("path"))


def _notes(spark, d):
    """Documents with frontmatter, but for every tenth."""
    day = F.format_string("%02d", F.col("doc_id") % 28 + 1)
    front = F.concat(F.lit("---\nid: n"), "doc_id", F.lit("\ntype: "), "source", F.lit("\nlang: "), "lang", F.lit("\ntags: "), "lang", F.lit("\ncreated: 2024-01-"), day, F.lit("T00:00:00Z\ndueDate: 3\n---\n\n"), "text")
    return _documents(spark, d).withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.col("text")).otherwise(front))


def frontmatter_normalised(spark, d):
    return _notes(spark, d).select("doc_id", F.sha2(FM.normalised(F.col("content")), 256).alias("content")).filter("content is not null")


def _operations(spark, d):
    """A plan for each four documents: a status, no tags, a title and a summary, and new tags for every other one."""
    op = lambda k, kind, key, value: F.struct((F.col("doc_id") * 8 + k).alias("seq"), F.lit(kind).alias("op"), F.lit(key).alias("key"), value.alias("value"))
    title = F.concat(F.lit('"T '), F.col("doc_id").cast("string"), F.lit('"'))
    each = [op(1, FM.SET, "status", F.col("lang")), op(2, FM.UNSET, "tags", F.lit(None).cast("string")), op(3, FM.MERGE, "title", title), op(3, FM.MERGE, "summary", F.col("lang")), op(4, FM.SET, "tags", F.when(F.col("doc_id") % 2 == 0, "[new]"))]
    rows = _documents(spark, d).select(F.floor(F.col("doc_id") / 4).alias("plan"), "path", F.explode(F.array(*each)).alias("o")).select("plan", "path", "o.*")
    return rows.filter("op <> 'frontmatter_set' or value is not null")


def _types(spark, d):
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    statuses = F.when(F.col("type").endswith("7"), words("en", "de")).otherwise(words())
    required = F.when(F.col("type").endswith("3"), words("tags")).otherwise(words())
    return _documents(spark, d).select(F.col("source").alias("type")).distinct().select("type", words("summary", "lang").alias("fields"), required.alias("required"), statuses.alias("statuses"))


def plan_results(spark, d):
    return FM.checked(_notes(spark, d).select("path", "content"), _operations(spark, d), _types(spark, d))


def plan_files(spark, d):
    notes, ops = _notes(spark, d).select("path", "content"), _operations(spark, d)
    return FM.applied(notes, ops, FM.checked(notes, ops, _types(spark, d))).select("plan", "path", "before", F.sha2("content", 256).alias("after"), "changed")


def plan_absent_keys(spark, d):
    ops = _operations(spark, d)
    again = ops.filter("op = 'frontmatter_unset' and plan % 3 = 0").withColumn("seq", F.col("seq") + 3)
    return FM.absent_keys(_notes(spark, d).select("path", "content"), ops.union(again.select(*ops.columns)))


def _marked(spark, d):
    """Documents with a generated region of six kinds: with its checksum, edited since, without one, not ended, twice, and without a template."""
    k = F.col("doc_id") % 6
    old = F.concat(F.lit("old "), "lang", F.lit("\n"))
    check = F.when(k < 2, F.concat(F.lit("<!-- checksum:"), F.sha2(F.when(k == 0, old).otherwise("other"), 256), F.lit(" -->\n"))).otherwise("")
    name = F.when(k == 5, "links").otherwise("summary")
    end = F.when(k == 3, "").otherwise(F.concat(F.lit("<!-- GENERATED:"), name, F.lit(":END -->\n")))
    one = F.concat(F.lit("<!-- GENERATED:"), name, F.lit(":START -->\n"), check, old, end)
    text = F.concat(F.lit("Head\n"), one, F.when(k == 4, one).otherwise(""), "text")
    return _documents(spark, d).select("doc_id", "path", F.col("source").alias("type"), text.alias("text"))


def region_issues(spark, d):
    return _marked(spark, d).select("doc_id", F.explode(RG.region_issues(F.col("text"))).alias("x")).select("doc_id", "x.*")


def regions_rendered(spark, d):
    notes = _marked(spark, d)
    templates = notes.select("type").distinct().select("type", F.lit("summary").alias("section"), F.concat(F.lit("S:"), "type", F.lit("\n")).alias("body"))
    return RG.rendered(notes, templates).select("path", F.sha2("text", 256).alias("text"), "sections", "error")


def policy_decisions(spark, d):
    """Orders as changes of files in repositories of many states."""
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    access = F.element_at(F.array(*map(F.lit, PO.ACCESS)), (k % 4 + 1).cast("int"))
    rows = read(spark, d, "orders").select(k.alias("id"), access.alias("access"), F.concat(F.lit("f"), (k % 5).cast("string")).alias("target"), (F.col("o_orderstatus") != "P").alias("repo"), (k % 3 == 0).alias("clean"), (k % 7 == 0).alias("detached"), (k % 11 == 0).alias("merging"), F.lit(None).cast("boolean").alias("rebasing"), F.when(k % 2 == 0, F.array(F.lit("f0"), F.lit("f1"))).otherwise(none).alias("staged"), none.alias("unstaged"))
    rule = lambda x: F.concat_ws("=", x["rule"], x["decision"])
    return PO.decided(rows, {"no_repo": "allow"}).select("id", "decision", F.array_join(F.transform("reasons", rule), " ").alias("reasons"))


def plan_issues(spark, d):
    """Orders as plans, their lines as operations of which some lack fields."""
    line, text = F.col("l_linenumber"), lambda c: F.lit(c).cast("string")
    op = F.element_at(F.array(*map(F.lit, ("frontmatter_set", "frontmatter_unset", "note_create", "other"))), (line % 4 + 1).cast("int"))
    target = F.when(F.col("l_quantity") > 25, "").otherwise("t")
    ops = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), line.alias("at"), op.alias("op"), target.alias("target"), F.when(F.col("l_returnflag") != "R", "k").alias("key"), F.col("l_returnflag").alias("value"), F.create_map().cast("map<string,string>").alias("fields"), text(None).alias("section_key"), text(None).alias("template"), target.alias("path"), F.col("l_returnflag").alias("type"), F.when(F.col("l_linestatus") == "O", F.create_map().cast("map<string,string>")).alias("frontmatter"))
    plans = read(spark, d, "orders").select(F.col("o_orderkey").alias("plan"), F.when(F.col("o_orderkey") % 9 == 0, 2).otherwise(1).alias("version"))
    types = read(spark, d, "lineitem").filter("l_returnflag like '%A%'").select(F.col("l_returnflag").alias("type")).distinct()
    return PO.plan_issues(plans, ops, types)


def created_notes(spark, d):
    """Documents as new notes, two to each path, of which every fifth path is taken."""
    docs = _documents(spark, d).withColumn("path", F.concat(F.lit("d/n"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string"), F.lit(".md")))
    asked = docs.select("path", F.col("doc_id").alias("at"), F.col("source").alias("type"), F.create_map(F.lit("lang"), "lang").alias("fields"), F.col("text").alias("body"))
    return PO.created(asked, docs.filter("doc_id % 10 = 0").select("path")).select("path", "at", "id", F.sha2("content", 256).alias("content"), "error")


QUERIES = {f.__name__: f for f in (frontmatter_normalised, plan_results, plan_files, plan_absent_keys, region_issues, regions_rendered, policy_decisions, plan_issues, created_notes)}

_D = "d AS (SELECT doc_id, text, coalesce(lang, 'en') AS lang, coalesce(source, 'src0') AS source, 'd/' || doc_id AS path, printf('2024-01-%02d', doc_id % 28 + 1) AS day FROM documents)"
_BODY = r"""CASE WHEN ltrim(text, E'\r\n') = '' THEN text ELSE ltrim(text, E'\r\n') END"""
_N = _D + r""", n AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN text ELSE concat(E'---\nid: n', doc_id, E'\ntype: ', source, E'\nlang: ', lang, E'\ntags: ', lang, E'\ncreated: ', day, E'T00:00:00Z\ndueDate: 3\n---\n\n') || text END AS content FROM d)"""
_OPS = """ops AS (SELECT doc_id // 4 AS plan, doc_id * 8 + k AS seq, op, path, key, doc_id, source, lang, text FROM d, (VALUES (1, 'frontmatter_set', 'status'), (2, 'frontmatter_unset', 'tags'), (3, 'frontmatter_merge', 'title'), (3, 'frontmatter_merge', 'summary'), (4, 'frontmatter_set', 'tags')) v(k, op, key) WHERE k < 4 OR doc_id % 2 = 0),
told AS (SELECT *, CASE WHEN doc_id % 10 = 0 OR text IS NULL THEN 'parse_error' WHEN key = 'status' AND source LIKE '%7' AND lang NOT IN ('en', 'de') THEN 'invalid_status' WHEN op = 'frontmatter_unset' AND source LIKE '%3' THEN 'missing_required_field' END AS error FROM ops),
bad AS (SELECT plan, arg_min(error, (seq, key)) AS error, min(seq) AS first_bad FROM told WHERE error IS NOT NULL GROUP BY plan)"""
_MARKED = r"""m0 AS (SELECT *, doc_id % 6 AS k, concat('old ', lang, E'\n') AS old, CASE WHEN doc_id % 6 = 5 THEN 'links' ELSE 'summary' END AS name FROM d),
m1 AS (SELECT *, concat('<!-- GENERATED:', name, E':START -->\n') AS s, CASE k WHEN 0 THEN concat('<!-- checksum:', sha256(old), E' -->\n') WHEN 1 THEN concat('<!-- checksum:', sha256('other'), E' -->\n') ELSE '' END AS c, CASE WHEN k = 3 THEN '' ELSE concat('<!-- GENERATED:', name, E':END -->\n') END AS e FROM m0),
m AS (SELECT *, concat('Head', E'\n') AS head, CASE WHEN k = 4 THEN concat(s, c, old, e) ELSE '' END AS again FROM m1 WHERE text IS NOT NULL)"""
ORACLE_SQL = {
    "frontmatter_normalised": f"""WITH {_D} SELECT doc_id, sha256(concat(E'---\\nid: n', doc_id, E'\\ntype: ', source, E'\\ntags:\\n  - ', lang, E'\\ncreated: "', day, E'"\\ndue_date: 3\\nlang: ', lang, E'\\n---\\n\\n', {_BODY})) AS content FROM d WHERE doc_id % 10 <> 0 AND text IS NOT NULL""",
    "plan_results": f"WITH {_D}, {_OPS} SELECT plan, seq, op, path, key, CASE WHEN first_bad IS NULL OR seq < first_bad THEN 'ok' WHEN seq = first_bad THEN 'error' ELSE 'skipped' END AS status, CASE WHEN seq = first_bad THEN bad.error END AS error FROM told LEFT JOIN bad USING (plan)",
    "plan_files": f"""WITH {_N}, {_OPS} SELECT doc_id // 4 AS plan, path, sha256(content) AS before, sha256(concat(E'---\\nid: n', doc_id, E'\\ntype: ', source, E'\\nlang: ', lang, E'\\ncreated: ', day, E'T00:00:00Z\\ndueDate: 3\\nstatus: ', lang, E'\\nsummary: ', lang, E'\\ntitle: "T ', doc_id, '"', CASE WHEN doc_id % 2 = 0 THEN E'\\ntags: [new]' ELSE '' END, E'\\n---\\n\\n', {_BODY})) AS after, true AS changed
FROM n WHERE doc_id // 4 NOT IN (SELECT plan FROM bad)""",
    "plan_absent_keys": f"WITH {_D} SELECT doc_id // 4 AS plan, doc_id * 8 + 2 AS seq, path, 'tags' AS key FROM d WHERE doc_id % 10 = 0 OR text IS NULL UNION ALL SELECT doc_id // 4, doc_id * 8 + 5, path, 'tags' FROM d WHERE doc_id // 4 % 3 = 0 AND doc_id % 2 = 1",
    "region_issues": f"WITH {_D}, {_MARKED} SELECT doc_id, 'summary' AS key, CASE WHEN k = 3 THEN 'malformed_markers' ELSE 'duplicate_markers' END AS rule, CASE WHEN k = 3 THEN 2 ELSE 5 END AS line FROM m WHERE k IN (3, 4)",
    "regions_rendered": f"""WITH {_D}, {_MARKED}, r AS (SELECT *, CASE k WHEN 1 THEN 'checksum_mismatch' WHEN 3 THEN 'malformed_markers' WHEN 5 THEN 'template_not_found' END AS error, concat('S:', source, E'\\n') AS new FROM m)
SELECT path, sha256(CASE WHEN error IS NULL THEN concat(head, s, '<!-- checksum:', sha256(new), E' -->\\n', new, e, again, text) ELSE concat(head, s, c, old, e, again, text) END) AS text, 1 AS sections, error FROM r""",
    "policy_decisions": """WITH x AS (SELECT o_orderkey AS id, (o_orderkey % 4)::INT AS a, o_orderstatus <> 'P' AS repo, o_orderkey % 3 = 0 AS clean, o_orderkey % 2 = 0 AND o_orderkey % 5 < 2 AS own, o_orderkey % 7 = 0 AS det, o_orderkey % 11 = 0 AS mer FROM orders),
r AS (SELECT id, 0 AS n, 'dirty_unrelated' AS rule, ['allow', 'allow', 'warn', 'warn'][a + 1] AS d FROM x WHERE repo AND NOT clean AND NOT own UNION ALL SELECT id, 1, 'dirty_target', ['allow', 'allow', 'refuse', 'refuse'][a + 1] FROM x WHERE repo AND own
 UNION ALL SELECT id, 2, 'detached_head', ['allow', 'allow', 'warn', 'refuse'][a + 1] FROM x WHERE repo AND det UNION ALL SELECT id, 3, 'merge_in_progress', ['allow', 'allow', 'refuse', 'refuse'][a + 1] FROM x WHERE mer
 UNION ALL SELECT id, 4, 'no_repo', ['warn', 'warn', 'allow', 'refuse'][a + 1] FROM x WHERE NOT repo), g AS (SELECT id, max(CASE d WHEN 'refuse' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS worst, string_agg(rule || '=' || d, ' ' ORDER BY n) AS reasons FROM r GROUP BY id)
SELECT x.id, ['allow', 'warn', 'refuse'][coalesce(worst, 0) + 1] AS decision, coalesce(reasons, '') AS reasons FROM x LEFT JOIN g USING (id)""",
    "plan_issues": """WITH l AS (SELECT l_orderkey AS plan, l_linenumber AS "at", l_linenumber % 4 AS k, l_quantity > 25 AS bare, l_returnflag, l_linestatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 9 <> 0)
SELECT o_orderkey AS plan, NULL::INT AS "at", CASE WHEN o_orderkey % 9 = 0 THEN 'unsupported_version' ELSE 'empty_plan' END AS code, NULL AS field FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT plan, "at", 'missing_field', CASE WHEN k < 2 THEN 'target' ELSE 'path' END FROM l WHERE k < 3 AND bare UNION ALL SELECT plan, "at", 'missing_field', 'key' FROM l WHERE k < 2 AND coalesce(l_returnflag, 'R') = 'R'
UNION ALL SELECT plan, "at", 'missing_field', 'frontmatter' FROM l WHERE k = 2 AND coalesce(l_linestatus, '') <> 'O' UNION ALL SELECT plan, "at", 'missing_field', 'value' FROM l WHERE k = 0 AND l_returnflag IS NULL
UNION ALL SELECT plan, "at", 'missing_field', 'type' FROM l WHERE k = 2 AND l_returnflag IS NULL UNION ALL SELECT plan, "at", 'unknown_type', 'type' FROM l WHERE k = 2 AND l_returnflag NOT LIKE '%A%' UNION ALL SELECT plan, "at", 'unknown_operation', 'op' FROM l WHERE k = 3""",
    "created_notes": f"""WITH {_D}, x AS (SELECT *, doc_id - doc_id % 2 AS p, row_number() OVER (PARTITION BY doc_id - doc_id % 2 ORDER BY doc_id) > 1 OR doc_id - doc_id % 2 IN (SELECT doc_id FROM documents WHERE doc_id % 10 = 0) AS bad FROM d)
SELECT concat('d/n', p, '.md') AS path, doc_id AS "at", CASE WHEN NOT bad THEN concat(source, '-n', p) END AS id, CASE WHEN NOT bad THEN sha256(concat(E'---\\nid: ', source, '-n', p, E'\\nlang: ', lang, E'\\ntype: ', source, E'\\n---\\n', CASE WHEN coalesce(text, '') = '' THEN '' ELSE concat(E'\\n', text, CASE WHEN text LIKE E'%\\n' THEN '' ELSE E'\\n' END) END)) END AS content, CASE WHEN bad THEN 'path_exists' END AS error FROM x""",
}
