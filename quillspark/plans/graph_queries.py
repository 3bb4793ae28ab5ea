"""Queries of links, resolution, traversal, packing and text, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import edge_priority, meets_confidence
from ..operators import graph as G
from ..operators import memory as M
from ..operators import structure as S
from ..operators.traversal import traverse
from .tables import EDGES_SQL, NODES_SQL, edges, nodes, notes, read


def entity_resolve(spark, d):
    inputs = spark.createDataFrame([(x,) for x in ("17", "red widget", "RED WIDGET", "Small-Ring", "small_ring", "Part-21", "part-22", "part_23", "parts/24.md", "parts/none.md", "nothing here")], "input string")
    p = read(spark, d, "part").withColumn("key", F.col("p_partkey").cast("string"))
    aliases = p.select(F.col("key").alias("id"), F.concat(F.lit("Part-"), "key").alias("alias"))
    paths = p.select(F.col("key").alias("id"), F.concat(F.lit("parts/"), "key", F.lit(".md")).alias("path"))
    return G.resolve(inputs, p.select(F.col("key").alias("id"), F.col("p_name").alias("title")), aliases, paths)


def links_out(spark, d):
    return G.links_out(edges(spark, d), nodes(spark, d), "N3")


def links_in(spark, d):
    return G.links_in(edges(spark, d), nodes(spark, d), "N3")


def neighbors_bfs(spark, d):
    return G.neighbours(edges(spark, d), "R1", 2).select("id", "distance", "parent")


def neighbors_capped(spark, d):
    """The first fifty nodes in order of discovery."""
    return G.neighbours(edges(spark, d), "R1", 2, 50).select("id", "distance", "n")


def traversals(spark, d):
    """From every nation two steps far, the first forty nodes of each, with the edges that reach them."""
    every = edges(spark, d).withColumns({"confidence": F.lit("high"), "weight": F.lit(None).cast("double")})
    starts = every.filter("edge_type = 'part_of'").select(F.col("src").alias("start"))
    return traverse(every, starts, 2, 40).select("start", "n", "id", "distance", "parent", "source", "edge_type")


def recall(spark, d):
    return G.neighbours(edges(spark, d), "N3", 1).join(nodes(spark, d), "id", "left").select("id", "distance", "title")


def tag_overlap_edges(spark, d):
    tags = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("tag"))
    return G.tag_overlap(tags, 12.0, digits=6).select("a", "b", "n_tags", "weight")


def _links(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("position", "target"))


def link_extract(spark, d):
    kind = F.when(F.col("target").rlike("^(https?://|mailto:)"), "external").otherwise("path")
    return _links(spark, d).select("page_id", F.col("position").cast("long").alias("position"), "target", kind.alias("kind"))


def link_resolve(spark, d):
    p = read(spark, d, "pages")
    by_path = p.select(F.concat(F.lit("/"), F.element_at(F.split("url", "/"), -1)).alias("raw"), F.col("page_id").alias("dst"))
    by_url = p.select(F.col("url").alias("raw"), F.col("page_id").alias("dst"))
    return G.resolve_links(_links(spark, d).select(F.col("page_id").alias("src"), F.col("target").alias("raw")).distinct(), [by_url, by_path])


def headings(spark, d):
    each = read(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), F.lit(1))).alias("position", "title"))
    return each.select("page_id", F.col("position").cast("long").alias("position"), "title")


def slugs(spark, d):
    return read(spark, d, "pages").select("page_id", T.slugify(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


def estimate_tokens(spark, d):
    return notes(spark, d).select("id", T.estimate_tokens(F.col("text")).alias("tokens"))


def excerpt_lead(spark, d):
    return notes(spark, d).select("id", T.excerpt(F.col("text"), 40).alias("excerpt"))


def truncated(spark, d):
    return notes(spark, d).select("id", T.truncate(F.col("text"), 80).alias("short"))


def normalised_names(spark, d):
    return read(spark, d, "customer").select("c_custkey", T.normalise(F.col("c_name")).alias("name"), T.normalise_alias(F.col("c_mktsegment")).alias("segment"))


def title_lookup(spark, d):
    return read(spark, d, "part").filter(F.lower("p_name") == "red widget").select("p_partkey", "p_name")


def mget_order(spark, d):
    ids = spark.createDataFrame([(0, 17), (1, 3), (2, -5), (3, 999999999), (4, 3)], "position long, id long")
    return M.mget(ids, notes(spark, d).select("id", "type")).select("position", "id", "type", F.col("type").isNotNull().alias("found"))


def _items(spark, d):
    n = notes(spark, d)
    return n.select(F.col("type").alias("key"), F.col("id").alias("position"), T.estimate_tokens(F.col("text")).alias("tokens"))


def context_pack_pass1(spark, d):
    return M.prefix_pack(_items(spark, d), 4000).select("key", "position", "tokens", "used")


def context_pack_pass2(spark, d):
    return M.greedy_pack(_items(spark, d), 4000)


def edge_candidates(spark, d):
    """Regions' nations are relations, customers links, suppliers inferred with a confidence by their key."""
    number = F.substring("src", 2, 20).cast("long")
    e = edges(spark, d).withColumn("confidence", F.when(F.col("edge_type") != "based_in", "high").when(number % 3 == 0, "high").when(number % 3 == 1, "medium").otherwise("low"))
    e = e.withColumn("edge_type", F.when(F.col("edge_type") == "part_of", "explicit_relation").when(F.col("edge_type") == "lives_in", "explicit_link").otherwise("tag_overlap"))
    kept = e.filter(meets_confidence(F.col("confidence"), "medium")).withColumn("priority", edge_priority(F.col("edge_type"), F.col("confidence")))
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("dst", "priority").orderBy("src"))).filter("n <= 3").select("src", "dst", "priority", "n")


def generated_ids(spark, d):
    return read(spark, d, "pages").select("page_id", T.generate_id(F.col("url"), F.lit("page")).alias("id"))


def _bodies(spark, d):
    """Documents as Markdown: headings, a fence that holds marks, and block ids around the text."""
    parts = F.lit("# About "), F.col("source"), F.lit("\n```\n## hidden ^no\n```\nlead ^top\n##  In "), F.col("lang"), F.lit(" \n"), F.col("text"), F.lit(" ^doc-"), F.col("doc_id").cast("string"), F.lit("\n~~~\n# open")
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(*parts).alias("body"))


def md_headings(spark, d):
    return S.headings(_bodies(spark, d)).filter("level < 7")


def md_blocks(spark, d):
    return S.blocks(_bodies(spark, d))


def full_notes(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    items = read(spark, d, "lineitem")
    part = lambda c: items.select(F.col("l_orderkey").alias("id"), F.col(c).cast("string").alias("value"))
    return S.full_notes(o, parts=part("l_partkey"), flags=part("l_returnflag"))


def _part_aliases(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("alias"))


def alias_lookup(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return S.with_alias(p, _part_aliases(spark, d), "BRAND#13", any_case=True)


def lookup_names(spark, d):
    return S.names(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), _part_aliases(spark, d))


def path_lookup(spark, d):
    return read(spark, d, "pages").filter(F.col("url").endswith("/7") | (F.col("page_id") == 3)).select("page_id", "url")


def slim_notes(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("type"), F.substring("text", 1, 20).alias("title"))


def links_three_way(spark, d):
    return S.links_with_titles(edges(spark, d).select("src", "dst"), nodes(spark, d)).select("src", "dst", "src_title", "dst_title")


def links_both(spark, d):
    e = edges(spark, d).select("src", "dst")
    return S.links_both(e.union(e.filter("src = 'N3'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "N3")


def snippets(spark, d):
    return notes(spark, d).select("id", T.snippet(F.col("text"), 120).alias("snippet"))


QUERIES = {f.__name__: f for f in (entity_resolve, links_out, links_in, neighbors_bfs, neighbors_capped, traversals, recall, tag_overlap_edges, link_extract, link_resolve, headings, slugs, estimate_tokens, excerpt_lead, truncated, normalised_names, title_lookup, mget_order, context_pack_pass1, context_pack_pass2, edge_candidates, generated_ids, md_headings, md_blocks, full_notes, alias_lookup, lookup_names, path_lookup, slim_notes, links_three_way, links_both, snippets)}
_BFS = f"""WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
l1 AS (SELECT dst AS id, 1 AS distance, min(src) AS parent FROM both_ways WHERE src = 'R1' AND dst <> 'R1' GROUP BY dst),
l2 AS (SELECT dst AS id, 2 AS distance, min(src) AS parent FROM both_ways WHERE src IN (SELECT id FROM l1) AND dst NOT IN (SELECT id FROM l1) AND dst <> 'R1' GROUP BY dst),
seen AS (SELECT 'R1' AS id, 0 AS distance, NULL::VARCHAR AS parent UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""
_ITEMS = "items AS (SELECT source AS key, doc_id AS position, ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM documents)"
_LINKS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS position FROM pages)"""
_MARKS = r"""b AS (SELECT doc_id AS id, '# About ' || source || chr(10) || '```' || chr(10) || '## hidden ^no' || chr(10) || '```' || chr(10) || 'lead ^top' || chr(10) || '##  In ' || lang || ' ' || chr(10) || text || ' ^doc-' || doc_id || chr(10) || '~~~' || chr(10) || '# open' AS body FROM documents),
l AS (SELECT id, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM b),
f AS (SELECT *, regexp_matches(x, '^[\s\v]*(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(x, '^[\s\v]*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line) AS fences FROM l),
m AS (SELECT *, regexp_matches(x, '^#{1,6}[\s\v]+[^\n]+$') AS head, trim(regexp_extract(x, '^(#{1,6})[\s\v]+([^\n]+)$', 2)) AS title FROM f WHERE NOT fence AND fences % 2 = 0)"""
ORACLE_SQL = {
    "md_headings": rf"WITH {_MARKS} SELECT id, line::INT AS line, length(regexp_extract(x, '^(#+)', 1))::INT AS level, title, replace(regexp_replace(lower(title), '[^\p{{L}}\p{{Nd}}_ -]', '', 'g'), ' ', '-') AS slug FROM m WHERE head",
    "md_blocks": rf"""WITH {_MARKS}, h AS (SELECT *, coalesce(last_value(CASE WHEN head THEN title END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line), '') AS heading FROM m)
SELECT id, line::INT AS line, regexp_extract(x, '\^([a-zA-Z0-9][a-zA-Z0-9_-]*)[\s\v]*$', 1) AS block_id, heading FROM h WHERE NOT head AND regexp_matches(x, '\^([a-zA-Z0-9][a-zA-Z0-9_-]*)[\s\v]*$')""",
    "full_notes": "SELECT o_orderkey AS id, any_value(o_orderstatus) AS status, string_agg(DISTINCT l_partkey::VARCHAR, chr(31) ORDER BY l_partkey::VARCHAR) AS parts, string_agg(DISTINCT l_returnflag, chr(31) ORDER BY l_returnflag) AS flags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "alias_lookup": "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey IN (SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#13')",
    "lookup_names": "SELECT p_partkey AS id, p_name AS name FROM part WHERE trim(p_name) <> '' UNION SELECT p_partkey, p_brand FROM part WHERE trim(p_brand) <> ''",
    "path_lookup": "SELECT page_id, url FROM pages WHERE suffix(url, '/7') OR page_id = 3",
    "slim_notes": "SELECT doc_id AS id, source AS type, substring(text, 1, 20) AS title FROM documents",
    "links_three_way": f"WITH {EDGES_SQL}, {NODES_SQL} SELECT src, dst, a.title AS src_title, b.title AS dst_title FROM edges JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = dst",
    "links_both": f"""WITH {EDGES_SQL}, e AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges WHERE src = 'N3'), o AS (SELECT DISTINCT dst AS id FROM e WHERE src = 'N3'), i AS (SELECT DISTINCT src AS id FROM e WHERE dst = 'N3')
SELECT coalesce(o.id, i.id) AS id, CASE WHEN o.id IS NULL THEN 'in' WHEN i.id IS NULL THEN 'out' ELSE 'both' END AS direction FROM o FULL JOIN i ON o.id = i.id""",
    "snippets": r"SELECT doc_id AS id, CASE WHEN length(text) <= 120 THEN text WHEN regexp_matches(substring(text, 91, 30), ' ') THEN regexp_replace(substring(text, 1, 120), ' [^ ]*$', '') || '...' ELSE substring(text, 1, 120) || '...' END AS snippet FROM documents",
    "entity_resolve": """WITH i AS (SELECT unnest(['17', 'red widget', 'RED WIDGET', 'Small-Ring', 'small_ring', 'Part-21', 'part-22', 'part_23', 'parts/24.md', 'parts/none.md', 'nothing here']) AS input),
t AS (SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part), a AS (SELECT id, 'Part-' || id AS name FROM t), n AS (SELECT id, lower(translate(name, '-_', '  ')) AS name FROM (SELECT * FROM t UNION ALL SELECT * FROM a)),
p AS (SELECT input, 0 AS o, 'path' AS tier, id FROM i JOIN t ON input = 'parts/' || id || '.md' WHERE contains(input, '/') OR suffix(input, '.md') UNION SELECT input, 1, 'id', id FROM i JOIN t ON id = input UNION SELECT input, 2, 'title', id FROM i JOIN t ON name = input
 UNION SELECT input, 3, 'alias', id FROM i JOIN a ON name = input UNION SELECT input, 4, 'normalized', id FROM i JOIN t ON lower(name) = lower(input) UNION SELECT input, 5, 'normalized', id FROM i JOIN a ON lower(name) = lower(input)
 UNION SELECT input, 6, 'normalized', id FROM i JOIN n ON name = lower(translate(input, '-_', '  ')) WHERE lower(translate(input, '-_', '  ')) <> lower(input))
SELECT input, tier, min(id) AS id, count(*) AS n, count(*) > 1 AS ambiguous FROM (SELECT *, min(o) OVER (PARTITION BY input) AS best FROM p) WHERE o = best GROUP BY input, tier""",
    "links_out": f"WITH {EDGES_SQL}, {NODES_SQL} SELECT dst, edge_type, id IS NOT NULL AS resolved, title FROM edges LEFT JOIN nodes ON dst = id WHERE src = 'N3'",
    "links_in": f"WITH {EDGES_SQL}, {NODES_SQL} SELECT src, edge_type, title FROM edges JOIN nodes ON src = id WHERE dst = 'N3'",
    "neighbors_bfs": f"{_BFS} SELECT id, distance, parent FROM seen",
    "neighbors_capped": f"""{_BFS}, o AS (SELECT s.*, row_number() OVER (ORDER BY distance, (SELECT count(*) FROM l1 WHERE l1.id < s.parent), id) - 1 AS n FROM seen s) SELECT id, distance, n FROM o WHERE n < 50""",
    "traversals": f"""WITH {EDGES_SQL}, a AS (SELECT x, min((way, edge_type)) AS e, y FROM (SELECT src AS x, 0 AS way, dst AS y, edge_type FROM edges UNION ALL SELECT dst, 1, src, edge_type FROM edges) GROUP BY x, y),
s AS (SELECT DISTINCT src AS start FROM edges WHERE edge_type = 'part_of'),
l1 AS (SELECT start, y AS id, start AS parent, e, row_number() OVER (PARTITION BY start ORDER BY e[1], y, e[2]) AS n FROM s JOIN a ON x = start WHERE y <> start),
m AS (SELECT l1.start, a.y AS id, min((l1.n, a.e[1], a.e[2], l1.id)) AS f FROM l1 JOIN a ON a.x = l1.id WHERE a.y <> l1.start AND NOT EXISTS (SELECT 1 FROM l1 k WHERE k.start = l1.start AND k.id = a.y) GROUP BY ALL),
l2 AS (SELECT start, id, f, row_number() OVER (PARTITION BY start ORDER BY f[1], f[2], id, f[3]) + (SELECT count(*) FROM l1 WHERE l1.start = m.start) AS n FROM m),
u AS (SELECT start, 0 AS n, start AS id, 0 AS distance, NULL AS parent, NULL AS source, NULL AS edge_type FROM s UNION ALL SELECT start, n, id, 1, parent, CASE WHEN e[1] = 0 THEN parent ELSE id END, e[2] FROM l1
 UNION ALL SELECT start, n, id, 2, f[4], CASE WHEN f[2] = 0 THEN f[4] ELSE id END, f[3] FROM l2)
SELECT * FROM u WHERE n < 40""",
    "recall": f"""WITH {EDGES_SQL}, {NODES_SQL}, seen AS (SELECT 'N3' AS id, 0 AS distance UNION ALL SELECT DISTINCT x, 1 FROM (SELECT dst AS x FROM edges WHERE src = 'N3' UNION SELECT src FROM edges WHERE dst = 'N3'))
SELECT seen.id, distance, title FROM seen LEFT JOIN nodes ON nodes.id = seen.id""",
    "tag_overlap_edges": """WITH t AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS tag FROM lineitem), w AS (SELECT tag, ln((SELECT count(DISTINCT id) FROM t) / count(*)) AS w FROM t GROUP BY tag)
SELECT a.id AS a, b.id AS b, count(*) AS n_tags, round(sum(w), 6) AS weight FROM t a JOIN t b ON a.tag = b.tag AND a.id < b.id JOIN w ON w.tag = a.tag GROUP BY a.id, b.id HAVING sum(w) >= 12.0""",
    "link_extract": f"WITH {_LINKS} SELECT page_id, position, target, CASE WHEN regexp_matches(target, '^(https?://|mailto:)') THEN 'external' ELSE 'path' END AS kind FROM links",
    "link_resolve": f"""WITH {_LINKS}, l AS (SELECT DISTINCT page_id AS src, target AS raw FROM links), u AS (SELECT url AS raw, min(page_id) AS dst FROM pages GROUP BY url),
p AS (SELECT '/' || string_split(url, '/')[-1] AS raw, min(page_id) AS dst FROM pages GROUP BY 1)
SELECT src, l.raw, coalesce(u.dst, p.dst) AS dst, coalesce(u.dst, p.dst) IS NOT NULL AS resolved FROM l LEFT JOIN u ON u.raw = l.raw LEFT JOIN p ON p.raw = l.raw""",
    "headings": "SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS title, generate_subscripts(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1), 1) - 1 AS position FROM pages",
    "slugs": r"SELECT page_id, replace(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^\p{L}\p{Nd}_ -]', '', 'g'), ' ', '-') AS slug FROM pages",
    "estimate_tokens": "SELECT doc_id AS id, ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM documents",
    "truncated": "SELECT doc_id AS id, CASE WHEN length(text) > 80 THEN substring(text, 1, 77) || '...' ELSE text END AS short FROM documents",
    "normalised_names": r"SELECT c_custkey, lower(translate(c_name, '-_', '  ')) AS name, trim(regexp_replace(lower(c_mktsegment), '\s+', ' ', 'g')) AS segment FROM customer",
    "title_lookup": "SELECT p_partkey, p_name FROM part WHERE lower(p_name) = 'red widget'",
    "mget_order": "SELECT position, i.id, source AS type, source IS NOT NULL AS found FROM (VALUES (0::BIGINT, 17::BIGINT), (1, 3), (2, -5), (3, 999999999), (4, 3)) i(position, id) LEFT JOIN documents ON doc_id = i.id ORDER BY position",
    "context_pack_pass1": f"WITH {_ITEMS} SELECT * FROM (SELECT key, position, tokens, sum(tokens) OVER (PARTITION BY key ORDER BY position)::BIGINT AS used FROM items) WHERE used <= 4000",
    "context_pack_pass2": f"""WITH RECURSIVE {_ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY position) AS r FROM items),
f AS (SELECT key, position, tokens, r, tokens <= 4000 AS taken, CASE WHEN tokens <= 4000 THEN tokens ELSE 0 END AS used FROM n WHERE r = 1
 UNION ALL SELECT n.key, n.position, n.tokens, n.r, f.used + n.tokens <= 4000, CASE WHEN f.used + n.tokens <= 4000 THEN f.used + n.tokens ELSE f.used END FROM f JOIN n ON n.key = f.key AND n.r = f.r + 1)
SELECT key, position, tokens, used::BIGINT AS used FROM f WHERE taken""",
    "edge_candidates": f"""WITH {EDGES_SQL}, k AS (SELECT src, dst, CASE WHEN edge_type = 'part_of' THEN 0 WHEN edge_type = 'lives_in' THEN 1 WHEN substring(src, 2)::BIGINT % 3 = 1 THEN 2 ELSE 3 END AS priority FROM edges WHERE edge_type <> 'based_in' OR substring(src, 2)::BIGINT % 3 <> 2)
SELECT src, dst, priority, n FROM (SELECT *, row_number() OVER (PARTITION BY dst, priority ORDER BY src) AS n FROM k) WHERE n <= 3""",
    "generated_ids": r"SELECT page_id, 'page-' || replace(lower(regexp_replace(string_split(url, '/')[-1], '\.md$', '')), ' ', '-') AS id FROM pages",
}
