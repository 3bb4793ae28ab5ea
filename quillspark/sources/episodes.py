"""Episodes from lines of transcripts: who said what, which tools were called, what was committed and touched.

Lines (path, start, offset, value) with one JSON record each; those that don't parse are noise. An episode is what one
path holds from one start on, in the order of offsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_bytes, let, without_space_around

RECORD = "type string, sessionId string, agentId string, isSidechain boolean, timestamp string, cwd string, gitBranch string, message string, prNumber int, prUrl string, prRepository string"
BLOCKS = "content array<struct<type:string,text:string,name:string,input:string>>"
# What isn't a user's own message, the tools that touch files, lines looked at for a side chain.
NOT_SAID, FILE_TOOLS, LOOKED_AT = ("<system-reminder>", "<task-notification>"), ("Edit", "Write", "Read"), 64


def _short(text: Column, n: int = 120) -> Column:
    return F.when(F.octet_length(text) > n, F.concat(cut_bytes(text, n), F.lit("…"))).otherwise(text)


def _after(text: Column, mark: str) -> Column:
    """What follows a mark's first occurrence, null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + F.lit(len(mark)), F.length(text)))


def commit_subject(command: Column) -> Column:
    """The first line of a here-document's message, else of a quoted one, else the command, of at most 120 bytes."""
    trim = without_space_around
    here = F.get(F.filter(F.transform(F.split(_after(command, "<<'EOF'"), "\n"), trim), lambda x: (x != "") & (x != "EOF")), F.lit(0))

    def quoted(q: str) -> Column:
        rest = _after(command, f"-m {q}")
        return F.when(F.instr(rest, q) > 1, trim(F.substring_index(F.substring_index(rest, q, 1), "\n", 1)))

    return _short(F.coalesce(here, quoted('"'), quoted("'"), command))


def _filled(x: Column) -> Column:
    return F.when(x != "", x)


def _records(lines: DataFrame) -> DataFrame:
    r = lines.select("path", "start", "offset", F.from_json("value", RECORD).alias("r")).select("path", "start", "offset", "r.*")
    said_kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("message"), "$.content", "variant"))
    return r.withColumn("said", F.when((F.col("type") == "user") & (said_kind == "STRING"), F.get_json_object("message", "$.content"))).withColumn(
        "blocks", F.when(F.col("type") == "assistant", F.from_json("message", BLOCKS)["content"])
    )


def episodes(lines: DataFrame) -> DataFrame:
    """One row for each path and start: id, segment_id, session_id, times, messages, tool_counts, commits, files_touched, prs, sidechain."""
    r = _records(lines)
    at, ts = F.col("offset"), F.coalesce("timestamp", F.lit(""))
    first = lambda x: F.min_by(x, F.when(x.isNotNull(), at))
    own = without_space_around(F.col("said"))
    is_said = (own != "") & ~reduce(Column.__or__, [own.startswith(x) for x in NOT_SAID])
    blocks = F.coalesce("blocks", F.array().cast("array<struct<type:string,text:string,name:string,input:string>>"))
    numbered = F.filter(F.transform(blocks, lambda b, i: F.struct(i.alias("i"), b.alias("b"))), lambda x: x["b"].isNotNull())
    calls = F.filter(numbered, lambda x: x["b"]["type"] == "tool_use")
    texts = F.filter(numbered, lambda x: (x["b"]["type"] == "text") & (without_space_around(x["b"]["text"]) != ""))
    value = lambda b, key: F.get_json_object(b["input"], f"$.{key}")
    commands = F.filter(calls, lambda x: (x["b"]["name"] == "Bash") & F.contains(value(x["b"], "command"), F.lit("git commit")))
    commits = F.transform(commands, lambda x: let(without_space_around(value(x["b"], "command")), lambda c: F.struct(at.alias("offset"), x["i"].alias("i"), commit_subject(c).alias("text"))))
    files = F.filter(F.transform(F.filter(calls, lambda x: x["b"]["name"].isin(*FILE_TOOLS)), lambda x: value(x["b"], "file_path")), lambda f: f != "")
    pr = F.when((F.col("type") == "pr-link") & (F.col("prNumber") != 0), F.struct("offset", F.col("prNumber").alias("number"), F.col("prUrl").alias("url"), F.col("prRepository").alias("repository")))
    rank = F.row_number().over(Window.partitionBy("path", "start").orderBy("offset"))
    odd = (F.coalesce("agentId", F.lit("")) != "") | F.coalesce("isSidechain", F.lit(False))
    gathered = r.withColumn("aside", odd & (rank <= LOOKED_AT)).groupBy("path", "start").agg(
        first(_filled(F.col("sessionId"))).alias("session_id"),
        first(_filled(F.col("timestamp"))).alias("started_at"),
        F.max_by("timestamp", F.when(F.col("timestamp") != "", at)).alias("ended_at"),
        first(F.when(F.col("type") == "user", _filled(F.col("cwd")))).alias("cwd"),
        first(F.when(F.col("type") == "user", _filled(F.col("gitBranch")))).alias("git_branch"),
        F.array_sort(F.collect_list(F.when(is_said, F.struct("offset", ts.alias("ts"), F.col("said").alias("text"))))).alias("user"),
        F.array_sort(F.flatten(F.collect_list(F.transform(texts, lambda x: F.struct(at.alias("offset"), x["i"].alias("i"), ts.alias("ts"), x["b"]["text"].alias("text")))))).alias("assistant"),
        F.flatten(F.collect_list(F.transform(calls, lambda x: F.coalesce(x["b"]["name"], F.lit(""))))).alias("names"),
        F.array_sort(F.flatten(F.collect_list(commits))).alias("made"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(files)))).alias("files_touched"),
        F.array_sort(F.collect_list(pr)).alias("linked"),
        F.bool_or("aside").alias("sidechain"),
    )
    said = lambda c: F.transform(c, lambda x: F.struct(x["ts"].alias("ts"), x["text"].alias("text")))
    number = F.transform("linked", lambda x: x["number"])
    prs = F.transform(F.filter("linked", lambda x, i: F.array_position(number, x["number"]) == i + 1), lambda x: F.struct(x["number"].alias("number"), x["url"].alias("url"), x["repository"].alias("repository")))
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("names")), lambda n: F.struct(n.alias("key"), F.size(F.filter("names", lambda m: m == n)).alias("value"))))
    date = F.when(F.length("started_at") >= 10, F.left("started_at", F.lit(10))).otherwise("unknown-date")
    name = F.concat(F.lit("episode-"), date, F.lit("-"), F.left(F.coalesce("session_id", F.lit("")), F.lit(8)))
    return gathered.select(
        name.alias("id"),
        F.concat(name, F.lit("-part"), F.format_string("%08d", "start")).alias("segment_id"),
        *("path", "start", "session_id", "started_at", "ended_at", "cwd", "git_branch"),
        said("user").alias("user_messages"),
        said("assistant").alias("assistant_messages"),
        counts.alias("tool_counts"),
        F.transform("made", lambda x: x["text"]).alias("commits"),
        "files_touched",
        prs.alias("prs"),
        F.coalesce("sidechain", F.lit(False)).alias("sidechain"),
    )


def capturable(found: DataFrame) -> DataFrame:
    """Episodes that hold anything: messages, calls, commits, files or pull requests."""
    some = [F.size(c) > 0 for c in ("user_messages", "assistant_messages", "tool_counts", "commits", "files_touched", "prs")]
    return found.filter(reduce(Column.__or__, some))


def captured(found: DataFrame) -> DataFrame:
    """(path, id, outcome, first_path) of a folder's episodes: sidechain, skipped without a session, captured, or a collision.

    Of episodes that derive one id the first path's is captured."""
    kind = F.when(F.col("sidechain"), "sidechain").when(F.col("session_id").isNull(), "skipped")
    told = found.select("path", "id", kind.alias("kind"))
    first = F.min(F.when(F.col("kind").isNull(), F.col("path"))).over(Window.partitionBy("id"))
    told = told.withColumn("first", first)
    outcome = F.coalesce("kind", F.when(F.col("path") == F.col("first"), "captured").otherwise("collision"))
    return told.select("path", "id", outcome.alias("outcome"), F.when(outcome == "collision", F.col("first")).alias("first_path"))


def tool_text(counts: Column) -> Column:
    """name=n of each tool, the most frequent first, then by name; none for none."""
    entries = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    return F.when(F.size(counts) == 0, "none").otherwise(F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit("="), (-e["n"]).cast("string"))), ", "))


def render(found: DataFrame, id_column: str = "id", today: str | None = None) -> Column:
    """The episodes as Markdown with frontmatter. today: the date of those without a valid start; the current one if None."""
    line = lambda key, x: F.concat(F.lit(f"{key}: "), F.coalesce(x, F.lit("")), F.lit("\n"))
    maybe = lambda key, x: F.when(F.coalesce(x, F.lit("")) != "", line(key, x)).otherwise("")
    fallback = F.lit(today) if today else F.current_date().cast("string")
    head = F.left("started_at", F.lit(10))
    created = F.when(head.rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_timestamp(head, F.lit("yyyy-MM-dd")).isNotNull(), head).otherwise(fallback)
    listed = lambda title, items, form: F.concat(F.lit(f"## {title}\n\n"), F.when(F.size(items) == 0, F.lit("_(none)_\n\n")).otherwise(F.concat(F.array_join(F.transform(items, form), ""), F.lit("\n"))))
    quote = lambda x: F.concat(F.lit("> "), F.replace(x, F.lit("\n"), F.lit("\n> ")), F.lit("\n"))
    said = lambda title, items, form: F.concat(F.lit(f"## {title}\n\n"), F.when(F.size(items) == 0, F.lit("_(none)_\n\n")).otherwise(F.array_join(F.transform(items, lambda m, i: F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(" — "), m["ts"], F.lit("\n\n"), form(m["text"]), F.lit("\n"))), "")))
    count = lambda title, x: F.concat(F.lit(f"- {title}: "), x.cast("string"), F.lit("\n"))
    c = found.__getitem__
    return F.concat(
        F.lit("---\n"),
        line("id", c(id_column)),
        F.lit("type: episode\n"),
        *[line(k, c(k)) for k in ("session_id", "started_at", "ended_at")],
        *[maybe(k, c(k)) for k in ("cwd", "git_branch")],
        F.lit("tags:\n  - episode\n"),
        line("created", created),
        F.lit("---\n\n# Episode — "),
        c(id_column),
        F.lit("\n\n## Metadata\n\n"),
        count("User messages", F.size("user_messages")),
        count("Assistant text blocks", F.size("assistant_messages")),
        count("Tool calls", tool_text(c("tool_counts"))),
        count("Files touched", F.size("files_touched")),
        F.lit("\n"),
        listed("Commits made", c("commits"), lambda x: F.concat(F.lit("- `"), x, F.lit("`\n"))),
        listed("PRs opened", c("prs"), lambda x: F.concat(F.lit("- #"), x["number"].cast("string"), F.lit(" — "), F.coalesce(x["url"], F.lit("")), F.lit("\n"))),
        listed("Files touched", c("files_touched"), lambda x: F.concat(F.lit("- `"), x, F.lit("`\n"))),
        said("User messages (verbatim)", c("user_messages"), quote),
        said("Assistant responses (verbatim)", c("assistant_messages"), lambda x: F.concat(x, F.lit("\n"))),
    )
