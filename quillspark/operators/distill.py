"""What sessions and journals hold that is worth keeping: episodes read back from Markdown, turns that push, desk entries, and what each resembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, without_space_around
from . import frontmatter as FM
from . import retrieval as R

# Headings of an episode, the beginning of a summary that a machine wrote, the phrases of each rule, a desk entry's fields.
USER, ASSISTANT = "## User messages (verbatim)", "## Assistant responses (verbatim)"
SUMMARY = "This session is being continued from a previous conversation"
RULES = {
    "authority-grant": [
        "full autonomy", "you decide", "you have autonomy", "dont need to ask", "don't need to ask", "dont need to review", "don't need to review", "dont need my",
        "don't need my", "trust you", "as you see fit", "you are the one", "you should decide", "you should evaluate", "your call", "i dont mind", "i don't mind", "do as you",
    ],
    "manifesto-lens": ["manifesto lens", "remember the manifesto", "manifesto on"],
    "evidence-gate": [
        "if you're confident", "if you are confident", "if you're sure", "if you are sure", "if you feel confident", "as long as you're confident",
        "as long as you are confident", "as long as you're sure", "as long as you are sure", "only if you're sure", "only if you are sure",
    ],
}
PRINCIPLE = r"principle[\t\n\f\r ]+[0-9]"
JOURNAL, DISTILLED, DATES, HEAD, LEAST = "journal", "distilled_to", ("date", "created"), 1200, 6000

# what stands before the first line of dashes, between it and the second, and after that; all after the first if there is no second
_DASHED = r"(?sd)\A((?:.*?\n)??)---(?:\n((?:.*?\n)??)---(?:\n(.*))?|\n(.*)|)\z"
_TURN = r"###[\t\f\r ]+([0-9]+)[\t\f\r ]+[—-][\t\f\r ]+([^\t\f\r\n ]+)"


def signal(files: DataFrame, least: int = LEAST) -> DataFrame:
    """Files (path, size) that aren't known to be too small; parts of a session kept bit by bit are always taken, as are unknown sizes."""
    return files.filter(F.col("path").rlike(r"-part[0-9]{8}\.md\z") | F.col("size").isNull() | (F.col("size") >= least))


def turns(files: DataFrame) -> DataFrame:
    """(path, episode, section, place, turn, ts, text) of the turns of episodes (path, content): section user or assistant, place in it from 0.

    The episode is the last id of the frontmatter, else the file's name. Lines of three dashes belong to no text. A user's text
    loses its quote marks. A turn whose number doesn't fit 64 bits is left out. Null contents have no rows."""
    text = F.regexp_replace("content", r"\r(?=\n|\z)", "")
    part = lambda i: F.regexp_extract(text, _DASHED, i)
    front = F.concat(part(2), part(4))
    rest = F.when(text.rlike(_DASHED), F.concat(part(1), part(3))).otherwise(text)
    rest = F.regexp_replace(rest, r"(?md)^---(?:\n|\z)", "")
    named = F.regexp_extract_all(front, F.lit(r"(?md)^id:[\t\f\r ]*([^\t\f\r\n ]+)"), F.lit(1))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md\z", "")
    sections = F.split(rest, rf"(?md)^(?=(?:\Q{USER}\E|\Q{ASSISTANT}\E)$)")
    kind = lambda s: F.when(s.rlike(rf"\A\Q{USER}\E(?:\n|\z)"), "user").when(s.rlike(rf"\A\Q{ASSISTANT}\E(?:\n|\z)"), "assistant")
    parts = lambda s: F.filter(F.split(s, rf"(?md)^(?={_TURN})"), lambda t: t.rlike(rf"\A{_TURN}"))
    each = F.flatten(F.transform(F.filter(sections, lambda s: kind(s).isNotNull()), lambda s: F.transform(parts(s), lambda t: F.struct(kind(s).alias("section"), t.alias("t")))))
    rows = files.select("path", F.coalesce(F.try_element_at(named, F.lit(-1)), stem).alias("episode"), F.posexplode(each).alias("at", "x")).select("path", "episode", "at", "x.*")
    said = F.regexp_replace("t", r"\A[^\n]*\n?", "")
    said = without_space_around(F.when(F.col("section") == "user", F.regexp_replace(said, r"(?md)^>(?: |$)", "")).otherwise(said))
    out = rows.select("path", "episode", "section", "at", F.regexp_extract("t", _TURN, 1).try_cast("long").alias("turn"), F.regexp_extract("t", _TURN, 2).alias("ts"), said.alias("text"))
    return out.filter("turn is not null")


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """The first phrase of the list that the text holds, else null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases])


def pushes(said: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """said's rows with (rule, trigger) for each rule whose phrase its text holds, in any case; summaries that a machine wrote have none.

    The second rule also takes a numbered principle where no phrase of it is met. Null texts have no rows."""
    rules = RULES if rules is None else rules

    def found(low: Column) -> Column:
        triggers = {name: first_phrase(low, phrases) for name, phrases in rules.items()}
        if "manifesto-lens" in triggers:
            triggers["manifesto-lens"] = F.coalesce(triggers["manifesto-lens"], F.nullif(F.regexp_extract(low, PRINCIPLE, 0), F.lit("")))
        return F.filter(F.array(*[F.struct(F.lit(n).alias("rule"), t.alias("trigger")) for n, t in triggers.items()]), lambda x: x["trigger"].isNotNull())

    pushed = said.filter(~without_space_around(F.col("text")).startswith(SUMMARY)).withColumn("x", F.explode(let(F.lower("text"), found)))
    return pushed.select(*said.columns, "x.rule", "x.trigger")


def desk(files: DataFrame) -> DataFrame:
    """(path, id, title, date, snippet) of a folder's journal entries (path, content) that nothing was distilled from yet.

    Only Markdown outside hidden folders counts. The date is that of the first date field with a value, a day where it is an
    unquoted time. The snippet is the beginning of the body. Missing fields are empty. Order by date, falling, then by id."""
    shown = F.col("path").rlike(r"(?i)\.md\z") & ~F.col("path").rlike(r"(?:\A|/)\.[^/]+/")
    fm = files.filter(shown).select("path", "content", FM.entries(F.col("content")).alias("e")).filter("e is not null")

    def field(name: str) -> Column:
        entry = F.get(F.filter("e", lambda e: e["key"] == name), 0)["lines"]
        raw = F.trim(F.regexp_extract(F.coalesce(entry, F.lit("")), r"\A[^:]*:([^\n]*)\z", 1))
        bare = F.when(raw.rlike(r"""\A(["']).*\1\z"""), F.substring(raw, F.lit(2), F.length(raw) - 2)).when(raw.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{1,2}:"), F.left(raw, F.lit(10))).otherwise(raw)
        return F.when(raw.isin("null", "~"), "").otherwise(without_space_around(bare))

    body = without_space_around(F.regexp_replace("content", FM._FRONT, ""))
    date = F.coalesce(*[F.nullif(field(d), F.lit("")) for d in DATES], F.lit(""))
    pending = fm.filter((F.lower(field("type")) == JOURNAL) & (field(DISTILLED) == ""))
    return pending.select("path", field("id").alias("id"), field("title").alias("title"), date.alias("date"), F.left(body, F.lit(HEAD)).alias("snippet"))


def annotated(proposals: DataFrame, arcs: DataFrame, k: int = 3) -> DataFrame:
    """Proposals (id, v, ...) with nearest, a list of (arc_id, score) of the k nearest arcs (arc_id, arc_v), a bounded catalogue.

    A proposal without a vector, as one without text has none, and one of another length than the arcs' have an empty list."""
    near = R.nearest(proposals.select("id", "v").filter("v is not null"), arcs, k)
    listed = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "arc_id", "score"))).alias("found"))
    of_length = arcs.agg(F.max(F.size("arc_v")).alias("length"))  # one row
    rows = proposals.join(listed, "id", "left").crossJoin(F.broadcast(of_length))
    none = F.array().cast("array<struct<arc_id:bigint,score:double>>")
    nearest = F.transform("found", lambda x: F.struct(x["arc_id"].alias("arc_id"), x["score"].alias("score")))
    return rows.withColumn("nearest", F.when(F.col("found").isNotNull() & (F.size("v") == F.col("length")), nearest).otherwise(none)).drop("found", "length")
