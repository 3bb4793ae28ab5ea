"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def normalise(text: Column) -> Column:
    """Lower case, with hyphens and underscores as spaces."""
    return F.lower(F.translate(text, "-_", "  "))


def normalise_alias(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def slugify(title: Column) -> Column:
    """Letters and digits kept, spaces to hyphens, the rest dropped."""
    return F.replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{Nd}_ -]", ""), F.lit(" "), F.lit("-"))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def snippet(text: Column, n: int) -> Column:
    """The first n code points, cut at the last space if it is among the last 30, with dots; a shorter text whole."""
    head = F.substring(text, 1, n)
    at = F.length(head) - F.length(F.substring_index(head, " ", -1))  # the last space's place, 0 if none
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.when((at > 0) & (at > n - 30), F.left(head, F.greatest(at - 1, F.lit(0)))).otherwise(head), F.lit("...")))


def strip_blockquote(text: Column) -> Column:
    return F.regexp_replace(text, "(?m)^> ?", "")


# What plain text leaves out of a body, in this order. Fences of either mark open and close each other.
FENCES = r"^[^\S\n]*(?:```|~~~)[\s\S]*?(?:\n[^\S\n]*(?:```|~~~)[^\n]*(?:\n|\z)|\z)"
PLAIN = (
    (r"!\[\[[^\[\]]*\]\]", ""), (r"\[\[[^\[\]]+\|([^\[\]]+)\]\]", 1), (r"\[\[([^\[\]]*)\]\]", 1), (r"\[([^\[\]]+)\]\([^)]*\)", 1), (r"^#{1,6}[\t\n\f\r ]+", ""), (r"^(?:-{3,}|\*{3,}|_{3,})[\t\n\f\r ]*$", ""),
    (r"[\t\n\f\r ]*\^[a-zA-Z0-9][a-zA-Z0-9_-]*$", ""), (r"<[^>]+/?>", ""), (r"`([^`]*)`", 1), (r"\*\*|__|~~", ""), (r"\*([^*]+)\*", 1), (r"_([^_]+)_", 1), (r"^>[\t\n\f\r ]?", ""), (r"[\t\f\r ]+", " "), (r"\n{3,}", "\n\n"),
)


def strip_markdown(text: Column) -> Column:
    """Plain text of a body: no fenced code, embeds, links, headings, rules, block ids, tags, code marks, emphasis or quote marks."""
    text = F.regexp_replace(text, f"(?md){FENCES}", "")
    for pattern, by in PLAIN:
        text = F.regexp_replace(text, f"(?md){pattern}", "$1" if by == 1 else by)
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


# Headings of the sections of an arc, in any case.
SECTIONS = ("trigger", "push", "deeper sight", "principle", "what i did differently", "source")
SPACE = r"(?U)\A\s+|\s+\z"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_space_around(text: Column) -> Column:
    """The text without white space of any script at its ends."""
    return F.regexp_replace(text, SPACE, "")


def _heading(line: Column) -> Column:
    return F.lower(without_space_around(F.regexp_replace(without_space_around(line), "^#+", "")))


def _after(items: Column, at: Column) -> Column:
    """Items past the one at a place counted from 1."""
    return F.slice(items, at + 1, F.size(items))


def _without_frontmatter(lines: Column) -> Column:
    first = F.array_position(F.transform(lines, lambda x: without_space_around(x) != ""), True).cast("int")

    def rest(after: Column) -> Column:
        close = F.array_position(F.transform(after, lambda x: without_space_around(x) == "---"), True).cast("int")
        return F.when(close > 0, _after(after, close)).otherwise(lines)

    return let(first, lambda k: F.when(without_space_around(F.coalesce(F.get(lines, k - 1), F.lit(""))) == "---", let(_after(lines, k), rest)).otherwise(lines))


def _principle(lines: Column) -> Column:
    def section(rest: Column) -> Column:
        end = F.array_position(F.transform(rest, lambda x: _heading(x).isin(*SECTIONS)), True).cast("int")
        return without_space_around(F.array_join(F.transform(F.when(end > 0, F.slice(rest, 1, F.greatest(end - 1, F.lit(0)))).otherwise(rest), without_space_around), " "))

    at = F.array_position(F.transform(lines, lambda x: _heading(x) == "principle"), True).cast("int")
    return let(at, lambda k: F.when(k > 0, let(_after(lines, k), section)).otherwise(""))


def _lead(lines: Column) -> Column:
    flat = lambda block: F.array_join(F.filter(F.transform(F.split(block, "\n"), without_space_around), lambda x: x != ""), " ")
    citation = lambda x: ~x.rlike(r"[ \t]") & (F.contains(x, F.lit("://")) | (F.contains(x, F.lit("/")) & ~x.rlike(r"[^\x00-\x7F]")))
    prose = lambda x: ~citation(x) & (x.rlike("[.!?\u3002\uff01\uff1f]") | (F.octet_length(x) > 80))
    blocks = F.filter(F.transform(F.split(F.array_join(lines, "\n"), "\n\n"), flat), lambda x: (x != "") & ~x.startswith("#") & ~_heading(x).isin(*SECTIONS))
    return let(blocks, lambda all_: F.coalesce(F.get(F.filter(all_, prose), F.lit(0)), F.get(F.filter(all_, lambda x: ~citation(x)), F.lit(0)), F.get(all_, F.lit(0)), F.lit("")))


def key_passage(text: Column) -> Column:
    """The text under a Principle heading, else the first paragraph of prose, else of other content, else of a bare path or address."""
    parts = let(_without_frontmatter(F.split(F.coalesce(text, F.lit("")), "\n")), lambda lines: F.struct(_principle(lines).alias("rule"), _lead(lines).alias("lead")))
    return let(parts, lambda x: F.when(x["rule"] != "", x["rule"]).otherwise(x["lead"]))


def _cuts(passage: Column, cap: int) -> Column:
    """What an excerpt of at most `cap` tokens may be, the best first: the whole, then fewer and fewer whole sentences, then words with an ellipsis."""
    def prefixes(flat: Column, at: str) -> Column:
        room = cap * 4 + 2  # characters past this can't be in a prefix that fits
        parts = F.split(F.substring(flat, 1, room), at)
        known = F.when(F.char_length(flat) > room, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
        return F.reverse(let(known, lambda p: F.transform(p, lambda _, i: F.array_join(F.slice(p, 1, i + 1), " "))))

    sentences = prefixes(F.regexp_replace(passage, r"(?U)([.!?]) \s+", "$1 "), "(?<=[.!?]) ")
    words = F.transform(prefixes(F.regexp_replace(passage, r"(?U)\s+", " "), " "), lambda x: F.concat(x, F.lit("\u2026")))
    return F.when(passage == "", F.array().cast("array<string>")).otherwise(F.filter(F.concat(F.array(passage), sentences, words), lambda x: estimate_tokens(x) <= cap))


def excerpt(text: Column | str, max_tokens: Column | int, cap: int | None = None) -> Column:
    """The key passage of a text in at most max_tokens (a column of at most `cap`): whole, else whole sentences, else whole words; empty if none fits or the text is null."""
    most = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    passage = key_passage(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(F.get(F.filter(let(passage, lambda p: _cuts(p, max_tokens if cap is None else cap)), lambda x: estimate_tokens(x) <= most), F.lit(0)), F.lit(""))


def excerpt_sizes(text: Column | str, cap: int) -> Column:
    """Token counts of what an excerpt of a text may be, the best first."""
    return F.transform(let(key_passage(F.col(text) if isinstance(text, str) else text), lambda p: _cuts(p, cap)), estimate_tokens)


def cut_bytes(text: Column, n: Column | int) -> Column:
    """The first n bytes at most, never within a character."""
    most, raw = F.lit(n).cast("int") if isinstance(n, int) else n.cast("int"), F.encode(text, "UTF-8")
    return F.coalesce(*[F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(most - i, F.lit(0))).cast("string")) for i in range(4)])


def generate_id(path: Column, note_type: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    return F.concat_ws("-", note_type, F.replace(F.lower(stem), F.lit(" "), F.lit("-")))


def ago(seconds: Column) -> Column:
    """just now, or whole minutes, hours or days."""
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))


def parse_date(text: Column) -> Column:
    """A timestamp from any of five layouts, else null."""
    layouts = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(x)) for x in layouts])
