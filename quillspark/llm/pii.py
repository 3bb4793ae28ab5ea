"""Personal data: base patterns, and candidates that boosted trees judge.

Base spans (email, ip, card, phone) are found by fixed patterns and checks and always stay. High-recall
generators propose further, overlapping spans, from any group to any later one: obfuscated addresses,
phone numbers without a plus, card-like numbers and dotted ones with spaces. Boosted trees score each by its format
and the words around it; a threshold for each kind, calibrated on held-out examples to a wanted
precision, selects the ones that are added. The trees are fitted to examples made by rule from a
seed (all candidates of N_EXAMPLES texts), since no labels of personal data exist.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Boosted
from .flow import arrow, batch, documents

KINDS = ("email", "ip", "card", "phone")
N_EXAMPLES, PRECISION, NEAR = 4000, 0.995, 32
RESULT = "doc_id long,n_email long,n_ip long,n_card long,n_phone long,base_sha256 string,spans string"

# Fixed patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Every match of ip, card and phone lies inside a match of this; a match of email around an @.
NUMERIC = re.compile(r"\+?[0-9][\x20().0-9-]*")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # ips are each four parts of it in turn
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

AT, HOST, DOT = r"\(at\)|\[at\]|\{at\}|[ ]at[ ]", r"[ ]?[A-Za-z0-9-]+", r"[ ]?(?:\(dot\)|\[dot\]|\{dot\}|[ ]dot[ ]|\.)[ ]?[A-Za-z0-9-]+"
#: What each obfuscated address holds; texts are told apart by it.
WORDY = rf"[A-Za-z0-9._%+-][ ]?(?:{AT}){HOST}{DOT}"
ATS, HOSTS, DOTS = re.compile(f"(?=({AT}))"), re.compile(HOST), re.compile(DOT)
NUMBER_BEFORE, NUMBER_AFTER = re.compile(r"[0-9][ ().\-/]{0,2}$"), re.compile(r"[ ().\-/]{0,2}[0-9]")
GROUP, LABELS = re.compile("[0-9]+"), 127  # the parts a domain name can have
GAP = frozenset(("", *" ().-/", *(a + b for a in " ().-/" for b in " ().-/")))
HINTS = {"email": ("mail", "contact", "write", "address"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "credit", "pay", "account", "iban"), "phone": ("phone", "call", "tel", "mobile", "cell", "fax", "whatsapp", "number")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def dotted(text: str, s: int, e: int):
    """(start, end) of ips: [0-9]+ and three times a dot and [0-9]+, leftmost; in linear time on runs of any length."""
    for m in DOTTED.finditer(text, s, e):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end): leftmost, without overlap within a kind; failing matches are dropped."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for chunk in NUMERIC.finditer(text):
        s, e = chunk.span()
        if e - s < 6:  # shorter than any span of these kinds
            continue
        out += [(i, 1, j) for i, j in dotted(text, s, e)]
        for kind, pattern in ((2, CARD), (3, PHONE)):
            for m in pattern.finditer(text, s, e):
                digits = re.sub("[^0-9]", "", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15:
                    out.append((m.start(), kind, m.end()))
    return sorted(out)


def addresses(text: str):
    """(start, kind, end) of obfuscated addresses: around every at, to the end of each part after a dot."""
    for m in ATS.finditer(text):
        at = m.start(1)
        start = end = at - (at > 1 and text[at - 1] == " ")
        while start and text[start - 1] in LOCAL:
            start -= 1
        if start < end and (h := HOSTS.match(text, m.end(1))):
            for _ in range(LABELS):
                if not (h := DOTS.match(text, h.end())):
                    break
                yield start, 0, h.end()


def numbers(text: str):
    """(start, kind, end) of numbers: from any group of digits to any later one, where two separators at most stand between neighbours."""
    groups = [m.span() for m in GROUP.finditer(text)]
    for i, (s, _) in enumerate(groups):
        start, n = s - (s > 0 and text[s - 1] == "("), 0
        for j in range(i, len(groups)):
            if j > i and text[groups[j - 1][1] : groups[j][0]] not in GAP:
                break
            n += groups[j][1] - groups[j][0]
            if n > 19:
                break
            e = groups[j][1]
            if j - i == 3 and 4 <= n <= 12 and text.count(".", start, e) == 3:
                yield start, 1, e
            if 12 <= n:
                yield start, 2, e
            if 7 <= n <= 15:
                yield start, 3, e


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) that the generators propose; spans overlap and most are nothing."""
    return [*addresses(text), *numbers(text)]


def features(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Format and context of each span, as numbers."""
    rows = []
    for s, kind, e in spans:
        span, before, after = text[s:e], text[max(0, s - NEAR) : s].lower(), text[e : e + NEAR].lower()
        digits = [c for c in span if c.isascii() and c.isdigit()]
        groups = [len(g) for g in re.findall("[0-9]+", span)]
        left, right = text[s - 1] if s else " ", text[e] if e < len(text) else " "
        rows.append([
            *(kind == k for k in range(4)), e - s, len(digits), len(groups), max(groups, default=0), min(groups, default=0), len(set(groups)),
            *(span.count(c) for c in " .-(/"), luhn("".join(digits)) if digits else 0, len(digits) / (e - s), len(set(digits)),
            left.isalnum(), left in "$€£#=:_-/.", right.isalnum(), right in "%€$£°/_=", span.count("dot"), span.count("@") + span.count("at"), span.startswith(("0", "(")),
            any(h in before for h in HINTS[KINDS[kind]]), any(h in after for h in HINTS[KINDS[kind]]), any(c in before for c in "{}<>="), bool(re.search(r"(19|20)[0-9]{2}", span)), "(at)" in span or "[at]" in span or "{at}" in span,
            groups[0] if groups else 0, groups[-1] if groups else 0, len(gaps := set(re.findall("[^0-9]+", span.lstrip("(")))), " " in gaps, any(len(g) > 1 for g in gaps), bool(NUMBER_BEFORE.search(text, max(0, s - 3), s)), bool(NUMBER_AFTER.match(text, e)), kind == 1 and all(int(g) <= 255 for g in re.findall("[0-9]+", span)), span.count(")") == span.count("("), bool(DOTS.match(text, e)), len(re.findall("[a-z]+$", span)[0]) if kind == 0 and span[-1].islower() else 0,
        ])
    return np.array(rows, float).reshape(len(rows), 41)


def examples(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, kinds, labels and text numbers of the candidates in n texts made from templates."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "tion", "que", "sch", "lo", "mi", "ta", "en", "or")) for _ in range(r.randint(1, 4)))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    prose = lambda k: " ".join(word() for _ in range(k))
    hint = lambda kind: r.choice(HINTS[kind])

    def good():
        kind = r.choice(("email", "phone", "phone", "card", "ip"))
        if kind == "email":
            a, o = r.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", "."), ("{at}", "{dot}"), (" at ", " (dot) "), (" at ", "[dot]"), (" at ", ".")))
            x = f"{word()}{r.choice(('', d(2), '.' + word()))}{a}{word()}{o}{r.choice(('com', 'org', 'net', 'de'))}"
        elif kind == "card":
            x = r.choice((" ", "-")).join((d(4), d(4), d(4), d(4)))
        elif kind == "ip":
            x = r.choice((". ", " .")).join(str(r.randrange(256)) for _ in range(4))
        else:
            x = r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)}/{d(7)}", f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}"))
        return kind, x, f"{r.choice((hint(kind), hint(kind) + ':', prose(1) + ' ' + hint(kind) + ' is'))} "

    def bad():
        x = r.choice((
            f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1900, 2030)}/{r.randint(10, 12)}/{r.randint(10, 28)} {d(2)}", d(r.randint(7, 19)), f"{d(1)}.{d(8)}", f"{d(3)}.{d(3)}.{d(3)}.{d(3)}",
            f"{d(2)} {d(3)} {d(2)} {d(3)}", f"{word()} at {word()} dot {word()}", f"{hint('email')} {word()} at {word()}. {word().title()}", f"{d(3)}-{d(10)}", f"{d(2)}.{d(2)}.{d(2)}.{d(4)}", f"{d(3)} {d(3)} {d(3)} {d(3)}", f"({d(4)}) {d(4)}", ". ".join(str(r.randint(1, 999)) for _ in range(4)), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}",
        ))
        return None, x, f"{r.choice((prose(3), 'isbn', 'order', 'page', 'version', 'id=', '{', 'total $', 'figure'))}{r.choice((' ', ' ', '=', '.'))}"

    rows, kinds, labels, texts = [], [], [], []
    for i in range(n):
        kind, span, before = good() if r.random() < 0.4 else bad()
        text = f"{prose(4)} {before}"
        true = {(len(text), KINDS.index(kind), len(text) + len(span))} if kind else set()
        text += span
        if kind in ("phone", "card") and r.random() < 0.3:  # a second of its form, or another number, follows
            text += r.choice((" ", " ", " / ", "  "))
            more = "".join(r.choice("0123456789") if c.isdigit() and (k or c != "0") else c for k, c in enumerate(span)) if r.random() < 0.6 else r.choice((d(2), d(3), str(r.randint(1900, 2030))))
            if len(more) == len(span):
                true.add((len(text), KINDS.index(kind), len(text) + len(more)))
            text += more
        text += f"{r.choice((' ', '. ', ', ', '%', 'x'))}{prose(3)}"
        for c, f in zip(found := candidates(text), features(text, found), strict=True):
            rows.append(f)
            kinds.append(c[1])
            labels.append(c in true)
            texts.append(i)
    return np.array(rows), np.array(kinds), np.array(labels, float), np.array(texts)


class Detector:
    """Trees for each kind, and a threshold: the least score from which on PRECISION of held-out candidates were right."""

    def __init__(self, n: int = N_EXAMPLES, precision: float = PRECISION):
        x, kinds, y, of = examples(n)
        held = of % 3 == 0
        self.trees, self.threshold = [Boosted().fit(x[~held & (kinds == k)], y[~held & (kinds == k)]) for k in range(4)], {}
        for k in range(4):
            rows = held & (kinds == k)
            p, t = self.trees[k].predict(x[rows]), y[rows]
            order = np.argsort(-p, kind="stable")
            right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero((right >= precision) & (np.arange(len(order)) >= 20))
            self.threshold[k] = max(float(p[order][good[-1]]), 0.9) if len(good) else 2.0

    def scores(self, text: str, found: list[tuple[int, int, int]]) -> np.ndarray:
        x, kinds, p = features(text, found), np.array([k for _, k, _ in found]), np.zeros(len(found))
        for k in np.unique(kinds):
            p[kinds == k] = self.trees[k].predict(x[kinds == k])
        return p

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Accepted candidates, best first, that overlap neither a base span nor a better one."""
        found = candidates(text)
        if not found:
            return []
        p, taken, out = self.scores(text, found), bytearray(len(text)), []
        for s, _, e in base:
            taken[s:e] = b"\1" * (e - s)
        for i in sorted((i for i in range(len(found)) if p[i] >= self.threshold[found[i][1]]), key=lambda i: (-p[i], found[i])):
            s, _, e = found[i]
            if taken.find(1, s, e) < 0:
                taken[s:e] = b"\1" * (e - s)
                out.append(found[i])
        return out


@lru_cache(1)
def detector(n: int, precision: float) -> Detector:
    return Detector(n, precision)


def _hit_rows(column: pa.Array) -> np.ndarray:
    """Texts with a digit, an @ or what WORDY finds: all others hold no span of any kind."""
    import pyarrow.compute as pc

    from .arrays import texts

    data, offsets = texts(column)
    mark = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data == 64) | ((data >= 48) & (data <= 57)), out=mark[1:])
    hit = np.diff(mark[offsets]) > 0
    return hit | pc.fill_null(pc.match_substring_regex(column, WORDY), False).to_numpy(zero_copy_only=False)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, n_examples: int = N_EXAMPLES, precision: float = PRECISION) -> DataFrame:
    """doc_id, counts of base spans, the digest of the base spans, and all spans of every document.

    Null and empty texts hold none. Repeated rows give a row each. Offsets are code points.
    """
    model, schema = docs.sparkSession.sparkContext.broadcast(detector(n_examples, precision)), arrow(RESULT)
    none = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")

    def run(batches):
        for b in batches:
            rows = [none] * b.num_rows
            for i in np.flatnonzero(_hit_rows(b["text"])):
                text = b["text"][int(i)].as_py()
                base = base_spans(text)
                more = model.value.added(text, base)
                if base or more:
                    rows[i] = (*(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more))
            yield batch(schema, doc_id=b["doc_id"], **dict(zip(schema.names[1:], map(list, zip(*rows, strict=True)), strict=True))) if rows else batch(schema, **{n: [] for n in schema.names})

    return documents(docs).mapInArrow(run, RESULT)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, n_examples: int = N_EXAMPLES, precision: float = PRECISION) -> DataFrame:
    """The documents with all spans masked; n_chars follows the new text where that column exists.

    Null texts stay null, empty ones empty. Repeated rows give a row each. Other columns stay as they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(detector(n_examples, precision))

    def run(batches):
        for b in batches:
            text, changed = b["text"].to_pylist(), False
            length = b["n_chars"].to_pylist() if "n_chars" in b.schema.names else None
            for i in np.flatnonzero(_hit_rows(b["text"])):
                base = base_spans(text[i])
                if spans := base + model.value.added(text[i], base):
                    text[i], changed = masked(text[i], spans), True
                    if length:
                        length[i] = len(text[i])
            if changed:
                b = b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(text, b.schema.field("text").type))
                if length:
                    b = b.set_column(b.schema.get_field_index("n_chars"), b.schema.field("n_chars"), pa.array(length, b.schema.field("n_chars").type))
            yield b

    return docs.mapInArrow(run, docs.schema)
