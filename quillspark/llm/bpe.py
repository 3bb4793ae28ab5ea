"""Encoding and decoding by byte-pair merges, with one dynamic program over the prefixes of each word.

The last token of the merges' result is unique for each prefix of a word. An automaton with suffix links over the
vocabulary's tokens lists those that end at a prefix, longest first; the first one that is compatible with the last
token of what stands before it is the prefix's last token. Following these back from the end of the word gives its ids.

Two tokens are compatible if the merges of their joint text give the two again: the later made of both is taken apart,
again and again, and no merge over the border may come earlier than what was taken apart.

Defined results: a null text is an empty one and has no ids; repeated rows are encoded each; texts and words may have any
length, time grows in proportion; strings of the vocabulary's special tokens within a text become their ids. Columns
other than doc_id and text aren't read.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flow

VOCABULARY = "word_bpe_49k.json"
#: Fixed values of the vocabulary file's format: the endings that are words of their own, and the mark of a word's end.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
END = "</w>"
#: Characters whose normal form, lower case and class are the same in every version of Unicode in use.
STABLE = [*range(0x300), *range(0x2010, 0x203B)]
PLAIN = [c for c in STABLE if all(ord(x) in STABLE for x in chr(c).lower())]
SPACES = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x2028, 0x2029, 0x202F}
#: Words kept with their ids by a task, their longest length, and characters in a batch of results.
KEPT, LONGEST, BATCH = 400_000, 48, 4 << 20
OUT = "doc_id long, n_tokens long, ids binary, decoded string"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in files of byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Merges:
    """Tokens as sequences of symbols: a byte, or 256 and a byte for the last one of a word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values()) + 1
        self.left, self.right, self.rank, self.pairs = [-1] * size, [-1] * size, [-1] * size, {}
        symbols: dict[int, tuple[int, ...]] = {}
        for b, c in enumerate(byte_characters()):
            symbols |= {vocab[x]: (b + more,) for x, more in ((c, 0), (c + END, 256)) if x in vocab}
        for k, (a, b) in enumerate(merges):
            a, b, t = vocab[a], vocab[b], vocab[a + b]
            self.pairs[a, b] = k
            self.left[t], self.right[t], self.rank[t] = a, b, k
            symbols[t] = symbols[a] + symbols[b]
        self.length = [len(symbols.get(t, ())) for t in range(size)]
        whole = {t: x for t, x in symbols.items() if self.rank[t] < 0 or self.compatible(self.left[t], self.right[t], self.rank[t])}
        self._automaton(whole)
        self.known: dict[tuple[int, int], bool] = {}

    def _automaton(self, tokens: dict[int, tuple[int, ...]]) -> None:
        """step: edges of each state; link: its longest proper suffix; ends: its tokens, longest first."""
        self.step, self.ends = [{}], [()]
        for t, x in tokens.items():
            at = 0
            for s in x:
                if (to := self.step[at].get(s)) is None:
                    to = self.step[at][s] = len(self.step)
                    self.step.append({})
                    self.ends.append(())
                at = to
            self.ends[at] = (t,)
        self.link = [0] * len(self.step)
        level = list(self.step[0].values())
        while level:
            after = []
            for at in level:
                self.ends[at] += self.ends[self.link[at]]
                for s, to in self.step[at].items():
                    self.link[to] = self._next(self.link[at], s)
                    after.append(to)
            level = after

    def _next(self, at: int, s: int) -> int:
        while (to := self.step[at].get(s)) is None:
            if not at:
                return 0
            at = self.link[at]
        return to

    def compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Do the merges before limit keep the border between a and b? Of merges of one rank the left one comes first."""
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.right[a]
            elif self.rank[b] >= 0:
                limit, b = self.rank[b] + 1, self.left[b]
            else:
                return True

    def word(self, text: bytes) -> list[int]:
        """Ids of one word."""
        last, n, at = [-1], len(text), 0
        for i, s in enumerate(text, 1):
            at = self._next(at, s if i < n else s + 256)
            for t in self.ends[at]:
                before = last[i - self.length[t]]
                if before < 0 or self._fits(before, t):
                    last.append(t)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {s}")
        ids = []
        while n:
            ids.append(last[n])
            n -= self.length[last[n]]
        return ids[::-1]

    def _fits(self, a: int, b: int) -> bool:
        if (fits := self.known.get((a, b))) is None:
            if len(self.known) > 4 * KEPT:
                self.known.clear()
            fits = self.known[a, b] = self.compatible(a, b)
        return fits


class Words(dict):
    """Ids of words as bytes, computed when first asked for; long words aren't kept."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.merges.word(word.encode()), "<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts as the vocabulary file says."""

    def __init__(self, path: str):
        from tokenizers import normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        vocab = made["model"]["vocab"]
        self.words = Words(Merges(vocab, [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in made["model"]["merges"]]))
        self.special = {x["content"]: int(x["id"]) for x in made["added_tokens"]}
        self.strings = {i: t for t, i in (vocab | self.special).items()}
        self.cuts = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        letters, numbers = (self._class(lambda c, k=k: unicodedata.category(chr(c))[0] == k) for k in "LN")
        apart = self._class(SPACES.__contains__)
        self.find = re.compile(f"{'|'.join(ENDINGS)}|[{letters}]+|[{numbers}]|[^{apart}{letters}{numbers}]+").findall
        self.odd = re.compile(f"[^{self._class(PLAIN.__contains__)}]").search
        # of rare characters the form, case and class are asked of the library that the file is for
        pattern = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        from tokenizers import Regex

        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)

    @staticmethod
    def _class(holds) -> str:
        return "".join(re.escape(chr(c)) for c in PLAIN if holds(c))

    def _plain(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if self.odd(text) is None:
            return self.find(text.lower())
        return [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))] if text else []

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        for m in self.cuts.finditer(text):
            out += [*map(self.words.__getitem__, self._plain(text[at : m.start()])), np.uint32(self.special[m.group()]).tobytes()]
            at = m.end()
        return b"".join([*out, *map(self.words.__getitem__, self._plain(text[at:] if at else text))])

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, with a space between each two: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def codec(path: str) -> Codec:
    """One for each worker process."""
    return Codec(path)


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return path


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded: the text that the ids give.

    path: the vocabulary file's place, the same on all machines."""
    path, schema = _path(path), flow.arrow(OUT)

    def run(batches):
        made = codec(path)
        for b in batches:
            rows, size = [], 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = made.encode(text.as_py() or "")
                rows.append((doc, len(ids) // 4, ids, made.decode(ids)))
                size += len(rows[-1][-1])
                if size > BATCH:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, schema)

    return flow.documents(docs).mapInArrow(run, OUT)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids as encode() gives them; null ids give a null text."""
    path, schema = _path(path), flow.arrow("doc_id long, text string")

    def run(batches):
        made = codec(path)
        for b in batches:
            for k in range(0, len(b), 64):
                part = b.slice(k, 64)
                texts = [x and made.decode(x) if x is not None else None for x in part.column("ids").to_pylist()]
                yield flow.batch(schema, doc_id=part.column("doc_id"), text=[None if x is None else x or "" for x in texts])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return encode(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
