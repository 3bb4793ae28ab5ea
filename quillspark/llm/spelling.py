"""Spelling variants: words that differ by one code point, grouped under the far more frequent form.

Every word of the vocabulary gives its full neighbourhood: all distinct deletions, replacements and insertions over the
alphabet that the vocabulary shows. A candidate that is a word joins it by a hash join on the string itself, so no
distance is verified. Nearly all candidates are no words; a bit set of fixed size over the vocabulary's hashes leaves
most of these out before the shuffle. It never leaves out a word. Once the vocabulary outgrows it, more candidates travel
to the join, with the same result, and their number grows with the vocabulary only, much slower than the texts.

Defined results: a null text has no words, a null id counts as an empty one; repeated rows count each; words may be of
any length (a word's candidates are hashed from sums over its prefixes, in time and memory in proportion to its length);
of near words equally frequent the smallest in code-point order is the form; tables without words give no rows.
Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flow
from .arrays import LOWER, mix

SHORTEST, LEAST, RATIO, FOLD = 6, 5, 5, 199
#: Bits of the set of words (16 MB), the code points of a step over the candidates, and words counted before a flush.
BITS, STEP, FLUSH = 1 << 27, 1 << 15, 300_000
U64 = np.uint64
_B = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_B), -1, 1 << 64))
_LOWER = LOWER.tobytes()


def counted(texts, shortest: int = SHORTEST, flush: int = FLUSH):
    """Dicts of words and their numbers over (doc_id, text), each of about so many words at most."""
    runs, found = re.compile("[a-zÀ-ÿ]{%d,}" % shortest).findall, Counter()
    for doc, text in texts:
        start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
        for run, n in Counter(runs(text.encode().translate(_LOWER).decode())).items():
            h = zlib.crc32(run.encode(), start)
            if h % FOLD == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < shortest:
                    continue
            found[run] += n
        if len(found) > flush:
            yield found
            found = Counter()
    yield found


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of all words long and frequent enough; each task sums up before the shuffle."""
    schema = flow.arrow("word string,n long")

    def run(batches):
        texts = ((d.as_py(), t.as_py() or "") for b in batches for d, t in zip(b.column("doc_id"), b.column("text"), strict=True))
        for found in counted(texts, shortest):
            words = list(found)
            for k in range(0, len(words), 20_000):
                some = words[k : k + 20_000]
                yield flow.batch(schema, word=some, n=[found[w] for w in some])

    counts = flow.documents(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words on end, and where each begins."""
    data = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(U64)
    return data, np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)


def _powers(n: int) -> np.ndarray:
    up = np.full(n + 1, _B, U64)
    up[0] = 1
    return np.multiply.accumulate(up)


def hashes(words: list[str]) -> np.ndarray:
    """A number for each word, of which those of its neighbours follow by sums over prefixes."""
    data, first = _points(words)
    size = np.diff(first)
    sums = np.r_[U64(0), np.cumsum((data + U64(1)) * _powers(int(size.max(initial=0)))[np.arange(len(data)) - np.repeat(first[:-1], size)])]
    return sums[first[1:]] - sums[first[:-1]]


def bits(h: np.ndarray, length: np.ndarray | int, n: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bit set for the hash and length of a word."""
    x = mix(h + np.asarray(length).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    return (x % U64(n)).astype(np.int64), ((x >> U64(32)) % U64(n)).astype(np.int64)


class Neighbours:
    """The neighbours of words that may be words themselves. held: the bit set, or None to keep all."""

    def __init__(self, alphabet: str, held: np.ndarray | None, n: int = BITS):
        self.alphabet, self.held, self.n = alphabet, held, n
        self.letters = np.array([ord(c) for c in alphabet], U64)

    def _kept(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        if self.held is None:
            return np.ones(h.shape, bool)
        one, two = bits(h, length, self.n)
        found = (self.held[one >> 3] >> (one & 7).astype(np.uint8)) & 1 > 0
        at = np.flatnonzero(found)
        two = two.ravel()[at]
        found.ravel()[at] = (self.held[two >> 3] >> (two & 7).astype(np.uint8)) & 1 > 0
        return found

    def of(self, words: list[str]):
        """(index of the word, neighbour), each neighbour of a word once."""
        data, first = _points(words)
        size = np.diff(first)
        up = _powers(int(size.max(initial=0)) + 1)
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(data)) - first[word]
        sums = np.r_[U64(0), np.cumsum((data + U64(1)) * up[place])]
        for lo in range(0, len(data), STEP):
            yield from self._step(words, slice(lo, min(lo + STEP, len(data))), data, first, size, up, word, place, sums)
        # a letter put at the end, unless the word ends with it: that is the letter put before those equal ones
        ends = first[1:] - 1
        for lo in range(0, len(words), STEP):
            some = np.arange(lo, min(lo + STEP, len(words)))
            some = some[size[some] > 0]
            total, n = sums[first[some + 1]] - sums[first[some]], size[some]
            new = total[:, None] + (self.letters + U64(1)) * up[n][:, None]
            good = self._kept(new, (n + 1)[:, None]) & (data[ends[some]][:, None] != self.letters)
            for i, a in zip(*map(np.ndarray.tolist, np.nonzero(good)), strict=True):
                yield int(some[i]), words[some[i]] + self.alphabet[a]

    def _step(self, words, part, data, first, size, up, word, place, sums):
        """Deletions of, replacements of and insertions before the code points of one part."""
        w, p, c = word[part], place[part], data[part]
        n = size[w]
        at = np.arange(part.start, part.stop)
        before, through, total = sums[at] - sums[first[w]], sums[at + 1] - sums[first[w]], sums[first[w + 1]] - sums[first[w]]
        previous = np.where(p > 0, data[at - 1], 0)  # 0 is no letter
        deleted = before + (total - through) * _INVERSE
        good = self._kept(deleted, n - 1) & (previous != c)
        for i in np.flatnonzero(good).tolist():
            x, k = words[w[i]], int(p[i])
            yield int(w[i]), x[:k] + x[k + 1 :]
        replaced = total[:, None] + (self.letters - c[:, None]) * up[p][:, None]
        good = self._kept(replaced, n[:, None]) & (c[:, None] != self.letters)
        for i, a in zip(*map(np.ndarray.tolist, np.nonzero(good)), strict=True):
            x, k = words[w[i]], int(p[i])
            yield int(w[i]), x[:k] + self.alphabet[a] + x[k + 1 :]
        put = (before + (total - before) * _B)[:, None] + (self.letters + U64(1)) * up[p][:, None]
        good = self._kept(put, (n + 1)[:, None]) & (previous[:, None] != self.letters)
        for i, a in zip(*map(np.ndarray.tolist, np.nonzero(good)), strict=True):
            x, k = words[w[i]], int(p[i])
            yield int(w[i]), x[:k] + self.alphabet[a] + x[k:]


def _bit_set(words: DataFrame, n: int) -> np.ndarray:
    """The bit set of all words; n / 64 rows of two numbers at most reach the driver."""
    schema = flow.arrow("cell long,ones long")

    def run(batches):
        for b in batches:
            some = [w for w in b.column("word").to_pylist() if w]
            if some:
                at = np.concatenate(bits(hashes(some), np.array([len(w) for w in some]), n))
                yield flow.batch(schema, cell=at >> 6, ones=np.left_shift(np.int64(1), at & 63))

    cells = words.mapInArrow(run, "cell long, ones long").groupBy("cell").agg(F.bit_or("ones").alias("ones")).toArrow()
    held = np.zeros(n >> 6, np.int64)
    held[cells.column("cell").to_numpy()] = cells.column("ones").to_numpy()
    return held.view(np.uint8)


def near_words(words: DataFrame, n_bits: int = BITS) -> DataFrame:
    """(word, n, near, near_n) for each two words (word, n) of the vocabulary that differ by one code point, in both orders."""
    spark = words.sparkSession
    alphabet = "".join(r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().orderBy("c").collect())
    held = spark.sparkContext.broadcast(_bit_set(words.select("word"), n_bits))
    schema = flow.arrow("word string,n long,near string")

    def run(batches):
        made = Neighbours(alphabet, held.value, n_bits)
        for b in batches:
            for k in range(0, len(b), 4096):
                some = [(w, n) for w, n in zip(b.column("word").slice(k, 4096).to_pylist(), b.column("n").slice(k, 4096).to_pylist(), strict=True)]
                out, size = [], 0
                for i, near in made.of([w for w, _ in some]):
                    out.append((*some[i], near))
                    size += len(near) + 1
                    if size > 1 << 20:
                        yield _rows(out, schema)
                        out, size = [], 0
                if out:
                    yield _rows(out, schema)

    # a few MB of words make hundreds of times as many candidates, so they are dealt to many tasks
    found = words.repartition(flow.n_buckets(spark), "word").mapInArrow(run, "word string, n long, near string")
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("shuffle_hash"), "near").select("word", "n", "near", "near_n")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): the last form on the way from each word. Ways have no circles, as n grows.

    Each round doubles the steps that a row stands for, so rounds grow with the logarithm of the longest way."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = flow.cut(now.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if after.filter("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, n_bits: int = BITS) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of the texts of docs."""
    words = flow.cut(vocabulary(docs, shortest, least))
    # of equally frequent ones the smallest: a minimum over (-n, word)
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("form")))
    grouped = near_words(words, n_bits).groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.k") >= ratio * F.col("n")
    near = flow.cut(grouped.select("word", "n_near", F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.k")).alias("form_n")))
    ends = roots(near.filter("form is not null"))
    out = words.join(near.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
