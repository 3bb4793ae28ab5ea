"""Quality from weak labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Each labeller votes good, bad or abstains on a document. The counts of vote patterns over all documents
(at most 3 ** 9 patterns) are all that expectation-maximisation needs; it estimates each labeller's accuracy on
either class and gives each pattern a posterior. A linear scorer over hashed words and measures is trained
on the posteriors of at most SAMPLE rows, chosen by a hash, and scores every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, SPACED, U64, blocks
from .flow import arrow, batch, cut, documents

SAMPLE, SLOT_BITS, KEEP, PRIOR_GOOD = 20_000, 12, 0.5, 0.85
RESULT = "doc_id long,votes int,posterior double,score double,keep boolean"
LABELLERS = ("length", "mean_word", "symbols", "letters", "distinct_words", "repeated_lines", "capitals", "long_words", "table_marks")
_LETTER = ALNUM.copy()
_LETTER[0x30:0x3A] = False
_SYMBOL = ~ALNUM & SPACED
_SYMBOL[[ord(c) for c in ".,;:!?'\"-()"]] = False


def measures(block) -> np.ndarray:
    """LABELLERS' measures of each text of a block."""
    n = np.maximum(np.diff(block.offsets), 1)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[block.data])])
        return (total[block.offsets[1:]] - total[block.offsets[:-1]]) / n

    size, h, words = block.end - block.start, block.hashes(), np.maximum(block.count, 1)
    per = lambda w: np.bincount(block.text, w, block.n_texts)
    distinct = np.bincount(_unique_pairs(block.text, h), minlength=block.n_texts) / words
    upper, bar, raw = np.zeros(256, bool), np.zeros(256, bool), block.data.tobytes()
    upper[65:91], bar[[ord("|"), ord("\t")]] = True, True
    lines = np.zeros(block.n_texts)
    for t, (i, j) in enumerate(zip(block.offsets, block.offsets[1:], strict=False)):
        own = raw[i:j].split(b"\n")
        lines[t] = 1 - len(set(own)) / len(own)
    return np.stack([block.count, per(size) / words, share(_SYMBOL), share(_LETTER), distinct, lines, share(upper), per(size > 25) / words, share(bar)], 1)


def _unique_pairs(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    order = np.lexsort((h, text))
    t, g = text[order], h[order]
    return t[np.r_[True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])]] if len(t) else t


def votes(m: np.ndarray) -> np.ndarray:
    """-1 bad, 1 good, 0 abstains, by each labeller: fixed limits on its measure."""
    n, word, symbol, letter, distinct, lines, upper, long, bar = m.T
    judge = lambda bad, good: np.where(bad, -1, np.where(good, 1, 0))
    return np.stack([
        judge(n < 5, n >= 50), judge((word < 2.5) | (word > 14), (word > 3.5) & (word < 9)), judge(symbol > 0.08, symbol < 0.02), judge(letter < 0.6, letter > 0.75),
        judge(distinct < 0.15 + 6 / np.maximum(n, 6) * 0.05, (distinct > 0.3) | (n > 2000)), judge(lines > 0.3, lines < 0.1), judge(upper > 0.3, upper < 0.1), judge(long > 0.1, long < 0.02), judge(bar > 0.02, bar < 0.002),
    ], 1)


def coded(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(len(LABELLERS))).sum(1)


def decoded(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The posterior of good for each pattern: a two-class model of independent labellers, with abstention as a third vote."""
    v, good = decoded(codes) + 1, PRIOR_GOOD
    table = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])[:, None, :].repeat(v.shape[1], 1)  # class, labeller, vote
    for _ in range(rounds):
        log = np.log(table)[:, np.arange(v.shape[1]), v].sum(2) + np.log([[1 - good], [good]])
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        weight = np.stack([(1 - p) * counts, p * counts])
        good = float(np.clip(weight[1].sum() / max(counts.sum(), 1), 0.01, 0.99))
        for k in range(3):
            table[:, :, k] = weight @ (v == k) + 10 * np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])[:, k : k + 1]
        table /= table.sum(2, keepdims=True)
    return p


class Features:
    """Features of a block's texts: relative counts of words by hash, kept as a slot and a weight for each word, and scaled measures."""

    def __init__(self, block, m: np.ndarray):
        self.slot, self.text, self.n = (block.hashes() >> U64(64 - SLOT_BITS)).astype(np.int64), block.text, block.n_texts
        self.scale = 0.1 / np.sqrt(np.maximum(block.count, 1))
        self.rest = np.concatenate([np.log1p(m[:, :1]) / 5, m[:, 1:2] / 10, m[:, 2:] * 3, np.ones((len(m), 1)), votes(m) / 2], 1)
        self.total = block.count * self.scale + np.abs(self.rest).sum(1)  # of absolute values

    def dot(self, w: np.ndarray) -> np.ndarray:
        size = 1 << SLOT_BITS
        return np.bincount(self.text, w[self.slot], self.n) * self.scale + self.rest @ w[size:]

    def summed(self, by: np.ndarray, absolute: bool = False) -> np.ndarray:
        """The texts' features, each text's times its factor, in one vector."""
        words = np.bincount(self.slot, (by * self.scale)[self.text], 1 << SLOT_BITS)
        return np.concatenate([words, by @ (np.abs(self.rest) if absolute else self.rest)])


def _measured(batches):
    for b in batches:
        codes = [coded(votes(measures(block))) for _, _, block in blocks(b["text"], SPACED)]
        if codes:
            u, c = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int32()), pa.array(c, pa.int64())], names=["votes", "n"])


def classify(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """doc_id, votes (a code), posterior, score and keep of every document.

    keep holds if the mean of posterior and score is at least the limit. Null and empty texts have no words and are judged so.
    Repeated rows give a row each.
    """
    spark = docs.sparkSession
    rows = documents(docs)
    patterns = rows.select("text").mapInArrow(_measured, "votes int, n long").groupBy("votes").agg(F.sum("n").alias("n")).toPandas().sort_values("votes")
    codes, schema = patterns["votes"].to_numpy(), arrow(RESULT)
    posterior = np.full(3 ** len(LABELLERS), 0.5)
    if len(codes):
        posterior[codes] = estimate(codes, patterns["n"].to_numpy())
    total = int(patterns["n"].sum())
    bound = -(2**63) + int(2**64 * min(1.0, sample / max(total, 1)))
    # By row, not by document, so that repeated rows are sampled like others.
    chosen = rows.filter(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()) < F.lit(min(bound, 2**63 - 1))).limit(sample) if total > sample else rows
    held = spark.sparkContext.broadcast(posterior)

    def gradients(weights):
        def run(batches):
            g, h = np.zeros(len(weights.value)), np.zeros(len(weights.value))
            for b in batches:
                for _, _, block in blocks(b["text"], SPACED):
                    m = measures(block)
                    x, y = Features(block, m), held.value[coded(votes(m))]
                    q = 1 / (1 + np.exp(-np.clip(x.dot(weights.value), -30, 30)))
                    g, h = g + x.summed(y - q), h + x.summed(q * (1 - q), True) * x.total.max(initial=1)
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([h.tobytes()], pa.binary())], names=["g", "h"])

        return run

    w = np.zeros((1 << SLOT_BITS) + 2 * len(LABELLERS) + 1)
    chosen = cut(chosen.select("text").repartition(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 24))))
    for _ in range(12):
        got = chosen.mapInArrow(gradients(spark.sparkContext.broadcast(w)), "g binary, h binary").collect()
        g, h = (sum((np.frombuffer(r[k], float) for r in got), np.zeros(len(w))) for k in (0, 1))
        w = w + 2 * (g - 0.1 * w) / (h + 1)
    weights = spark.sparkContext.broadcast(w)

    def run(batches):
        for b in batches:
            code, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, block in blocks(b["text"], SPACED):
                m = measures(block)
                code.append(coded(votes(m)))
                score.append(1 / (1 + np.exp(-np.clip(Features(block, m).dot(weights.value), -30, 30))))
            code, score = np.concatenate(code), np.concatenate(score)
            p = held.value[code]
            yield batch(schema, doc_id=b["doc_id"], votes=code.astype(np.int32), posterior=p, score=score, keep=(p + score) / 2 >= keep)

    return rows.mapInArrow(run, RESULT)
