"""Toxic passages: every maximal-scoring segment over token log-odds, by extreme-value calibration.

Tokens (hashed to SLOTS buckets) get the log-odds of toxic against other labelled documents, with the
Dirichlet prior of both, as z-scores' weights; less a step, so that ordinary text scores below zero.
One linear scan finds all maximal segments. Under random text the greatest segment of n words follows a
Gumbel law with parameters lambda and K, solved from the tokens of the other class; a segment's
significance is its tail probability. A logistic curve over a document's best significance, its
number of significant segments and its length gives the score.

The classifier is fitted on at most SAMPLE labelled documents, the first by hash of doc_id. Its size on
executors and driver is set by SLOTS and SAMPLE, not by the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, U64, Block, blocks
from .flow import arrow, batch, documents

SLOTS, SAMPLE, THRESHOLD = 1 << 18, 40_000, 0.3
PRIOR, STEP, SIGNIFICANT = 500.0, 0.5, 0.05
RESULT = "doc_id long,held_out boolean,score double,predicted int,n_segments int,best_start int,best_end int,starts array<long>,ends array<long>"


def slots_of(b: Block) -> np.ndarray:
    return (b.hashes() >> U64(46)).astype(np.int64)


def segments(x: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, from, to) of a sequence, in linear time.

    Runs of tokens that don't gain are one step of the scan; a stack keeps segments with the totals
    before (low) and after (high) them, and merges those that a later gain makes one.
    """
    gain = x > 0
    if not gain.any():
        return []
    total = np.concatenate([[0.0], np.cumsum(x)])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gain, [False]])))
    stack: list[tuple[int, int, float, float, int]] = []  # from, to, low, high, the nearest segment below with a smaller low
    for s, e in edge.reshape(-1, 2):
        low, high = total[s], total[e]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((int(s), int(e), low, high, j))
                break
            s, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(high - low, s, e) for s, e, low, high, _ in stack]


@dataclass
class Model:
    weight: np.ndarray
    lam: float
    k: float
    curve: np.ndarray

    def significance(self, score: float, n: int) -> float:
        """The probability that n words of ordinary text hold a segment of this score."""
        return float(-np.expm1(-self.k * max(n, 1) * np.exp(-self.lam * score)))

    def features(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[float, float, int, int]]]:
        """Of the tokens' weights of one text: features, and the significant segments, best first."""
        found = sorted((self.significance(s, len(x)), -s, a, b) for s, a, b in segments(x))
        kept = [f for f in found if f[0] <= SIGNIFICANT]
        best = -np.log(max(found[0][0], 1e-12)) if found else 0.0
        return np.array([1.0, min(best, 20.0) / 5, np.log1p(len(kept)), np.log1p(-sum(f[1] for f in kept)) / 3, np.log1p(len(x)) / 5]), kept

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(f @ self.curve, -30, 30))))


def evd(x: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    """lambda with sum of p exp(lambda x) = 1, and a K from the ladder of gains: of scores x with probabilities p."""
    lo, hi = 1e-6, 1.0
    m = lambda t: float((p * np.exp(np.clip(t * x, -50, 50))).sum())
    if (x * p).sum() >= 0 or not (x > 0).any():
        return 1.0, 0.1
    while m(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if m(mid) < 1 else (lo, mid)
    lam = (lo + hi) / 2
    drift = float((p * x * np.exp(np.clip(lam * x, -50, 50))).sum())
    return lam, min(1.0, max(1e-6, float(-(p * x).sum()) ** 2 / max(lam * drift, 1e-9)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (q * (1 - q))) @ x + ridge * np.eye(len(w)), x.T @ (y - q) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def remainder(column, by: int):
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def fit(docs: DataFrame, labels: DataFrame, train, slots_bits: int = 18, sample: int = SAMPLE) -> Model:
    """Learns from the labelled documents for which train(doc_id column) holds; null labels and ids are ignored."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null").filter(train(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)  # the bound of the broadcast
    labelled = documents(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("text", "toxic")
    n = 1 << slots_bits

    def counts(batches):
        total = np.zeros((2, n), np.int64)
        for b in batches:
            toxic = np.array(b["toxic"].to_pylist(), int)
            for i, j, block in blocks(b["text"], ALNUM, True):
                key = np.unique(block.text * n + slots_of(block))  # a document counts a token once
                np.add.at(total, (toxic[i:j][key // n], key % n), 1)
        at = np.flatnonzero(total.sum(0))
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)], pa.int32()), *(pa.array(t[at[i : i + (1 << 16)]], pa.int64()) for t in total)], names=["slot", "other", "toxic"])

    got = labelled.mapInArrow(counts, "slot int, other long, toxic long").groupBy("slot").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toPandas()
    c = np.zeros((2, n))
    c[0, got["slot"]], c[1, got["slot"]] = got["other"], got["toxic"]
    size, share = c.sum(1) + 1, (c.sum(0) + 0.01) / (c.sum() + 0.01 * n)
    odds = [np.log((c[i] + PRIOR * share) / (size[i] + PRIOR - c[i] - PRIOR * share)) for i in (0, 1)]
    z = (odds[1] - odds[0]) / np.sqrt(1 / (c[0] + PRIOR * share) + 1 / (c[1] + PRIOR * share))
    weight = np.where(np.abs(z) >= 2.0, np.clip(odds[1] - odds[0], -3, 6), 0.0) * np.minimum(1, np.abs(z) / 5) - STEP
    lam, k = evd(weight, c[0] / max(c[0].sum(), 1))
    model = Model(weight.astype(np.float32), lam, k, np.array([-3.0, 1, 0, 0, 0]))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches):
        for b in batches:
            rows = []
            for i, j, block in blocks(b["text"], ALNUM, True):
                x = held.value.weight[slots_of(block)]
                rows += [[*held.value.features(x[block.first[t] : block.first[t + 1]])[0], b["toxic"][i + t].as_py()] for t in range(j - i)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, float)) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * 6, names=[f"x{i}" for i in range(6)])

    m = labelled.mapInArrow(measured, ", ".join(f"x{i} double" for i in range(6))).toPandas().to_numpy()  # six numbers for each of the sample
    if len(m):
        model.curve = logistic(m[:, :5], m[:, 5])
    return model


def score(docs: DataFrame, model: Model, by: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted and the best significant passage (words from and to, -1 without one) of every document.

    starts and ends bound the words of every significant passage, best first. Null and empty texts have no words and get the score of a text without a passage. Repeated rows give a row each.
    """
    held, schema = docs.sparkSession.sparkContext.broadcast(model), arrow(RESULT)

    def run(batches):
        for b in batches:
            rows = []
            for _, _, block in blocks(b["text"], ALNUM, True):
                x = held.value.weight[slots_of(block)]
                for t in range(block.n_texts):
                    f, kept = held.value.features(x[block.first[t] : block.first[t + 1]])
                    p = held.value.score(f)
                    rows.append((p, int(p >= THRESHOLD), len(kept), *(kept[0][2:] if kept else (-1, -1)), [k[2] for k in kept], [k[3] for k in kept]))
            cols = list(map(list, zip(*rows, strict=True))) if rows else [[]] * 7
            yield batch(schema, doc_id=b["doc_id"], held_out=b["held_out"], **dict(zip(schema.names[2:], cols, strict=True)))

    rows = documents(docs).select("doc_id", "text", (remainder(F.col("doc_id"), by) == held_out).alias("held_out"))
    return rows.mapInArrow(run, RESULT)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, whose score stays below THRESHOLD; null and empty texts are scored as score() does. Repeated rows stay or go together."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            keep = []
            for _, _, block in blocks(b["text"], ALNUM, True):
                x = held.value.weight[slots_of(block)]
                keep += [held.value.score(held.value.features(x[block.first[t] : block.first[t + 1]])[0]) < THRESHOLD for t in range(block.n_texts)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
