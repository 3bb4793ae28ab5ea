"""Language-model scores: a log-bilinear model over frequent words, trained by noise-contrastive estimation.

The most frequent words have outputs of their own, OWN times the fourth root of the vocabulary, so that the
normalisers of all pairs of outputs grow less than the vocabulary. Other words of the head (HEAD words whose counts are sent to
executors) share an output with those of like frequency, and all others share the last.
Within a shared output a word has the part (c + 1) of its class, where one unseen word counts 1, so that
the probabilities of all words sum to 1. The two words before predict the output; since contexts are pairs
of outputs, the normaliser of each context is computed once, by batched matrix products.

Counts, classes, noise and base scores come from all training tokens and are gathered by hashed
buckets; counts of words outside the head never leave their bucket, which returns sums for each text.
The network's weights are fitted to all training positions: rows are dealt by a hash to shards of about SHARD positions,
whatever partitions the table has. In each of EPOCHS rounds every shard goes on from the common weights over its own
positions, and the weights it ends with count by its positions in their mean. So a round learns as much from each position
at any size (a table too small for one shard is gone over several times, PASSES at most), and scores don't depend on the table's layout (but for shards over HELD positions, which one huge text can make).
Of HELD positions at a time, equal ones (contexts are pairs of outputs, so they are many) are one row that weighs as many.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, U64, blocks, mix
from .flow import arrow, batch, cut, documents, pack, ranges_by_bucket, unpack

OWN, HEAD = 42, 1 << 17
DIM, NOISE, EPOCHS, RATE = 32, 128, 2, 0.15
HELD, SHARD, PASSES = 1 << 22, 1 << 21, 16
END = U64(0x5E0F5E0F5E0F5E0F)  # the end of a text, as a token
RESULT = "doc_id long,held_out boolean,n_tokens long,n_known long,train_tokens long,base_score double,score double"
SCORED = "bucket int,slice long,blob binary,at int,doc_id long,held_out boolean,n_tokens long,n_rare long,known long,counts double,model double"


def tokens(b) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text's end included, and where each text's tokens begin."""
    first = b.first + np.arange(b.n_texts + 1)
    out = np.full(len(b) + b.n_texts, END, U64)
    out[np.arange(len(b)) + b.text] = b.hashes()
    return out, first


def counted(docs: DataFrame, n: int) -> DataFrame:
    """For each bucket: tokens, distinct words and the words of greatest count of the training rows.

    A bucket offers twenty standard deviations more than its share of the head, so the head doesn't depend on how many there are.
    """
    share = HEAD / n
    most = int(np.ceil(share + 20 * np.sqrt(share))) + 64

    def run(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            h, c = (np.concatenate(x) for x in zip(*kept, strict=True))
            u, at = np.unique(h, return_inverse=True)
            return u, np.bincount(at, c, len(u)).astype(np.int64)

        def sent():
            u, c = merged()
            rows = [(k, pack(u[i:j], c[i:j])) for k, i, j in ranges_by_bucket(u, n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

        held = 0
        for b in batches:
            train = ~np.array(b["held_out"].to_pylist(), bool)
            for i, j, block in blocks(b["text"], SPACED, True):
                t, first = tokens(block)
                kept.append(np.unique(t[np.repeat(train[i:j], np.diff(first))], return_counts=True))
                held += len(kept[-1][0])
                if held > 3_000_000:
                    kept = [merged()]
                    held = len(kept[0][0])
                    if held > 2_000_000:
                        yield from sent()
                        kept, held = [], 0
        if kept:
            yield from sent()

    def summed(table):
        parts = [unpack(x, U64, np.int64) for x in table["blob"].to_pylist()]
        u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        c = np.bincount(at, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)
        top = np.sort(np.lexsort((u, -c))[:most])
        return pa.table({"n": pa.array([int(c.sum())]), "v": pa.array([len(u)]), "top": pa.array([pack(u[top], c[top])], pa.binary())})

    return docs.mapInArrow(run, "bucket int, blob binary").groupBy("bucket").applyInArrow(summed, "n long, v long, top binary")


@dataclass
class Model:
    words: np.ndarray  # the head, sorted
    output: np.ndarray  # of each word of the head
    log_count: np.ndarray  # log10 of count + 1
    log_class: np.ndarray  # log10 of the sum of count + 1 in each output
    n: int
    v: int
    near: np.ndarray | None = None  # what each output adds as the word before
    far: np.ndarray | None = None  # and as the one before that
    weight: np.ndarray | None = None
    bias: np.ndarray | None = None
    norm: np.ndarray | None = None  # log of the normaliser of each context

    @property
    def outputs(self) -> int:
        return len(self.log_class)

    def find(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of tokens, and places in the head (-1: not in it)."""
        if not len(self.words):
            return np.full(len(t), self.outputs - 1), np.full(len(t), -1)
        at = np.minimum(np.searchsorted(self.words, t), len(self.words) - 1)
        at = np.where(self.words[at] == t, at, -1)
        return np.where(at < 0, self.outputs - 1, self.output[at]), at

    def contexts(self, out: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The outputs one and two places before; the number of outputs stands for a text's beginning."""
        one, two = np.roll(out, 1), np.roll(out, 2)
        start = first[:-1]
        one[start] = two[start] = self.outputs
        second = start[np.diff(first) > 1] + 1
        two[second] = self.outputs
        return one, two

    def log10(self, out: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 of the probability of each output in its context."""
        p = np.empty(len(out))
        for i in range(0, len(out), 1 << 16):
            s = slice(i, i + (1 << 16))
            p[s] = np.einsum("ij,ij->i", self.near[one[s]] + self.far[two[s]], self.weight[out[s]]) + self.bias[out[s]] - self.norm[two[s] * (self.outputs + 1) + one[s]]
        return p / np.log(10)


def classes(gathered: list) -> Model:
    """The head's words by falling count: the first alone, then by powers of two of their counts, then all the rest."""
    parts = [unpack(r.top, U64, np.int64) for r in gathered]
    u = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U64)
    c = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    n, v = sum(r.n for r in gathered), sum(r.v for r in gathered)
    top = int(np.ceil(OWN * v**0.25))
    order = np.lexsort((u, -c))[:HEAD]
    bins = np.floor(np.log2(np.maximum(c[order], 1))).astype(int)
    output = np.arange(len(order))
    output[top:] = top + np.unique(-bins[top:], return_inverse=True)[1] if len(order) > top else output[top:]
    k = int(output.max(initial=-1)) + 2
    mass = np.bincount(output, c[order] + 1, k)
    mass[-1] = (n - c[order].sum()) + (v - len(order)) + 1
    at = np.argsort(u[order])
    return Model(u[order][at], output[at], np.log10(c[order][at] + 1.0), np.log10(mass), n, v)


class Network:
    """The weights, and their sums of squared gradients, as noise-contrastive estimation with Adagrad changes them."""

    def __init__(self, model: Model, seed: int = 11):
        k, rng = model.outputs, np.random.default_rng(seed)
        self.share = 10**model.log_class
        self.share /= self.share.sum()
        r, q, b = rng.normal(0, 0.1, (k + 1, DIM)).astype(np.float32), rng.normal(0, 0.1, (k, DIM)).astype(np.float32), np.log(self.share).astype(np.float32)
        self.params = [r, q, b, *(np.eye(DIM, dtype=np.float32) * s for s in (0.7, 0.3))]
        self.past = [np.full_like(p, 1e-2) for p in self.params]
        self.log_noise = (np.log(NOISE) + np.log(self.share)).astype(np.float32)

    def state(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.params, *self.past)])

    def become(self, state: np.ndarray) -> None:
        at = 0
        for x in (*self.params, *self.past):
            x[...] = state[at : at + x.size].reshape(x.shape)
            at += x.size

    def learn(self, rows: np.ndarray, rng: np.random.Generator, size: int = 512) -> None:
        """One pass over rows (two before, one before, output), equal ones at once, in random order; the noise is the outputs' share of all training tokens."""
        k = self.log_noise.shape[0] + 1
        keys, weight = np.unique((rows[:, 0].astype(np.int64) * k + rows[:, 1]) * k + rows[:, 2], return_counts=True)
        rows = np.stack([keys // (k * k), keys // k % k, keys % k], 1)
        noises = np.searchsorted(np.cumsum(self.share)[:-1], rng.random((-(-len(rows) // size), NOISE)), "right")
        order = rng.permutation(len(rows))
        for i, noise in zip(range(0, len(rows), size), noises, strict=True):
            self._step(*rows[order[i : i + size]].T, weight[order[i : i + size]].astype(np.float32), noise)

    def _step(self, two: np.ndarray, one: np.ndarray, out: np.ndarray, weight: np.ndarray, noise: np.ndarray) -> None:
        (r, q, b, near, far), weight = self.params, weight / weight.sum()
        x, y, z, w = r[one], r[two], q[out], q[noise]
        h = x @ near + y @ far
        gain = weight / (1 + np.exp(np.einsum("ij,ij->i", h, z) + b[out] - self.log_noise[out]))  # of true words
        loss = (h * np.float32(0.5)) @ w.T  # of noise words: the logistic function by tanh, in place
        loss += (b[noise] - self.log_noise[noise]) * np.float32(0.5)
        np.tanh(loss, out=loss)
        loss += 1
        loss *= np.float32(-0.5) * weight[:, None]
        gh = gain[:, None] * z + loss @ w
        before = _summed(np.concatenate([one, two]), np.concatenate([gh @ near.T, gh @ far.T]))
        word, g = _summed(np.concatenate([out, noise]), np.concatenate([np.c_[gain[:, None] * h, gain], np.c_[loss.T @ h, loss.sum(0)]]))
        for p, at, g in ((0, *before), (1, word, g[:, :-1]), (2, word, g[:, -1]), (3, slice(None), x.T @ gh), (4, slice(None), y.T @ gh)):
            self.past[p][at] += g * g
            self.params[p][at] += RATE * g / np.sqrt(self.past[p][at])


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(rows[order], first, axis=0)


def positions(batches, model: Model, most: int | None = None):
    """Blocks of (two before, one before, output) at the training positions: all, or the share of them whose hash falls under most / N."""
    bound = U64(2**64 - 1 if most is None else min(2**64 - 1, int(2**64 * most / max(model.n, most))))
    for b in batches:
        train = ~np.array(b["held_out"].to_pylist(), bool)
        key = np.array([x or 0 for x in b["doc_id"].to_pylist()], np.int64).astype(U64)
        for i, j, block in blocks(b["text"], SPACED, True):
            t, first = tokens(block)
            size = np.diff(first)
            pick = np.repeat(train[i:j], size)
            if most is not None:
                place = np.arange(len(t)) - np.repeat(first[:-1], size)
                pick &= mix(mix(np.repeat(key[i:j], size)) + place.astype(U64)) <= bound
            if pick.any():
                out, _ = model.find(t)
                one, two = model.contexts(out, first)
                yield np.stack([x[pick] for x in (two, one, out)], 1).astype(np.int32)


def fitted(docs: DataFrame, model: Model, n: int, most: int | None = None, seed: int = 11) -> Model:
    """The model with the network fitted to the training positions of docs; `most` bounds them only where a caller asks for it."""
    net = Network(model, seed)
    bare, cuts = docs.sparkSession.sparkContext.broadcast(model), np.linspace(0, len(net.state()), n + 1).astype(int)

    def summed(table):
        table = table.sort_by("part")  # sums in one order
        weight = table["n"].to_numpy()
        total = sum(np.frombuffer(x, np.float32) * np.float64(w) for x, w in zip(table["blob"].to_pylist(), weight, strict=True))
        return pa.table({"slice": table["slice"][:1].combine_chunks(), "blob": pa.array([pack((total / weight.sum()).astype(np.float32))], pa.binary())})

    # only training rows travel; equal rows go to one shard together
    shards = max(1, -(-min(model.n, most or model.n) // SHARD))
    dealt = docs.filter("not held_out").repartition(shards, F.xxhash64("doc_id", "text"))

    for epoch in range(EPOCHS):
        start = docs.sparkSession.sparkContext.broadcast(net.state())

        def run(batches, start=start, epoch=epoch):
            part, seen, held = TaskContext.get().partitionId(), 0, []
            own, rng = Network(bare.value, seed), np.random.default_rng((seed, epoch, part))
            own.become(start.value)
            for rows in positions(batches, bare.value, most):
                held.append(rows)
                seen += len(rows)
                if sum(map(len, held)) > HELD:
                    own.learn(np.concatenate(held), rng)
                    held = []
            if held:
                rows = np.concatenate(held)
                for _ in range(min(PASSES, max(1, SHARD // seen))):
                    own.learn(rows, rng)
            if seen:
                state = own.state()
                yield pa.RecordBatch.from_pydict({"slice": pa.array(range(n), pa.int32()), "part": pa.array([part] * n, pa.int32()), "n": pa.array([seen] * n), "blob": pa.array([pack(state[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())})

        means = dealt.mapInArrow(run, "slice int, part int, n long, blob binary").groupBy("slice").applyInArrow(summed, "slice int, blob binary").collect()
        if means:
            net.become(np.concatenate([np.frombuffer(r.blob, np.float32) for r in sorted(means, key=lambda r: r.slice)]))
    return finished(model, net, docs.sparkSession, n)


def train(model: Model, rows: np.ndarray, seed: int = 11) -> Model:
    """The model fitted to rows (two before, one before, output) that are here."""
    net, rng = Network(model, seed), np.random.default_rng(seed)
    for _ in range(EPOCHS if len(rows) else 0):
        net.learn(rows, rng)
    return finished(model, net)


def finished(model: Model, net: Network, spark=None, n: int = 1) -> Model:
    """The model with the network's weights and each context's normaliser, computed by executors where a session is given."""
    (r, q, b, near, far), k = net.params, model.outputs
    model.near, model.far, model.weight, model.bias = r @ near, r @ far, q, b
    if spark is None:
        model.norm = np.concatenate([normaliser(model, two) for two in range(k + 1)])
        return model
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for x in batches:
            for two in x["id"].to_pylist():
                yield pa.RecordBatch.from_pydict({"two": pa.array([two], pa.int64()), "blob": pa.array([pack(normaliser(held.value, two))], pa.binary())})

    rows = spark.range(0, k + 1, 1, n).mapInArrow(run, "two long, blob binary").collect()
    model.norm = np.concatenate([np.frombuffer(x.blob, np.float32) for x in sorted(rows, key=lambda x: x.two)])
    return model


def normaliser(model: Model, two: int) -> np.ndarray:
    """Log of the normaliser of every context with this output two places before."""
    x = (model.near + model.far[two]) @ model.weight.T + model.bias
    top = x.max(1, keepdims=True)
    return (np.log(np.exp(x - top).sum(1)) + top[:, 0]).astype(np.float32)


def scored(docs: DataFrame, model: Model, n: int) -> DataFrame:
    """A row for each text (bucket -1), and for each slice of texts and bucket the words outside the head with their texts."""
    held, schema = docs.sparkSession.sparkContext.broadcast(model), arrow(SCORED)

    def run(batches):
        count, part = 0, TaskContext.get().partitionId()
        for b in batches:
            out_of = b["held_out"].to_pylist()
            for i, j, block in blocks(b["text"], SPACED, True):
                model, name = held.value, (part << 32) + count
                count += 1
                t, first = tokens(block)
                size, m = np.diff(first), j - i
                text = np.repeat(np.arange(m), size)
                out, at = model.find(t)
                rare, p = at < 0, model.log10(out, *model.contexts(out, first))
                logs = np.where(rare, 0.0, model.log_count[np.maximum(at, 0)] if len(model.words) else 0.0)
                sums = [np.bincount(text, x, m) for x in (rare, ~rare, logs, p + logs - model.log_class[out])]
                yield batch(schema, bucket=[-1] * m, slice=[name] * m, blob=pa.nulls(m, pa.binary()), at=np.arange(m), doc_id=b["doc_id"][i:j], held_out=out_of[i:j], n_tokens=size, n_rare=sums[0].astype(np.int64), known=sums[1].astype(np.int64), counts=sums[2], model=sums[3])
                trained = np.array([not x for x in out_of[i:j]])
                h, who = t[rare], text[rare]
                order = np.argsort(h, kind="stable")
                h, who = h[order], (who[order] | (trained[who[order]].astype(np.int64) << 31)).astype(np.uint32)
                rows = [(k, pack(h[x:y], who[x:y])) for k, x, y in ranges_by_bucket(h, n)]
                none = pa.nulls(len(rows))
                yield batch(schema, bucket=[x[0] for x in rows], slice=[name] * len(rows), blob=[x[1] for x in rows], **{f.name: none.cast(f.type) for f in list(schema)[3:]})

    return docs.mapInArrow(run, SCORED)


def _looked_up(table: pa.Table) -> pa.Table:
    """For each slice: its texts' sums of log10(c + 1), and of known words, over this bucket's words."""
    slices, at = np.unique(table["slice"].to_numpy(), return_inverse=True)
    parts = [unpack(x, U64, np.uint32) for x in table["blob"].to_pylist()]
    h, who = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    where = np.repeat(at, [len(p[0]) for p in parts])
    u, word = np.unique(h, return_inverse=True)
    c = np.bincount(word, who >> 31, len(u))
    key = (where.astype(np.int64) << 32) | (who & np.uint32(0x7FFFFFFF))
    texts, to = np.unique(key, return_inverse=True)
    sums, known = np.bincount(to, np.log10(c + 1)[word], len(texts)), np.bincount(to, c[word] > 0, len(texts)).astype(np.uint32)
    edge = np.searchsorted(texts >> 32, np.arange(len(slices) + 1))
    return pa.table({"slice": slices, "blob": pa.array([pack((texts[a:b] & 0xFFFFFFFF).astype(np.uint32), sums[a:b], known[a:b]) for a, b in zip(edge, edge[1:], strict=False)], pa.binary())})


def score(docs: DataFrame, by: int = 7, held_out: int = 2, examples: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Null texts are empty: their end is their one token. Repeated rows count as often as they stand,
    and give a row each; a null doc_id counts as the empty string for the fold. Without training rows
    every word is unknown. `examples` bounds the positions the network learns from; by default it learns from all.
    """
    from .toxicity import remainder

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(docs).withColumn("held_out", remainder(F.col("doc_id"), by) == held_out)
    model = classes(counted(rows, n).collect())  # a row for each bucket, HEAD words in all
    model = fitted(rows, model, n, examples)
    found = cut(scored(rows, model, n))
    back = found.filter("bucket >= 0").groupBy("bucket").applyInArrow(_looked_up, "slice long, blob binary")
    total, schema = float(np.log10(model.n + model.v + 1)), arrow(RESULT)
    n_train = model.n

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        at, m = left["at"].to_numpy(), left.num_rows
        sums, known = np.zeros(m), np.zeros(m, np.int64)
        for x in right["blob"].to_pylist():
            i, s, k = unpack(x, np.uint32, np.float64, np.uint32)
            sums[i] += s
            known[i] += k
        size = left["n_tokens"].to_numpy()
        base = left["counts"].to_numpy() + sums[at] - size * total
        own = left["model"].to_numpy() + sums[at]
        return pa.Table.from_batches([batch(schema, doc_id=left["doc_id"].combine_chunks(), held_out=left["held_out"].combine_chunks(), n_tokens=size, n_known=left["known"].to_numpy() + known[at], train_tokens=np.full(m, n_train), base_score=base, score=own)])

    return found.filter("bucket = -1").drop("bucket", "blob").groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(joined, RESULT)
