"""N-gram Jaccard join of whole documents by T-occurrence search.

Documents of equal shingle sets are one node, so copies cost one. A node's shingles are ordered
from rare to frequent by a counting sketch of fixed size over all documents (any one order is right, so the
sketch need not be exact). The rarest common shingle of two sets that reach the percentage stands among the first
n - overlap + 1 of either, for its size n and the overlap that the two sizes need. So only these places are
posted to inverted lists, and two members of a list are a candidate pair only where both stand early enough for
each other's size: sets that share a common passage or a distant source are never paired.

Members of a list are first compared with the one of like size that shares most, as leader. Once links have made
components, only pairs of different components are left, and each has a member outside its list's main component.
No link is lost that would join two components.

A comparison is a search: the sets of a block of a leader's candidates are indexed by shingle, the leader is the
query, and DivideSkip heap-merges its short lists and probes the long ones by binary search, keeping the sets
that reach the overlap. Blocks have BLOCK candidates; a leader with more has several. Shingles that the sketch counts
HOT times or more aren't gathered by bucket: their postings stay rows, which joins may split.
"""

from __future__ import annotations

from functools import reduce
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, U64, blocks, mix, owned, whole, windows
from .components import components
from .flow import arrow, batch, cut, documents, n_buckets, pack, ranges_by_bucket, unpack

WORDS, PERCENT, BLOCK, HOT = 5, 80, 400, 1 << 16
CELLS, PARTS = 1 << 22, 64
#: So many rows of ids are broadcast at most (under 200 MB); beyond that texts are shuffled to them.
BROADCAST = 3_000_000


def sets_of(block, n: int):
    """For each text its sorted distinct shingles' hashes; fewer words than n are one shingle."""
    h = block.hashes()
    all_, at = windows(h, n), owned(block.first, n)
    all_ = all_[at]
    edge = np.searchsorted(block.text[at], np.arange(block.n_texts + 1))
    short = whole(h, block.first)
    for t, count in enumerate(block.count):
        if count < n:
            yield short[t : t + 1] if count else all_[:0]
        else:
            s = np.sort(all_[edge[t] : edge[t + 1]])
            yield s[np.r_[True, s[1:] != s[:-1]]]


def node_of(s: np.ndarray) -> int:
    """A name of a set: a 64-bit hash that doesn't depend on order."""
    return int(mix(mix(s).sum(keepdims=True) + U64(len(s))).view(np.int64)[0])


def prefix(n: int, percent: int) -> int:
    """How many of a set's n rarest shingles have inverted lists: up to the last place a first common one can have."""
    return n - -(-percent * n // 100) + 1


def overlap(n: int, m: int, percent: int) -> int:
    """The least intersection of sets of n and m for percent of their union."""
    return -(-percent * (n + m) // (100 + percent))


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> U64(42)).astype(np.int64)


def _level(counts: np.ndarray) -> np.ndarray:
    """Four levels for each power of two of the counts."""
    return np.minimum(4 * np.log2(counts + 1.0), 255).astype(np.uint8)


def _surveyed(n: int):
    """A row for each document, then the partition's counts of shingles by cell, compressed, in PARTS slices."""
    kinds = pa.schema([("part", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("size", pa.int64())])

    def run(batches):
        cells = np.zeros(CELLS, np.uint32)
        for b in batches:
            node, size = [], []
            for _, _, block in blocks(b["text"], SPACED, True):
                found = list(sets_of(block, n))
                size += [len(s) for s in found]
                node += [node_of(s) if len(s) else None for s in found]
                if found:
                    cells += np.bincount(_cells(np.concatenate(found)), minlength=CELLS).astype(np.uint32)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([-1] * m, pa.int32()), pa.nulls(m, pa.binary()), b["doc_id"], b["key"], pa.array(node, pa.int64()), pa.array(size, pa.int64())], schema=kinds)
        rows = [(k, pa.compress(x.tobytes(), "zstd", asbytes=True)) for k, x in enumerate(cells.reshape(PARTS, -1)) if x.any()]
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), none, none, none, none], schema=kinds)

    return run


def _summed(batches):
    """The cells' levels from the sums of all partitions' counts; a part's counts all come to one task."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, blob in zip(b["part"].to_pylist(), b["blob"].to_pylist(), strict=True):
            x = np.frombuffer(pa.decompress(blob, 4 * CELLS // PARTS, "zstd", asbytes=True), np.uint32)
            total.setdefault(part, np.zeros(CELLS // PARTS, np.uint64))[:] += x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_level(x).tobytes() for x in total.values()], pa.binary())], names=["part", "blob"])


_POSTED = "bucket int, blob binary, list long, weight long, node long, size long, pos long"


def _postings(n: int, percent: int, buckets: int, levels, hot: int):
    """Packed postings (shingle, node, size, place) by bucket; those of hot shingles as rows without a bucket."""
    least, schema = int(_level(np.array([hot]))[0]), arrow(_POSTED.replace(", ", ","))

    def run(batches):
        for b in batches:
            for _, _, block in blocks(b["text"], SPACED, True):
                level, done, parts = levels.value, set(), []
                for s in sets_of(block, n):
                    if not len(s) or (node := node_of(s)) in done:
                        continue
                    done.add(node)
                    rare, k = (level[_cells(s)].astype(U64) << U64(56)) | (s >> U64(8)), prefix(len(s), percent)
                    first = np.argpartition(rare, k - 1)[:k] if k < len(s) else np.arange(k)
                    first = first[np.argsort(rare[first])]
                    parts.append((s[first], np.full(k, node, np.int64), np.full(k, len(s), np.uint32), np.arange(k, dtype=np.uint32)))
                if parts:
                    h, node, size, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(h, kind="stable")
                    h, node, size, pos = h[order], node[order], size[order], pos[order]
                    is_hot = level[_cells(h)] >= least
                    m = int(is_hot.sum())
                    if m:
                        yield batch(schema, bucket=pa.nulls(m, pa.int32()), blob=pa.nulls(m, pa.binary()), list=h[is_hot].view(np.int64), weight=np.ones(m, np.int64), node=node[is_hot], size=size[is_hot], pos=pos[is_hot])
                        h, node, size, pos = h[~is_hot], node[~is_hot], size[~is_hot], pos[~is_hot]
                    rows = [(k, pack(h[i:j], node[i:j], size[i:j], pos[i:j])) for k, i, j in ranges_by_bucket(h, buckets)]
                    none = pa.nulls(len(rows), pa.int64())
                    yield batch(schema, bucket=[r[0] for r in rows], blob=[r[1] for r in rows], **dict.fromkeys(schema.names[2:], none))

    return run


def _partnered(size: np.ndarray, pos: np.ndarray, of: np.ndarray, percent: int) -> np.ndarray:
    """Members of lists (of: which, ascending) whose place is early enough for another member of like size."""
    key = np.sort(of * (1 << 40) + size)
    low, high = -(-percent * size // 100), np.minimum(100 * size // percent, (100 + percent) * (size - pos) // percent - size)
    found = np.searchsorted(key, of * (1 << 40) + high, "right") - np.searchsorted(key, of * (1 << 40) + low)
    return found > (high >= size)  # without the member itself


def _lists(percent: int):
    return lambda table: _listed(table, percent)


def _listed(table: pa.Table, percent: int) -> pa.Table:
    """The inverted lists of two nodes or more.

    Of lists with the same members one stays, that of the rarest shingle, with their number: shingles have one
    order, so it has the least place of each member. first: the place of the first member, by which that one is known.
    Members that no other one suits are left out then.
    """
    parts = [unpack(x, U64, np.int64, np.uint32, np.uint32) for x in table["blob"].to_pylist()]
    h, node, size, pos = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((node, h))
    h, node, size, pos = h[order], node[order], size[order], pos[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]
    h, node, size, pos = h[new], node[new], size[new], pos[new]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    end = np.r_[start[1:], len(h)]
    name = np.add.reduceat(mix(node.view(U64)), start)
    keep = end - start > 1
    start, end, name = start[keep], end[keep], name[keep]
    order = np.lexsort((pos[start], name))
    start, end, name = start[order], end[order], name[order]
    one = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.zeros(0, np.int64)
    many = np.diff(np.r_[one, len(name)])
    start, end, name = start[one], end[one], name[one]
    length = end - start
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    of = np.repeat(np.arange(len(start)), length)
    good = _partnered(size[at].astype(np.int64), pos[at].astype(np.int64), of, percent)
    at, edge = at[good], np.searchsorted(of[good], np.arange(len(start) + 1))
    members = [pack(node[at[i:j]], size[at[i:j]], pos[at[i:j]]) for i, j in zip(edge, edge[1:], strict=False)]
    return pa.table({"list": pa.array(name.view(np.int64), pa.int64()), "weight": pa.array(many, pa.int64()), "first": pa.array(pos[start], pa.int64()), "members": pa.array(members, pa.binary())})


def _members(batches):
    for b in batches:
        parts = [unpack(x, np.int64, np.uint32, np.uint32) for x in b["members"].to_pylist()]
        if parts:
            many = [len(p[0]) for p in parts]
            cols = [np.repeat(b[c].to_numpy(), many) for c in ("list", "weight")] + [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["list", "weight", "node", "size", "pos"])


def inverted(rows: DataFrame, words: int, percent: int, level: np.ndarray, hot: int) -> DataFrame:
    """list, node, size, pos, band, alone of every posting; alone: the lower, the more of its places others have, as the source of copies."""
    posted = rows.select("text").mapInArrow(_postings(words, percent, n_buckets(rows.sparkSession), rows.sparkSession.sparkContext.broadcast(level), hot), _POSTED)
    if any_hot := bool((level >= _level(np.array([hot]))[0]).any()):
        posted = cut(posted)
    lists = posted.filter("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_lists(percent), "list long, weight long, first long, members binary")
    lists = lists.groupBy("list").agg(F.sum("weight").alias("weight"), F.min_by("members", "first").alias("members"))
    members = lists.mapInArrow(_members, "list long, weight long, node long, size long, pos long")
    if any_hot:
        members = members.union(posted.filter("bucket is null").select(*members.columns).distinct())
    members = cut(members)
    shared = members.groupBy(F.col("node").alias("n")).agg((-F.sum("weight") / F.first("size")).cast("float").alias("alone"))
    band = F.floor(F.log("size") / float(np.log(100 / percent)) + 1e-9).cast("int").alias("band")  # members of like size are in one or in neighbours
    return cut(members.join(shared, F.col("node") == F.col("n")).select("list", "node", F.col("size").cast("int").alias("size"), F.col("pos").cast("int").alias("pos"), band, "alone"))


def _like(a: str, b: str, percent: int):
    """Whether the postings a and b of one list may be the first common shingle of sets that reach the percentage."""
    both = F.expr(f"cast(ceil({percent}L * ({a}.size + {b}.size) / {100 + percent}) as bigint)")
    return (both <= F.col(f"{a}.size") - F.col(f"{a}.pos")) & (both <= F.col(f"{b}.size") - F.col(f"{b}.pos")) & F.expr(f"100 * least({a}.size, {b}.size) >= {percent} * greatest({a}.size, {b}.size)")


def led(members: DataFrame, percent: int) -> DataFrame:
    """(leader, other): the member of each list and band that shares most, with all of its own and the neighbouring bands."""
    best = members.groupBy("list", "band").agg(F.min(F.struct("alone", "node", "size", "pos")).alias("best")).select("list", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "best.node", "best.size", "best.pos")
    pairs = best.alias("a").join(members.alias("b"), ["list", "band"]).filter((F.col("a.node") != F.col("b.node")) & _like("a", "b", percent))
    return pairs.select(F.col("a.node").alias("leader"), F.col("b.node").alias("other")).distinct()


def across(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(leader, other) of all candidate pairs in different components; one of each is outside the component of its list's leader."""
    named = labels.select(F.col("node").alias("n"), "component")
    labelled = members.join(named, F.col("node") == F.col("n"), "left").select(*members.columns, F.coalesce("component", "node").alias("component"))
    of_list = labelled.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", F.struct("alone", "node")).alias("main"), F.min("size").alias("least")).filter("low < high").select(F.col("list").alias("l"), "main", "least")
    # A place is early enough only for sizes up to this; who is too late for the smallest member has no partner.
    most = F.expr(f"({100 + percent}L * (size - pos) div {percent}) - size")
    left = labelled.join(of_list, F.col("list") == F.col("l")).filter(most >= F.col("least")).drop("l", "least", "alone")
    bands = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    few = left.filter("component <> main").select("list", bands, "node", "size", "pos", "component")
    both = few.alias("a").join(left.alias("b"), ["list", "band"]).filter((F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))) & _like("a", "b", percent))
    return both.select(F.col("a.node").alias("leader"), F.col("b.node").alias("other")).distinct()


class Index:
    """Inverted lists of some sets: which sets hold each element, by place."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, U64)
        order = np.argsort(every, kind="stable")
        self.who = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.elements, self.start = np.unique(every[order], return_index=True)
        self.end = np.r_[self.start[1:], len(every)]

    def lists(self, query: np.ndarray) -> list[np.ndarray]:
        """The lists of the query's elements, short ones first."""
        if not len(self.elements):
            return []
        at = np.minimum(np.searchsorted(self.elements, query), len(self.elements) - 1)
        at = at[self.elements[at] == query]
        return sorted((self.who[i:j] for i, j in zip(self.start[at], self.end[at], strict=True)), key=len)


def divide_skip(query: np.ndarray, index: Index, percent: int = PERCENT) -> list[int]:
    """Which of the index's sets reach the percentage with the query: T-occurrence over its inverted lists.

    No set reaches it with fewer than `least` common elements. The longest lists, fewer than that, are put aside; a heap
    merges the others, and sets that could still reach their overlap are looked for in the long ones by binary search.
    """
    lists, least = index.lists(query), -(-percent * len(query) // 100)
    if len(lists) < least:
        return []
    long = min(least - 1, int(least / (0.01 * np.log2(max(2, len(lists[-1]))) + 1)))
    short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
    merged = [(i, sum(1 for _ in same)) for i, same in groupby(merge(*(x.tolist() for x in short)))]
    who, count = (np.array(x, np.int64) for x in zip(*merged, strict=True)) if merged else (np.zeros(0, np.int64),) * 2
    need = -(-percent * (len(query) + index.sizes[who]) // (100 + percent))
    for k, x in enumerate(probed):
        alive = count + len(probed) - k >= need
        who, count, need = who[alive], count[alive], need[alive]
        if not len(who):
            break
        at = np.minimum(np.searchsorted(x, who), len(x) - 1)
        count = count + (x[at] == who)
    return who[count >= need].tolist()


def _searched(n: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links of a leader (its row has no other) with a block of others."""
        column, other = table["text"].combine_chunks(), table["other"].to_pylist()
        sets = [s for _, _, block in blocks(column, SPACED, True) for s in sets_of(block, n)]
        query = next((s for s, o in zip(sets, other, strict=True) if o is None), None)
        found = [(o, s) for s, o in zip(sets, other, strict=True) if o is not None]
        if query is None or not found:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        linked = [found[i][0] for i in divide_skip(query, Index([s for _, s in found]), percent)]
        return pa.table({"a": pa.array([table["leader"][0].as_py()] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return run


def _small(ids: DataFrame, limit: int) -> DataFrame:
    """Written rows of ids, to be broadcast if they are few enough."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int, limit: int) -> DataFrame:
    """The pairs that are links. texts: (node, text) of every node in them. No more than `limit` pairs are broadcast."""
    size = pairs.groupBy(F.col("leader").alias("l")).agg(F.count("*").alias("m")).select("l", F.ceil(F.col("m") / BLOCK).cast("long").alias("parts"))
    dealt = pairs.join(size, F.col("leader") == F.col("l")).select("leader", F.pmod(F.xxhash64("other"), "parts").alias("part"), "other", F.col("other").alias("of"))
    blocks_ = size.select(F.col("l").alias("leader"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("other"), F.col("l").alias("of"))
    rows = texts.join(_small(cut(dealt.union(blocks_)), limit), F.col("node") == F.col("of")).select("leader", "part", "other", "text")
    return rows.groupBy("leader", "part").applyInArrow(_searched(n, percent), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hot: int = HOT, limit: int = BROADCAST) -> DataFrame:
    """doc_id, key, n_shingles, component_id of every document; key is a hash of the text.

    Documents without words or text are linked with nothing and are their own component. Repeated rows
    give a row each, of one component. A component of null ids only has none. Other columns are ignored.
    Up to `limit` rows of ids are broadcast to the texts; more are joined by a shuffle, with the same result.
    """
    spark = docs.sparkSession
    rows = documents(docs).withColumn("key", F.xxhash64("text"))
    survey = cut(rows.mapInArrow(_surveyed(words), "part int, blob binary, doc_id long, key long, node long, size long"))
    total = survey.filter("part >= 0").select("part", "blob").repartition("part").mapInArrow(_summed, "part int, blob binary").collect()  # a byte for each of CELLS
    level = np.zeros(CELLS, np.uint8)
    for r in total:
        level[r.part * (CELLS // PARTS) : (r.part + 1) * (CELLS // PARTS)] = np.frombuffer(r.blob, np.uint8)
    each = survey.filter("part < 0").select("doc_id", "key", "node", "size")

    members = inverted(rows, words, percent, level, hot)
    pairs = cut(led(members, percent))
    # Texts are read once: for leaders and led, and for all that would be compared if these pairs were the links.
    # Any other pair that is compared later lies within a component of these pairs.
    more = across(members, components(pairs.select(F.col("leader").alias("a"), F.col("other").alias("b"))), percent)
    nodes = reduce(DataFrame.union, [x.select(F.col(c).alias("node")) for x in (pairs, more) for c in ("leader", "other")]).distinct()
    of_node = each.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("one"), F.min("doc_id").alias("least"))
    row = F.xxhash64("doc_id", "key")
    wanted = cut(nodes.join(of_node, "node").select("node", "one.*").select("node", row.alias("wanted")))
    texts = cut(rows.withColumn("row", row).join(_small(wanted, limit), F.col("row") == F.col("wanted")).dropDuplicates(["row"]).select("node", "text"))

    links = cut(_verified(pairs, texts, words, percent, limit))
    rest = cut(across(members, components(links), percent))
    if not rest.isEmpty():
        links = cut(links.union(_verified(rest, texts, words, percent, limit)))
    labels = components(links)
    least = of_node.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least")
    named = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    return each.join(named, "node", "left").select("doc_id", "key", F.col("size").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """All columns of one document of each component, that of least doc_id; of repeated rows one.

    Documents without words or text are components of their own and stay. Columns may have any names.
    """
    kept = near_duplicates(docs, words, percent).filter("doc_id <=> component_id").select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct()
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    return keyed.join(kept, F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).dropDuplicates(["id", "key"]).select("doc.*")
