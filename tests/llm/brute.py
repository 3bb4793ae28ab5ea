"""Plain versions of the operators' contracts, word by word, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def fold(doc_id, by: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % by


def personal(rows):
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
    }
    for doc, text in rows:
        found = [(m.start(), k, kind, m.end()) for k, (kind, (p, good)) in enumerate(checks.items()) for m in re.finditer(p, text or "") if good(m.group(), re.sub("[^0-9]", "", m.group()))]
        n = Counter(f[2] for f in found)
        yield doc, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)))


def shingles(text, n: int = 5) -> frozenset:
    w = SPACED.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_duplicates(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        seen = Counter(j for g in s for j in lists[g])
        for j, both in seen.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
        for g in s:
            lists[g].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)]


def contamination(rows, items):
    known = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        if w and item is not None:
            k = min(13, len(w))
            for i in range(len(w) - k + 1):
                known[tuple(w[i : i + k])].add(str(item))
    sizes = {len(k) for k in known}
    for doc, text in rows:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, who = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in known:
                    hit.update(range(i, i + k))
                    who |= known[tuple(w[i : i + k])]
        yield doc, len(w), len(hit), len(who), sha(",".join(sorted(who))), bool(hit) and 20 * len(hit) >= len(w)


def base_scores(rows):
    toks = [[*SPACED.findall((t or "").translate(LOWER)), None] for _, t in rows]
    c = Counter(w for (doc, _), t in zip(rows, toks, strict=True) if fold(doc, 7) != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for (doc, _), t in zip(rows, toks, strict=True):
        yield doc, fold(doc, 7) == 2, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)


def repeats(rows, k: int = 35):
    words = [SPACED.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        yield doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def spellings(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    letters = {c for w in n for c in w}
    near, form = {}, {}
    for w in n:
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
        other = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} - {w}
        near[w] = [x for x in cut | other | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} if x in n]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, n[w], len(near[w]), n.get(form[w])


def allen(sales, lines, clicks):
    """(sale_id, relation, pairs, shared slots, sum of crc32) by all pairs; times are whole microseconds."""
    slot, gap = 21_600_000_000, 900_000_000
    by = defaultdict(list)
    for ts, client, kind in clicks:
        if ts is not None and client is not None:
            by[client].append((ts, kind == "error"))
    visits = []
    for client, times in by.items():
        times.sort()
        for i, (t, _) in enumerate(times):
            if i == 0 or t - times[i - 1][0] > gap:
                visits.append([client, t, t])
            visits[-1][2] = t
    out = defaultdict(list)
    for sale, client, status, sold in dict.fromkeys(sales):
        if client is None or sold is None:
            continue
        a, b = sold // slot, max([sold, *(t for s, t in lines if s == sale and s is not None and t is not None)]) // slot
        b = math.inf if status == "open" else b
        for who, first, last in visits:
            if who == client:
                c, d = first // slot, math.inf if (last, True) in by[who] else last // slot
                if a <= d and c <= b:
                    names = ("overlaps finished_by contains", "starts equals started_by", "during finishes overlapped_by")
                    kind = names[(a > c) - (a < c) + 1].split()[(b > d) - (b < d) + 1]
                    out[sale, kind].append((None if b == d == math.inf else min(b, d) - max(a, c) + 1, zlib.crc32(str(first).encode())))
    return [(s, k, len(x), None if x[0][0] is None else sum(y for y, _ in x), sum(z for _, z in x)) for (s, k), x in out.items()]
