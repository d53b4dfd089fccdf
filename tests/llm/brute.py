"""Plain restatements of the operators' results, for comparison."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaks(documents, benchmark, n=10):
    windows = {}
    for item, text in benchmark:
        w = WORD.findall((text or "").translate(AZ))
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    sizes = sorted({len(x) for x in windows})
    out = []
    for doc, text in documents:
        w = WORD.findall((text or "").translate(AZ))
        hit, items = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i:i + size]))) is not None:
                    hit.update(range(i, i + size))
                    items |= found
        ids = sorted(str(x) for x in items if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def line_dedup(documents, min_docs=3, min_chars=20):
    def key(line):
        k = line.strip(" \t\n\r\x0b\x0c").translate(AZ)
        return k if len(k) >= min_chars else None
    docs, top = {}, {}
    for doc, text in documents:
        for k in {key(x) for x in (text or "").split("\n")} - {None}:
            docs[k] = docs.get(k, 0) + 1
            if doc is not None:
                top[k] = max(top.get(k, doc), doc)
    out = []
    for doc, text in documents:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := key(x)) is None or docs[k] < min_docs or k not in top
                or doc is not None and doc >= top[k]]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def fingerprint(text, shingle=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(AZ)) if w]
    if not words:
        return 0
    k = min(shingle, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, near):
    """Smallest id reachable for each (id, value), by near(value, value)."""
    parent = list(range(len(nodes)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(nodes)):
        for j in range(i):
            if near(nodes[i][1], nodes[j][1]):
                parent[top(i)] = top(j)
    low = {}
    for i, (doc, _) in enumerate(nodes):
        if doc is not None:
            low[top(i)] = min(low.get(top(i), doc), doc)
    return [low.get(top(i)) for i in range(len(nodes))]


def waterfill(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by the rule as stated: cap, reshare the excess by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        rest = total - sum(stopped.values())
        free = [s for s in names if s not in stopped]
        target = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return stopped | target
        stopped |= {s: cap * sizes[s] for s in over}
