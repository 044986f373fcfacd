"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def substrings(docs, window=13):
    first, words = {}, []
    for i, text in docs:
        w = SPACED.findall(text or "")
        words.append((i, w))
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, math.inf), math.inf if i is None else i)
    out = []
    for i, w in words:
        own, gone = math.inf if i is None else i, [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < own:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingle_sets(docs, k=5):
    out = []
    for i, text in docs:
        w = SPACED.findall((text or "").translate(LOWER))
        out.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


def near(docs, percent=75):
    sets = shingle_sets(docs)
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets]


def contamination(docs, items, window=13):
    spans = defaultdict(set)
    for item, text in items:
        w = ITEM.findall((text or "").translate(LOWER))
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if w else 0):
            spans[tuple(w[k : k + n])].add("" if item is None else str(item))
    sizes = {len(s) for s in spans}
    out = []
    for i, text in docs:
        w = ITEM.findall((text or "").translate(LOWER))
        hit, named = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := spans.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    named |= got
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def lm(docs, mass=200.0, discount=0.75, steps=20.0):
    def down(p):
        return 10 ** (-min(math.ceil(-math.log10(p) * steps), 254) / steps)

    tokens = [(i, [*SPACED.findall((t or "").translate(LOWER)), "\n"], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in docs]
    c = Counter(w for _, t, held in tokens if not held for w in t)
    pairs = Counter(p for _, t, held in tokens if not held for p in zip(["\t", *t[:-1]], t, strict=True))
    triples = Counter(p for _, t, held in tokens if not held for p in zip(["\t", *t], t, t[1:]))
    kinds = Counter(p[:2] for p in triples)
    total, learned = sum(c.values()), sum(not held for *_, held in tokens)
    space, out = total + len(c) + 1, []
    for i, t, held in tokens:
        base = sum(math.log10((c[w] + 1) / space) for w in t)
        score = 0.0
        for s, u, w in zip([None, "\t", *t], ["\t", *t], t):
            cu = learned if u == "\t" else c[u]
            p = down(pairs[u, w] / (cu + mass)) if pairs[u, w] else mass / (cu + mass) * (c[w] + 1) / space
            if triples[s, u, w]:
                p = down((triples[s, u, w] - discount) / pairs[s, u])
            elif pairs[s, u]:
                p *= down(discount * kinds[s, u] / pairs[s, u])
            score += math.log10(min(1.0, p))
        out.append((i, held, len(t), sum(c[w] > 0 for w in t), total, base, score))
    return out
