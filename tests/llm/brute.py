"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring(rows, window=50):
    """rows: (doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256)."""
    first: dict = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def near(rows, k=4, num=80):
    """rows: (doc_id, text) -> (doc_id, n_shingles, component_id, kept)."""
    sets = {}
    for doc, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    post = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            post[x].append(d)
    for d in sorted(sets):
        shared = defaultdict(int)
        for x in sets[d]:
            for e in post[x]:
                if e > d:
                    shared[e] += 1
        for e, n in shared.items():
            if 100 * n >= num * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]


def lines(rows):
    """rows: (doc_id, text) -> (doc_id, n_lines, n_dropped, kept_sha256)."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    seen = defaultdict(set)
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                seen[key(x)].add(doc)
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= 10 and len(seen[key(x)]) > 1 and min(seen[key(x)]) != doc)]
        out.append((doc, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """rows: (doc_id, text, source) -> how often each row is taken, by Pareto order sampling after whole copies."""
    sizes = [len(words(t)) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    of = {s: [i for i, r in enumerate(rows) if r[2] == s] for s in sources}
    total = {s: sum(sizes[i] for i in of[s]) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, left = {}, set(sources)
    while left:
        level = (share * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if most * total[s] < weight[s] * level}
        if not full:
            target |= {s: weight[s] * level for s in left}
            break
        target |= {s: float(most * total[s]) for s in full}
        left -= full
    out = Counter()
    for s in sources:
        if not total[s]:
            continue
        sure = min(math.floor(target[s] / total[s]), most)
        rest = max(target[s] - sure * total[s], 0.0)
        part, order = rest / total[s], []
        for i in of[s]:
            d, t, _ = rows[i]
            u = (int(hashlib.md5(":".join(x for x in (None if d is None else str(d), t) if x is not None).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            out[rows[i]] += sure
            if sizes[i] and rest > 0:
                order.append((u / (1 - u) / (part / (1 - part) * math.sqrt(sizes[i] * len(of[s]) / total[s])), d, u, i))
        ahead = 0
        for *_, i in sorted(order):
            out[rows[i]] += ahead + sizes[i] / 2 <= rest
            ahead += sizes[i]
    return +out
