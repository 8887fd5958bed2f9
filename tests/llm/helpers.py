"""Brute-force versions, straight from the definitions."""

import hashlib
import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def substring(rows, width=50):
    """(doc_id, text) -> doc_id: (n_words, n_removed, digest of what is left)."""
    docs = [(i, WORDS.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < i:
                gone[s : s + width] = [True] * width
        out[i] = len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()
    return out


def jaccard(rows, width=5):
    """(doc_id, text) -> doc_id: (n_shingles, component)."""
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    having = {}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in having[x] if j < i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def exact(rows):
    """(doc_id, text) -> doc_id: (keep_id, size)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def corpus(seed, families=4, copies=25, singles=40, vocabulary=1500):
    """Families of near and exact copies, a passage many documents share, short and empty texts, a null."""
    import random

    r = random.Random(seed)
    words = [f"w{i}" if i % 3 else f"W{i}" for i in range(vocabulary)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    texts, passage = [], some(70)
    for _ in range(families):
        base = some(r.choice((30, 90, 250)))
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, 1 + len(w) // 30)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(w + some(r.choice((0, 0, len(w) // 5))))
    for _ in range(singles):
        texts.append(some(r.randint(0, 40)) + passage[r.randint(0, 15) : r.randint(50, 70)] + some(r.randint(0, 60)))
    texts += [r.choice(texts) for _ in range(15)]
    joined = [r.choice((" ", "\n", "  ")).join(w) for w in texts] + ["", None, " \t", "a", "A", "a b c d", "é x " * 60]
    r.shuffle(joined)
    return [(3 * k + 1, t) for k, t in enumerate(joined)]
