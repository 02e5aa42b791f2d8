"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLANK = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=BLANK):
    return pattern.findall((text or "").encode().translate(_LOWER))


def held_out(doc_id, modulus):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == 2


def lm(docs, mu, order=2):
    """(held_out, n_tokens, n_known, N, base, score) of each (doc_id, text)."""
    counts = Counter()
    tokens = [["<s>", *words(t), "</s>"] for _, t in docs]
    for (i, _), w in zip(docs, tokens, strict=True):
        if not held_out(i, 7):
            for n in range(1, order + 1):
                counts.update(tuple(w[a : a + n]) for a in range(len(w) - n + 1))
    single = {k: v for k, v in counts.items() if len(k) == 1 and k != ("<s>",)}
    total, once = sum(single.values()), sum(v == 1 for v in single.values())
    unknown = (once + 1) / (total + 2) if total else 1.0

    def p(context, w):
        if not context:
            return (1 - unknown) * counts[w,] / total if counts[w,] else unknown
        if not counts[context]:
            return p(context[1:], w)
        return (counts[(*context, w)] + mu * p(context[1:], w)) / (counts[context] + mu)

    out = []
    for (i, _), w in zip(docs, tokens, strict=True):
        own = w[1:]
        base = sum(math.log10((counts[x,] + 1) / (total + len(single) + 1)) for x in own)
        score = sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in range(1, len(w)))
        out.append((held_out(i, 7), len(own), sum(counts[x,] > 0 for x in own), total, base, score))
    return out


def contamination(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text, ALNUM)
        for a in range(max(1, len(w) - n + 1)) if w else []:
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text, ALNUM), set(), set()
        for size in {len(k) for k in windows}:
            for a in range(len(w) - size + 1):
                if (k := tuple(w[a : a + size])) in windows:
                    hit.update(range(a, a + size))
                    found |= windows[k]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def near_duplicates(docs, percent):
    sets = {}
    for i, t in docs:
        sets[i] = shingles(t)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for i in ids:
        shared = Counter(j for s in sets[i] for j in holders[s] if j > i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}
