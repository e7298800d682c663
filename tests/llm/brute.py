"""Plain versions of the operators' contracts, for small tables."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW) if lower else text)


def substring_words(rows, n=35):
    seen = Counter(tuple(w[k : k + n]) for _, t in rows for w in [words(t)] for k in range(len(w) - n + 1))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), sha256(kept.encode()).hexdigest())
    return out


def substring_bytes(rows, n=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if b[k : k + n] in seen:
                gone[k : k + n] = b"\1" * n
            seen.add(b[k : k + n])
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(text):
    w = words(text, True)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows):
    fps = {i: fingerprint(t) for i, t in rows}
    sets = Sets()
    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                sets.join(i, j)
    return {i: (f"{fps[i]:016x}", sets.find(i)) for i in fps}


def embedding_links(rows, least=0.93):
    """{id: (links, component)} of rows (id, vector, label) with good vectors."""
    sets, links = Sets(), Counter()
    unit = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float)), g) for i, v, g in rows]
    for a in range(len(unit)):
        for b in range(a + 1, len(unit)):
            if unit[a][2] == unit[b][2] and float(unit[a][1] @ unit[b][1]) >= least:
                links[unit[a][0]] += 1
                links[unit[b][0]] += 1
                sets.join(unit[a][0], unit[b][0])
    return {i: (links[i], sets.find(i)) for i, _, _ in rows}


def good_turing(counts, large=5):
    """What each count up to large is multiplied with, by Katz's formula from how many things have each count."""
    n = Counter(counts)
    if not n[1]:
        return [1.0] * large
    share = (large + 1) * n[large + 1] / n[1]
    out = []
    for r in range(1, large + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if n[r] and share < 1 else 1.0
        out.append(d if 0 < d < 1 else 1.0)
    return out


def kneser_ney(texts_with, order):
    """The function word -> log ratio of two spelling models, from {word: (toxic texts, ordinary texts)}."""
    from math import log

    spelled = {w: ["<", *w, ">"] for w in texts_with}
    pooled = [Counter() for _ in range(order)]  # by length, how often a run of signs comes
    top = [Counter(), Counter()]
    for w, s in spelled.items():
        for e in range(1, len(s)):
            for j in (0, 1):
                if texts_with[w][j]:
                    top[j][tuple(s[max(0, e - order + 1) : e + 1])] += texts_with[w][j]
            for k in range(1, min(order - 1, e + 1) + 1):
                pooled[k][tuple(s[e - k + 1 : e + 1])] += sum(texts_with[w])
    counts = [Counter() for _ in range(order)]
    for k in range(1, order):
        for g, n in pooled[k].items():
            counts[k][g] = n
    for k in range(1, order - 1):
        kinds = Counter(x[1:] for x in pooled[k + 1])
        for g in counts[k]:
            if g[0] != "<":
                counts[k][g] = kinds[g]

    def taken(values):
        ones, twos = values.count(1), values.count(2)
        return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    cut = [taken(list(c.values())) for c in counts]
    totals, types = [Counter() for _ in counts], [Counter() for _ in counts]
    for k, c in enumerate(counts):
        for g, n in c.items():
            totals[k][g[:-1]] += n
            types[k][g[:-1]] += 1

    def shared(g):
        if not g:
            return 1 / len(counts[1])
        k, low = len(g), shared(g[1:])
        t = totals[k][g[:-1]]
        return (max(counts[k][g] - cut[k], 0) + cut[k] * types[k][g[:-1]] * low) / t if t else low

    class_cut = [taken(list(c.values())) for c in top]

    def own(j, g):
        t = sum(n for x, n in top[j].items() if x[:-1] == g[:-1])
        kinds = sum(1 for x in top[j] if x[:-1] == g[:-1])
        low = shared(g[1:])
        return (max(top[j][g] - class_cut[j], 0) + class_cut[j] * kinds * low) / t if t else low

    def ratio(w):
        s = ["<", *w, ">"]
        grams = [tuple(s[max(0, e - order + 1) : e + 1]) for e in range(1, len(s))]
        return sum(log(own(0, g) / own(1, g)) for g in grams)

    return ratio


def katz(rows, train, least=2, large=5):
    """{id: (n_tokens, n_known, base, score)} and the number of training tokens."""
    from math import log10

    texts = {i: [*words(t, True), None] for i, t in rows}
    one, two = Counter(), defaultdict(Counter)
    for i in train:
        h = "<s>"
        for w in texts[i]:
            one[w] += 1
            two[h][w] += 1
            h = w
    n, v = sum(one.values()), len(one)
    d1 = good_turing(one.values())
    d2 = good_turing(c for f in two.values() for c in f.values())
    cut = lambda c, d: c * d[c - 1] if c <= large else c
    kept = sum(c - cut(c, d1) for c in one.values())
    n_all = n if kept > 1e-12 else n + 0.5
    p = lambda w: cut(one[w], d1) / n_all if w in one else (kept if kept > 1e-12 else 0.5) / n_all

    def context(h):
        f = {w: c for w, c in two.get(h, {}).items() if c >= least}
        if not f:
            return {}, 1.0
        total, mass = sum(two[h].values()), sum(cut(c, d2) for c in f.values())
        scale = min(1, (total - 0.5) / mass) / total
        return {w: cut(c, d2) * scale for w, c in f.items()}, (1 - mass * scale) / (1 - sum(p(w) for w in f))

    out = {}
    for i, t in texts.items():
        h, score = "<s>", 0.0
        for w in t:
            f, alpha = context(h)
            score += log10(f[w]) if w in f else log10(alpha) + log10(p(w))
            h = w
        out[i] = (len(t), sum(w in one for w in t), sum(log10((one[w] + 1) / (n + v + 1)) for w in t), score)
    return out, n


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """{source: target} of {source: size}: shared by weight; what goes past cap times the size is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in sorted(open_, key=order.index):
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
        open_ = {s for s in open_ if target[s] < cap * sizes[s]}
    return target
