"""Suffix arrays by induced sorting and permuted common prefixes, one numpy step for each bucket of signs.

Suffixes are classified; those that are leftmost-smaller (LMS) are sorted by their substrings with one induction, named,
sorted by their names in turn, and from them all others are induced in linear time. The string of names has a large
alphabet, over which buckets are too small to work on at once; below the first level ranks are therefore doubled.
Entries move between buckets whole: what a bucket induces is what its suffixes' left
neighbours are, in order.
"""

from __future__ import annotations

import numpy as np

from gramwise.llm.tokens import BASES, Rolling

U = np.uint64
#: A byte that UTF-8 never has: it ends each string of a text.
STOP = 0xFF
SIGNS = 256


def classify(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the empty suffix is the smallest of all."""
    n = len(text)
    turn = np.append(text[1:] != text[:-1], True)
    up = np.append(text[:-1] < text[1:], False)
    # A run of one sign is as its last sign is: the place of that, from the right.
    last = np.minimum.accumulate(np.where(turn, np.arange(n), n)[::-1])[::-1]
    return up[last]


class _Induction:
    def __init__(self, text: np.ndarray, smaller: np.ndarray):
        self.text, self.smaller = text, smaller

    def _spread(self, cur: np.ndarray, to: list[list[np.ndarray]], kind: bool) -> None:
        """Put the left neighbours of the given type into the buckets of their signs, in order."""
        left = cur[cur > 0] - 1
        left = left[self.smaller[left] == kind]
        if not len(left):
            return
        signs = self.text[left]
        order = np.argsort(signs, kind="stable")
        left, signs = left[order], signs[order]
        cuts = np.concatenate(([0], np.flatnonzero(signs[1:] != signs[:-1]) + 1, [len(signs)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            to[signs[a]].append(left[a:b])

    def _drain(self, bucket: list[np.ndarray], to: list[list[np.ndarray]], kind: bool) -> None:
        """Spread what is in a bucket, and what that adds to the same bucket, until nothing comes."""
        done = 0
        while done < len(bucket):
            now = np.concatenate(bucket[done:])
            bucket[done:] = [now]
            done += 1
            self._spread(now, to, kind)

    def run(self, seeds: np.ndarray) -> np.ndarray:
        """All suffixes in the order that the order of seeds (LMS suffixes, by bucket) induces."""
        larger: list[list[np.ndarray]] = [[] for _ in range(SIGNS)]
        small: list[list[np.ndarray]] = [[] for _ in range(SIGNS)]
        signs = self.text[seeds]
        cuts = np.searchsorted(signs, np.arange(SIGNS + 1))
        larger[self.text[-1]].append(np.array([len(self.text) - 1], np.int64))
        for c in range(SIGNS):
            self._drain(larger[c], larger, False)
            self._spread(seeds[cuts[c] : cuts[c + 1]], larger, False)
        for c in range(SIGNS - 1, -1, -1):
            self._drain(small[c], small, True)
            if larger[c]:
                self._spread(np.concatenate(larger[c])[::-1], small, True)
        parts = []
        for c in range(SIGNS):
            parts += larger[c]
            if small[c]:
                parts.append(np.concatenate(small[c])[::-1])
        return np.concatenate(parts)


def _order(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of names, by ranks doubled until all differ; those that differ already rest."""
    n = len(names)
    # As many names as one number holds are compared at once to begin with.
    bits = int(names.max() + 1).bit_length()
    step = max(1, 62 // bits)
    first_key = np.zeros(n, np.int64)
    for k in range(step):
        first_key <<= bits
        first_key[: max(n - k, 0)] |= names[k:] + 1
    live = np.argsort(first_key)
    key, rank, start = first_key[live], np.empty(n, np.int64), np.zeros(n, np.int64)
    while len(live):
        # start: the place of the first with the same rank so far; the new rank is that of the first with the same key.
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        head = np.flatnonzero(np.concatenate(([True], start[1:] != start[:-1])))
        offset = np.arange(len(live)) - np.repeat(head, np.diff(np.concatenate((head, [len(live)]))))
        rank[live] = (start + offset)[first][group]
        live = live[(np.diff(np.concatenate((first, [len(live)]))) > 1)[group]]
        following = np.where(live + step < n, rank[np.minimum(live + step, n - 1)] + 1, 0)
        key = rank[live] * (n + 1) + following
        order = np.argsort(key)
        live, key = live[order], key[order]
        start, step = rank[live], step * 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _differ(text: np.ndarray, first: np.ndarray, length: np.ndarray, at: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Of substrings with the hash and length of the next in order, those that don't have its bytes."""
    out = []
    for part in np.array_split(at, max(1, -(-int(length[at].sum()) // most))):
        n = length[part]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        bad = text[np.repeat(first[part], n) + step] != text[np.repeat(first[part + 1], n) + step]
        out.append(np.unique(np.repeat(part, n)[bad]))
    return np.concatenate(out)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of a text of bytes in order."""
    n = len(text)
    smaller = classify(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    work = _Induction(text, smaller)
    if len(lms):
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        first = work.run(lms[np.argsort(text[lms], kind="stable")])
        first = first[is_lms[first]]
        # Substrings from one LMS suffix to the next, that one's sign included; the last reaches to the end.
        stop = np.concatenate((lms[1:] + 1, [n]))
        place = np.empty(n, np.int64)
        place[lms] = np.arange(len(lms))
        place = place[first]
        length = (stop - lms)[place]
        own = Rolling(text.astype(U) + U(1), BASES[0]).at(first, length)
        new = (own[1:] != own[:-1]) | (length[1:] != length[:-1])
        new[_differ(text, first, length, np.flatnonzero(~new))] = True
        names = np.empty(len(lms), np.int64)
        names[place] = np.concatenate(([0], np.cumsum(new)))
        lms = first if names.max() + 1 == len(lms) else lms[_order(names)]
    return work.run(lms)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, in the order of the text, how much it has in common with the one before it in the array, up to `most`.

    Where the left neighbours of the two agree, the value is one less than the left neighbour's; only the others are
    compared, eight signs at a time.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    own = np.arange(n)
    same = (own > 0) & (before > 0) & (text[own - 1] == text[before - 1])
    todo = np.flatnonzero(~same & (before >= 0))
    out = np.zeros(n, np.int64)
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    wide = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (n + 8,), (1,))
    a, b, got = todo, before[todo], 0
    while len(a):
        end = n - np.maximum(a, b) - got
        differ = wide[np.minimum(a + got, n)] ^ wide[np.minimum(b + got, n)]
        with np.errstate(over="ignore"):
            low = (np.bitwise_count((differ & (~differ + U(1))) - U(1)) >> 3).astype(np.int64)  # equal low bytes; 8 if all are
        low = np.minimum(low, np.maximum(end, 0))
        out[a] += low
        more = low == 8
        a, b, got = a[more], b[more], got + 8
    last = np.maximum.accumulate(np.where(same, -1, own))
    return np.clip(out[np.maximum(last, 0)] - (own - np.maximum(last, 0)), 0, most)
