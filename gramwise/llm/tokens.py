"""Words of whole texts as Arrow and numpy arrays: the common first step of the operators on words.

A word is a maximal run of bytes other than space and 0x09-0x0D. A null text has none.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Odd bases of the two polynomial families, and the seeds of the word hashes under them.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Words(NamedTuple):
    flat: pa.Array  # the words of all rows
    starts: np.ndarray  # row i has words starts[i] to starts[i + 1]

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def words(texts: pa.Array, lower: bool = False) -> Words:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower and len(texts):  # ascii_lower needs an array that starts its own buffers, which a slice doesn't
        texts = texts.take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    keep = pc.binary_length(flat).to_numpy() > 0
    before = np.concatenate(([0], np.cumsum(keep)))
    return Words(flat.filter(pa.array(keep)).cast(pa.large_string()), before[offsets - offsets[0]])


def word_hashes(flat: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each word; each distinct word of the batch is hashed once."""
    if not len(flat):
        return np.zeros(0, U)
    coded = flat.dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in coded.dictionary.to_numpy(zero_copy_only=False)), U, len(coded.dictionary))
    return own[coded.indices.to_numpy()]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), U)
    done, step = 1, U(base)
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done, step = done + take, step * step
    return out


class Rolling:
    """Hashes of windows of any length over one array of hashes, modulo 2**64.

    A window's hash depends on its contents only. Windows are the caller's: they must not cross rows.
    """

    def __init__(self, values: np.ndarray, base: int):
        with np.errstate(over="ignore"):
            n = len(values)
            self.inverse = powers(pow(base, -1, 1 << 64), n + 1)
            self.sums = np.zeros(n + 1, U)
            np.cumsum(values * powers(base, n + 1)[:n], out=self.sums[1:])

    def at(self, starts: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[starts + length] - self.sums[starts]) * self.inverse[starts])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads what the polynomial leaves in the low bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))
