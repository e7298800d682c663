"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece exactly one token can be last in the prefix's encoding. It is the one vocabulary
token that ends there and forms a valid pair with the last token of what remains before it; a pair is valid if
BPE over its bytes gives the pair back. The table of last tokens is all that is kept: reading it backwards gives
the encoding, appended bytes extend it without touching what is there, and an edit is encoded again only until
the table agrees with the old one for as many bytes as the longest token has.

`encode` runs the table for all distinct pieces of a batch of texts at once, one numpy step per prefix length.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from gramwise.llm.common import slices

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
#: Pieces up to this many bytes go through the batch table; longer ones through a table of their own, fed by an automaton
#: that finds all tokens that end at each byte.
BATCH_BYTES = 32
#: Leading bits of a hash that index the vocabulary.
BUCKET_BITS = 19
#: The bytes of text worked on at a time.
TEXT_BYTES = 2 << 20
SPACE, LETTER, NUMBER, OTHER = range(4)
KNOWN = 0x3000


class Vocabulary:
    """Ranks of a tiktoken file with what pair checks need: hashes of the tokens and the merge that made each."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        n = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * n
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks))
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate(([U(1)], np.full(2 * self.longest + 1, BASE, U))), dtype=U)
            self.hash = np.array([self._hash(t) for t in self.tokens], U)
        ids = np.array(sorted(self.ranks.values()), np.int64)
        key = self._key(self.hash[ids])
        order = np.argsort(key)
        self.sorted_hash, self.sorted_id = key[order], ids[order]
        assert (np.diff(self.sorted_hash) > 0).all(), "token hashes must differ"
        # Where the hashes with the same leading bits begin; at most `deepest` have the same.
        top = (self.sorted_hash >> U(64 - BUCKET_BITS)).astype(np.int64)
        self.bucket = np.searchsorted(top, np.arange(1 << BUCKET_BITS)).astype(np.int32)
        self.deepest = int(np.bincount(top).max())
        pad = self.deepest + 1
        self.sorted_hash = np.concatenate((self.sorted_hash, np.full(pad, self.sorted_hash[-1], U)))
        self.sorted_id = np.concatenate((self.sorted_id, np.full(pad, self.sorted_id[-1]))).astype(np.int32)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.whole = np.ones(n, bool)
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = self.merge(token, below=rank)
                if len(parts) == 2:
                    self.left[rank], self.right[rank] = parts
                else:  # no order of merges makes it
                    self.whole[rank] = False
        self.arrow = pa.array(self.tokens, pa.large_binary())

    @staticmethod
    def _hash(token: bytes) -> int:
        h = 0
        for b in token:
            h = (h * int(BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _key(h: np.ndarray) -> np.ndarray:
        """Spreads the hashes of short tokens over the leading bits."""
        with np.errstate(over="ignore"):
            h = h * U(0xBF58476D1CE4E5B9)
            return h ^ (h >> U(32))

    def merge(self, piece: bytes, below: int | None = None) -> list[int]:
        """Plain BPE: the merge of the lowest rank first, leftmost on a tie."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 62, 0))
            if best >= (1 << 62 if below is None else below):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The token of each hash, or -1."""
        h = self._key(h)
        i = self.bucket[(h >> U(64 - BUCKET_BITS)).astype(np.int64)]
        out = np.where(self.sorted_hash[i] == h, self.sorted_id[i], -1)
        for _ in range(1, self.deepest):
            i = i + 1
            if len(more := np.flatnonzero((out < 0) & (self.sorted_hash[i] <= h))):
                out[more] = np.where(self.sorted_hash[i[more]] == h[more], self.sorted_id[i[more]], -1)
        return out

    def valid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE over the bytes of a and b gives a and b: merges are undone from the last made, and a merge
        across the border that would have come before the one just undone makes the pair invalid."""
        ok = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), 1 << 62, np.int64)
        while len(at):
            with np.errstate(over="ignore"):
                across = self.find(self.hash[a] * self.power[self.lengths[b]] + self.hash[b])
            bad = (across >= 0) & (across < limit)
            ok[at[bad]] = False
            # The later merge is undone: of equal ranks, the right one; a single byte can't be undone.
            l, r = self.right[a], self.left[b]
            undo_a = (l >= 0) & ((a > b) | (r < 0))
            undo_b = ~undo_a & (r >= 0)
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, l, a), np.where(undo_b, r, b)
            go = ~bad & (undo_a | undo_b)
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return ok


    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds the tokens that BPE can give, in bytes read as code points below 256."""
        out = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if self.whole[rank]:
                out.add_word(token.decode("latin-1"), rank)
        out.make_automaton()
        return out

    @cached_property
    def merges(self) -> tuple[list[int], list[int], list[int]]:
        return self.left.tolist(), self.right.tolist(), self.lengths.tolist()

    def joins(self, a: int, b: int) -> bool:
        """`valid` for one pair."""
        left, right, _ = self.merges
        limit = 1 << 62
        while True:
            if self.ranks.get(self.tokens[a] + self.tokens[b], limit) < limit:
                return False
            undone, other = right[a], left[b]
            if undone >= 0 and (a > b or other < 0):
                limit, a = a, undone
            elif other >= 0:
                limit, b = b + 1, other
            else:
                return True


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PrefixTable:
    """The last token of every prefix of one piece, for appends and edits."""

    def __init__(self, vocab: Vocabulary, piece: bytes = b""):
        self.vocab, self.piece, self.last = vocab, b"", []
        self.pairs: dict[tuple[int, int], bool] = {}
        self.append(piece)

    def _extend(self, text: bytes, last: list[int]):
        """Append the last tokens of the prefixes that `last` lacks, one for each step."""
        size, pairs = self.vocab.merges[2], self.pairs
        begin = max(0, len(last) - self.vocab.longest + 1)
        for at, token in self.vocab.automaton.iter(text[begin:].decode("latin-1")):
            end = begin + at + 1
            if end <= len(last):
                continue
            if end > len(last) + 1:
                raise ValueError("the vocabulary lacks a byte")
            if (n := size[token]) < end:
                pair = last[end - n - 1], token
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.vocab.joins(*pair)
                if not fits:
                    continue
            last.append(token)
            yield end
        if len(last) < len(text):
            raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        self.piece += more
        for _ in self._extend(self.piece, self.last):
            pass

    def edit(self, start: int, stop: int, to: bytes) -> int:
        """Replace bytes start to stop; returns how many prefixes were worked out again."""
        text = self.piece[:start] + to + self.piece[stop:]
        last, shift, same, done = self.last[:start], len(to) - (stop - start), 0, 0
        for end in self._extend(text, last):
            done += 1
            # Token borders are equal for as long as a token can reach back: what follows is as before.
            same = same + 1 if end > start + len(to) and last[-1] == self.last[end - shift - 1] else 0
            if same >= self.vocab.longest:
                last += self.last[end - shift :]
                break
        self.piece, self.last = text, last
        return done

    def ids(self) -> list[int]:
        if self.piece in self.vocab.ranks:
            return [self.vocab.ranks[self.piece]]
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocab.tokens[out[-1]])
        return out[::-1]


def encode_pieces(vocab: Vocabulary, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of the pieces data[cuts[i]:cuts[i + 1]]. All prefixes of one length are worked out together."""
    length = np.diff(cuts)
    count, found = np.zeros(len(length), np.int64), []
    for low, high in itertools.pairwise((0, 4, 7, 10, 14, 20, BATCH_BYTES)):
        if len(own := np.flatnonzero((length > low) & (length <= high))):
            for at, row, t in _encode_rows(vocab, data, cuts[own], length[own], high):
                found.append((at, own[row], t))
                count[own[row]] += 1
    long = {i: PrefixTable(vocab, data[cuts[i] : cuts[i + 1]].tobytes()).ids() for i in np.flatnonzero(length > BATCH_BYTES).tolist()}
    for i, ids in long.items():
        count[i] = len(ids)
    stop = np.cumsum(count)
    out = np.zeros(int(stop[-1]) if len(stop) else 0, np.int64)
    for back, row, t in found:
        out[stop[row] - 1 - back] = t
    for i, ids in long.items():
        out[stop[i] - len(ids) : stop[i]] = ids
    return out, count


def _encode_rows(vocab: Vocabulary, data: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int):
    """The last tokens, then those before them, and so on: (how many follow, rows, tokens)."""
    n = len(begin)
    sums, last = np.zeros((width + 1, n), U), np.full((width + 1, n), -1, np.int32)
    with np.errstate(over="ignore"):
        for i in range(width):
            sums[i + 1] = sums[i] * BASE + data[np.minimum(begin + i, len(data) - 1)] + U(1)
        whole = vocab.find(sums[length, np.arange(n)])
        rest = np.flatnonzero(whole < 0)
        for end in range(1, width + 1):
            rest = rest[length[rest] >= end]
            todo = rest
            for size in range(min(end, vocab.longest), 0, -1):
                if not len(todo):
                    break
                t = vocab.find(sums[end, todo] - sums[end - size, todo] * vocab.power[size])
                hit = np.flatnonzero(t >= 0)
                hit = hit[vocab.whole[t[hit]]]
                if end > size and len(hit):
                    hit = hit[vocab.valid(last[end - size, todo[hit]], t[hit])]
                last[end, todo[hit]] = t[hit]
                left = np.ones(len(todo), bool)
                left[hit] = False
                todo = todo[left]
    done = np.flatnonzero(whole >= 0)
    yield 0, done, whole[done]
    live, end, back = np.flatnonzero(whole < 0), length.copy(), 0
    while len(live):
        t = last[end[live], live]
        yield back, live, t
        end[live] -= vocab.lengths[t]
        live, back = live[end[live] > 0], back + 1


class Classes:
    """Space, letter, number or other, for each code point; those past KNOWN are looked up when met."""

    def __init__(self):
        self.kinds = (regex.compile(r"\s"), regex.compile(r"\p{L}"), regex.compile(r"\p{N}"))
        self.low = np.array([self.one(c) for c in range(KNOWN)], np.uint8)

    def one(self, point: int) -> int:
        c = chr(point)
        return next((k for k, r in enumerate(self.kinds) if r.match(c)), OTHER)

    def of(self, points: np.ndarray) -> np.ndarray:
        out = self.low[np.minimum(points, KNOWN - 1)]
        if len(far := np.flatnonzero(points >= KNOWN)):
            own, back = np.unique(points[far], return_inverse=True)
            out[far] = np.array([self.one(int(p)) for p in own], np.uint8)[back]
        return out


@lru_cache(maxsize=1)
def classes() -> Classes:
    return Classes()


#: What may follow an apostrophe to make a piece of its own: fixed values of the public pattern.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def split_pieces(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, the first byte of each piece (with the end), and each text's first piece.

    The pieces are the matches of the public byte-level pattern: contractions; letters, numbers or other signs with
    one space before; white space, of which the last sign is left to what follows. They cover a text without gaps.
    """
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(points)
    ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, int)
    kind = classes().of(points)
    first = np.zeros(n + 1, bool)  # the first sign of a text
    first[np.concatenate(([0], ends)).astype(int)] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    begin = start.copy()  # of a run of one class
    # White space before something else in the same text: its last sign starts a piece, and if a space, joins what follows.
    turn = np.flatnonzero(begin[1:n] & ~first[1:n] & (kind[:-1] == SPACE) & (kind[1:] != SPACE)) + 1 if n else np.zeros(0, int)
    start[turn - 1] = True
    start[turn[points[turn - 1] == 32]] = False
    # Contractions: an apostrophe alone that starts a piece, and the ending.
    quote = np.flatnonzero((points == 39) & start[:n] & begin[1 : n + 1])
    for ending in ENDINGS:
        if not len(quote):
            break
        hit = quote + len(ending) < n
        for k, c in enumerate(ending, 1):
            at = np.minimum(quote + k, n - 1)
            hit &= (quote + k < n) & (points[at] == ord(c)) & ~first[at]
        got = quote[hit]
        start[got + 1] = False
        start[got + len(ending) + 1] = True
        quote = quote[~hit]
    start[n] = True
    width = np.ones(n, np.int8) + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    byte = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
    at = np.flatnonzero(start)
    return joined.encode(), byte[at], np.searchsorted(at, np.concatenate(([0], ends)).astype(int))


class Encoder:
    """Encodes batches of texts; each distinct piece of a batch is encoded once."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        data, cuts, firsts = split_pieces(texts)
        if len(cuts) < 2:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        own = coded.dictionary
        offsets = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, own.offset * 8)
        flat, count = encode_pieces(self.vocab, np.frombuffer(own.buffers()[2], np.uint8), offsets)
        begin = np.cumsum(count) - count
        which = coded.indices.to_numpy()
        per = count[which]
        place = np.concatenate(([0], np.cumsum(per)))
        return flat[np.arange(place[-1]) - np.repeat(place[:-1] - begin[which], per)], place[firsts]


def decode(vocab: Vocabulary, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The bytes of each run of ids."""
    data = vocab.arrow.take(pa.array(ids))
    offsets = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
    whole = memoryview(data.buffers()[2]) if len(data) else b""
    return [bytes(whole[offsets[a] : offsets[b]]) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids if asked for, ids_sha256, decoded_sha256) for every row, without a shuffle.

    A null or empty text has no tokens. Repeated rows and null ids give a row each. Other columns are not read.
    decoded_sha256 is of the bytes that decoding the ids gives.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = Encoder(path)
        number = pa.array([str(i) for i in range(len(encoder.vocab.tokens))], pa.large_string())
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens, starts = encoder(texts)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), number.take(pa.array(tokens)))
                said = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist()
                out = [part.column(0), pa.array(np.diff(starts))]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(tokens.astype(np.int32))))
                out.append(pa.array([hashlib.sha256(s.encode()).hexdigest() for s in said]))
                out.append(pa.array([hashlib.sha256(b).hexdigest() for b in decode(encoder.vocab, tokens, starts)]))
                yield pa.RecordBatch.from_arrays(out, names)

    names = [id_col, "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256"]
    schema = f"`{id_col}` {kind}, n_tokens long, {'ids array<int>, ' * ids}ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text): the texts of (id, ids). Ids that make no valid UTF-8 are decoded with replacement signs; null gives null."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            lists = batch.column(1)
            texts = [None if x is None else b"".join(vocab.tokens[t] for t in x).decode(errors="replace") for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return tokens.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")
