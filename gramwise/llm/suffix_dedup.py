"""Substring dedup of bytes by suffix arrays of shards.

Strings that can't come again are left out first: only those whose anchor, the least hash of the shorter strings inside,
comes again. The others travel with their anchor as a snippet, so equal strings meet in one shard, where equal snippets
are one; of equal snippets that a task has at hand it sends the earliest. A shard's text gets a suffix array by induced sorting and its permuted common prefixes; runs of suffixes with
100 bytes in common are the copies of a string, and all but the earliest are removed.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gramwise.llm.common import id_kind, materialise, release, slices, with_row_ids
from gramwise.llm.repeats import SENT, U, again, anchored, holds, hot_keys, least, sent, spans, told
from gramwise.llm.substring import _lists, _positions
from gramwise.llm.suffixes import STOP, common_prefixes, suffix_array
from gramwise.llm.tokens import BASES, Rolling, mix

LENGTH = 100
#: Bytes of an anchor, and of a shard's text: a shard ends with the anchor that goes past it.
GRAM, SHARD_BYTES = 40, 2 << 20
WIDTH = LENGTH - GRAM + 1


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """A 64-bit number for each byte."""
    return mix(np.arange(1, 257, dtype=U) * U(BASES[1]))


class _Slice:
    """The bytes of some texts, the hashes of their grams, and the least gram of each string that lies in one text."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        self.starts = offsets - offsets[0]
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.n = len(self.data)
        self.row = np.repeat(np.arange(n), np.diff(self.starts))
        self.roll = Rolling(byte_values()[self.data], BASES[0])
        self.valid = np.arange(self.n) + LENGTH <= self.starts[1:][self.row] if self.n else np.zeros(0, bool)
        self.grams = np.full(self.n, 0xFFFFFFFFFFFFFFFF, U)
        if self.n >= GRAM:
            self.grams[: self.n - GRAM + 1] = self.roll.at(np.arange(self.n - GRAM + 1), GRAM)
        self.lows = least(self.grams, WIDTH, self.valid)


def _first(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = _Slice(part.column(1))
                if not s.n:
                    continue
                at = anchored(s.grams, s.lows, WIDTH)
                row = s.row[at]
                yield from sent(s.grams[at], part.column(0).to_numpy()[row], at - s.starts[row])

    return rows.select("rid", "text").mapInArrow(run, SENT)


def _snippets(joined: DataFrame, hot: np.ndarray) -> DataFrame:
    """(k, rid, pos, n, snippet): neighbouring strings with one anchor, if that comes again, as the bytes that they cover.

    A very frequent anchor's strings travel each by itself. n below 0 marks the strings of a snippet that came earlier in
    the same slice of text: copies as a whole.
    """
    common = joined.sparkSession.sparkContext.broadcast(hot)
    names = ("k", "rid", "pos", "n", "snippet")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = _Slice(part.column(1))
                chosen = _positions(part.column(2), s.starts)
                at = holds(s.grams, s.lows, WIDTH, chosen) if len(chosen) else chosen
                if not len(at):
                    continue
                low = s.lows[at]
                apart = np.isin(low, common.value)
                new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | apart[1:] | apart[:-1] | (s.row[at[1:]] != s.row[at[:-1]])))
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:], [len(at)])) - 1
                begin, end = at[first], at[last] + LENGTH
                key = np.where(apart[first], mix(low[first] ^ s.roll.at(begin, LENGTH)), low[first])
                size = end - begin
                offsets = np.concatenate(([0], np.cumsum(size)))
                place = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - begin, size)
                data = s.data[place]
                snippet = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
                row = s.row[begin]
                rid, pos = part.column(0).to_numpy()[row], begin - s.starts[row]
                which = snippet.dictionary_encode().indices.to_numpy()
                order = np.lexsort((pos, rid, which))
                early = np.zeros(len(order), bool)
                early[order] = np.concatenate(([True], which[order][1:] != which[order][:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(key[early].view(np.int64)), pa.array(rid[early]), pa.array(pos[early].astype(np.int32)), pa.array(np.ones(early.sum(), np.int32)), snippet.filter(pa.array(early))], names)
                if not early.all():
                    yield told(*spans(np.repeat(rid[~early], size[~early] - LENGTH + 1), _runs(pos[~early], size[~early] - LENGTH + 1)), names=names)

    return joined.mapInArrow(run, "k long, rid long, pos int, n int, snippet binary")


def _runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """count[i] numbers from begin[i] on."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - begin, count)


def later_copies(snippets: list[bytes], rid: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rid, position) of the strings of a shard that also start earlier, each snippet being at its earliest place."""
    text = np.frombuffer(b"".join(x + bytes([STOP]) for x in snippets), np.uint8)
    size = np.fromiter(map(len, snippets), np.int64, len(snippets)) + 1
    begin = np.cumsum(size) - size
    order = suffix_array(text)
    common = common_prefixes(text, order, LENGTH)
    of = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(text)) - begin[of]
    whole = inside + LENGTH < size[of]  # LENGTH bytes before the stop
    order = order[whole[order]]
    # Between two such suffixes with LENGTH bytes in common there is none without them.
    run = np.cumsum(common[order] < LENGTH)
    r, p = rid[of[order]], pos[of[order]] + inside[order]
    by = np.lexsort((p, r, run))
    not_first = np.concatenate(([False], run[by][1:] == run[by][:-1]))
    return r[by][not_first], p[by][not_first]


def _shards(rows: DataFrame) -> DataFrame:
    """(rid, begin, stop): the starts of strings that also start earlier, as runs.

    Rows come by key and then in the order of the texts, so the first row with a snippet has its earliest place; all
    others are copies as a whole. A shard holds distinct snippets only.
    """

    def run(batches):
        held: dict[bytes, tuple[int, int, int]] = {}  # snippet: key, rid, pos of its earliest place
        size = 0

        def shard(own: dict[bytes, tuple[int, int, int]]):
            place = np.array(list(own.values()), np.int64).reshape(-1, 3)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in spans(*later_copies(list(own), place[:, 1], place[:, 2]))], ["rid", "begin", "stop"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, rid, pos, n = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            if (done := n < 0).any():
                yield pa.RecordBatch.from_arrays([pa.array(x[done]) for x in (rid, pos, pos - n)], ["rid", "begin", "stop"])
                batch = batch.filter(pa.array(~done))
                k, rid, pos = (x[~done] for x in (k, rid, pos))
                if not len(k):
                    continue
            coded = batch.column(4).dictionary_encode()
            which, own = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            first = np.full(len(own), len(which))
            np.minimum.at(first, which, np.arange(len(which)))
            new = np.array([x not in held for x in own], bool)
            copy = np.ones(len(which), bool)
            copy[first[new]] = False
            length = np.fromiter(map(len, own), np.int64, len(own))[which] - LENGTH + 1
            yield pa.RecordBatch.from_arrays([pa.array(rid[copy]), pa.array(pos[copy]), pa.array((pos + length)[copy])], ["rid", "begin", "stop"])
            for i in np.flatnonzero(new).tolist():
                at = first[i]
                held[own[i]] = (int(k[at]), int(rid[at]), int(pos[at]))
                size += len(own[i])
            if size > SHARD_BYTES:
                last = int(k[-1])  # may go on in the next batch
                done = {x: v for x, v in held.items() if v[0] != last}
                if done:
                    yield shard(done)
                    held = {x: v for x, v in held.items() if v[0] == last}
                    size = sum(map(len, held))
        if held:
            yield shard(held)

    return rows.repartition("k").sortWithinPartitions("k", "rid", "pos").mapInArrow(run, "rid long, begin long, stop long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept if asked for) for every row of docs.

    Texts are UTF-8 bytes; null counts as empty. Each byte in a string of 100 bytes that also starts earlier (in a text
    of a smaller id, or earlier in the same) is removed; strings don't cross texts and are judged on the input. Null ids
    come before all others; rows of one id are texts of their own, in the order of a digest of their texts. kept is bytes,
    as a cut may part a sign. An empty table gives no rows; other columns are not read.
    """
    rows = with_row_ids(docs, id_col, text_col)
    found = materialise(again(_first(rows)), "anchors")
    joined = rows.select("rid", "text").join(_lists(found), "rid")
    copies = materialise(_shards(_snippets(joined, hot_keys(found))), "copies")
    release(found)
    out = rows.join(_lists(copies), "rid", "left").select("id", "text", "spans")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).cast(pa.large_binary())
                n = len(texts)
                offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                starts = offsets - offsets[0]
                covered = np.zeros(len(data) + 1, np.int32)
                at = _positions(part.column(2), starts)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + LENGTH, -1)
                gone = np.cumsum(covered[:-1]) > 0
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                head[starts[:-1][starts[:-1] < len(data)]] = gone[starts[:-1][starts[:-1] < len(data)]]
                removed, heads = (np.concatenate(([0], np.cumsum(x)))[starts] for x in (gone, head))
                kept = data[~gone].tobytes()
                cut = (starts - removed).tolist()
                parts = [kept[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                cols = [part.column(0), pa.array(np.diff(starts)), pa.array(np.diff(removed)), pa.array(np.diff(heads)), pa.array([hashlib.sha256(x).hexdigest() for x in parts])]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary())] * keep_text, names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]
    return out.mapInArrow(run, f"id {id_kind(docs, id_col)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text).withColumnRenamed("id", id_col)
