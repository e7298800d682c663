"""Substring dedup of words by level-wise doubling.

Runs of `FIRST` words are looked at first, at the anchors of the windows wanted. Windows whose anchor alone came again
are candidates: they are extended to runs of twice the length, again at anchors, and those that come again alone to the
next, until the whole window is reached or no candidates survive. At the last level windows are compared whole. Words
are compared as hashes, windows by two that are independent: 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gramwise.llm.common import id_kind, materialise, release, slices, with_row_ids
from gramwise.llm.repeats import SENT, U, again, anchored, holds, hot_keys, least, sent, sent_windows
from gramwise.llm.tokens import BASES, Rolling, mix, word_hashes, words

WINDOW = 35
#: The words of a run at the first level; each level has twice the one before, the last the window.
FIRST = 9


def _grams(roll: Rolling, n: int, length: int) -> np.ndarray:
    """Hashes of the runs of `length` words from each of n words; those past the end are of no use to a valid window."""
    out = np.full(n, 0xFFFFFFFFFFFFFFFF, U)
    if n >= length:
        out[: n - length + 1] = roll.at(np.arange(n - length + 1), length)
    return out


class _Slice:
    """The words of some texts, their hashes under two families, and which windows lie in one text."""

    def __init__(self, texts: pa.Array):
        self.words = words(texts)
        self.rolls = [Rolling(word_hashes(self.words.flat, seed), base) for seed, base in enumerate(BASES)]
        self.n, s = len(self.words.flat), self.words.starts
        self.row = self.words.rows
        self.valid = np.arange(self.n) + WINDOW <= s[1:][self.row] if self.n else np.zeros(0, bool)

    def candidates(self, spans: pa.Array, length: int) -> np.ndarray:
        """Whether each window has its anchor of `length` words at one of the places in spans."""
        chosen, out = _positions(spans, self.words.starts), np.zeros(self.n, bool)
        if len(chosen):
            grams, lows, width = self.level(length)
            out[holds(grams, lows, width, chosen)] = True
        return out

    def level(self, length: int) -> tuple[np.ndarray, np.ndarray, int]:
        width = WINDOW - length + 1
        grams = _grams(self.rolls[0], self.n, length)
        return grams, least(grams, width, self.valid), width


def _level(texts: DataFrame, length: int, before: int | None) -> DataFrame:
    """Rows for `again`: the anchors of `length` words of the candidates; those are all windows, or the ones that have an
    anchor of `before` words in the column spans."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = _Slice(part.column(1))
                if not s.n:
                    continue
                grams, lows, width = s.level(length)
                if before is not None:
                    lows = np.where(s.candidates(part.column(2), before), lows, U(0))
                at = anchored(grams, lows, width)
                row = s.row[at]
                yield from sent(grams[at], part.column(0).to_numpy()[row], at - s.words.starts[row])

    return texts.select("rid", "text", *["spans"] * (before is not None)).mapInArrow(run, SENT)


def _windows(texts: DataFrame, before: int, hot: np.ndarray) -> DataFrame:
    """Rows for `again`: the candidates whole, by their anchor of `before` words, with their hashes. A very frequent
    anchor's windows go each its own way."""
    common = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = _Slice(part.column(1))
                if not s.n:
                    continue
                at = np.flatnonzero(s.candidates(part.column(2), before))
                if not len(at):
                    continue
                low, hashes = s.level(before)[1][at], s.rolls[1].at(at, WINDOW)
                apart = np.isin(low, common.value)
                row = s.row[at]
                yield from sent_windows(np.where(apart, mix(low ^ hashes), low), hashes, apart, part.column(0).to_numpy()[row], at - s.words.starts[row])

    return texts.select("rid", "text", "spans").mapInArrow(run, SENT)


def _positions(spans: pa.Array, starts: np.ndarray) -> np.ndarray:
    """All positions of a column of lists of (begin, stop), from where each row starts."""
    n = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = spans.flatten()
    if not len(flat):
        return np.zeros(0, np.int64)
    base = np.repeat(starts[:-1], n)
    begin, stop = (flat.field(k).to_numpy() for k in range(2))
    size = stop - begin
    return np.repeat(begin + base, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(rid, spans): the window starts whose words also come elsewhere, as lists of (begin, stop), from (rid, text)."""
    length, before, texts, found = FIRST, None, rows, None
    while length < WINDOW:
        last, found = found, materialise(again(_level(texts, length, before)), f"level{length}")
        if last is not None:
            release(last)
        if not found.where("rid is not null").take(1):
            return _lists(found)
        texts = rows.select("rid", "text").join(_lists(found), "rid")
        length, before = 2 * length, length
    out = materialise(again(_windows(texts, before, hot_keys(found))), "windows")
    release(found)
    return _lists(out)


def _lists(found: DataFrame) -> DataFrame:
    return found.where("rid is not null").groupBy("rid").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept if asked for) for every row of docs.

    Each word in a window of 35 words of one document whose word sequence also starts anywhere else is removed; windows
    are judged on the input. Kept words are joined by one space. A null or empty text has no words. Rows that repeat an
    id, null ids too, are documents of their own. An empty table gives no rows; other columns are not read.
    """
    rows = with_row_ids(docs, id_col, text_col)
    joined = rows.join(repeated_windows(rows), "rid", "left").select("id", "text", "spans")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column(1))
                n = len(w.flat)
                covered = np.zeros(n + 1, np.int64)
                at = _positions(part.column(2), w.starts)
                np.add.at(covered, at, 1)
                np.add.at(covered, np.minimum(at + WINDOW, n), -1)
                gone = np.cumsum(covered[:n]) > 0
                before = np.concatenate(([0], np.cumsum(gone)))[w.starts]
                left = w.starts - before
                lists = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), w.flat.filter(pa.array(~gone)))
                kept = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
                out = [part.column(0), pa.array(np.diff(w.starts)), pa.array(np.diff(before)), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept.to_pylist()])]
                yield pa.RecordBatch.from_arrays(out + [kept.cast(pa.string())] * keep_text, names)

    names = ["id", "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text]
    out = joined.mapInArrow(run, f"id {id_kind(docs, id_col)}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
    return out.withColumnRenamed("id", id_col)
