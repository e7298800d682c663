"""What substring operators on words and on bytes share: anchors of windows, and finding keys that come again.

The anchor of a window is the least hash among the shorter windows inside it. Equal windows have equal anchors, so
only windows whose anchor comes again can come again, and few positions are anchors: 2 in as many as there are
choices. That is how repeats at one length are found before any window of the next length is looked at.

What comes twice in the text that a task has at hand needs nobody else to say so: a task sends each thing once, with how
often it met it, and tells the places at once. So a passage in every text is one row for each slice of text, not one for
each text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gramwise.llm.tokens import mix

U = np.uint64
MAX = U(0xFFFFFFFFFFFFFFFF)
#: Keys met as often are worth a mark, and so many of them, the most frequent, are split further.
HOT, HOT_KEYS = 20_000, 100_000
#: Rows of `again`: n is how often the key was met in a slice of text; below 0, the row is a run of -n places told already.
SENT = "k long, rid long, pos int, n int, tail binary"


def running(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each run of `width` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def least(grams: np.ndarray, width: int, valid: np.ndarray) -> np.ndarray:
    """For each window start its least gram of `width`, 0 where the window isn't valid. Arrays are as long as grams."""
    padded = np.concatenate((grams, np.full(width - 1, MAX, U)))
    return np.where(valid, np.maximum(running(padded, width, np.minimum), U(1)), U(0))


def anchored(grams: np.ndarray, lows: np.ndarray, width: int) -> np.ndarray:
    """The positions that are the least gram of a valid window, ties included."""
    padded = np.concatenate((np.zeros(width - 1, U), lows))
    return np.flatnonzero(running(padded, width, np.maximum) == np.maximum(grams, U(1)))


def holds(grams: np.ndarray, lows: np.ndarray, width: int, chosen: np.ndarray) -> np.ndarray:
    """The valid windows whose least gram is at a chosen position."""
    own = np.full(len(grams), MAX, U)
    own[chosen] = np.maximum(grams[chosen], U(1))
    padded = np.concatenate((own, np.full(width - 1, MAX, U)))
    return np.flatnonzero((running(padded, width, np.minimum) == lows) & (lows > 0))


def spans(rid: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, begin, end) of the runs of neighbouring positions."""
    if not len(rid):
        return rid, pos, pos
    order = np.lexsort((pos, rid))
    rid, pos = rid[order], pos[order]
    new = np.concatenate(([True], (rid[1:] != rid[:-1]) | (pos[1:] > pos[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(rid)])) - 1
    return rid[first], pos[first], pos[last] + 1


def spread(rid: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Keys that deal rows evenly."""
    with np.errstate(over="ignore"):
        return mix(rid.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15) + begin.astype(U)).view(np.int64)


def told(rid: np.ndarray, begin: np.ndarray, stop: np.ndarray, names: tuple[str, ...] = ("k", "rid", "pos", "n", "tail")) -> pa.RecordBatch:
    """Rows for runs of places that need no more looking at."""
    return pa.RecordBatch.from_arrays([pa.array(spread(rid, begin)), pa.array(rid), pa.array(begin.astype(np.int32)), pa.array((begin - stop).astype(np.int32)), pa.nulls(len(rid), pa.binary())], names)


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct combination of keys, how often each place's combination comes)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    times = np.empty(len(order), np.int64)
    times[order] = np.repeat(size, size)
    return order[new], times


def sent(key: np.ndarray, rid: np.ndarray, pos: np.ndarray):
    """Record batches of SENT for the keys of a slice of text at their places."""
    first, times = grouped(key)
    yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(rid[first]), pa.array(pos[first].astype(np.int32)), pa.array(times[first].astype(np.int32)), pa.nulls(len(first), pa.binary())], ["k", "rid", "pos", "n", "tail"])
    again_ = times > 1
    if again_.any():
        yield told(*spans(rid[again_], pos[again_]))


def sent_windows(key: np.ndarray, hashes: np.ndarray, apart: np.ndarray, rid: np.ndarray, pos: np.ndarray):
    """The same for windows in order of place, each known by its key and hash. Neighbours of one key and one row travel
    together, those set apart alone."""
    first, times = grouped(key, hashes)
    keep = np.sort(first)
    k, h, lone, r, p, n = key[keep], hashes[keep], apart[keep], rid[keep], pos[keep], times[keep] > 1
    new = np.concatenate(([True], (p[1:] != p[:-1] + 1) | (r[1:] != r[:-1]) | (k[1:] != k[:-1]) | (n[1:] != n[:-1]) | lone[1:] | lone[:-1]))
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(keep)))
    yield pa.RecordBatch.from_arrays([pa.array(k[at].view(np.int64)), pa.array(r[at]), pa.array(p[at].astype(np.int32)), pa.array(np.where(n[at], 2, 1).astype(np.int32)), tails(h, at, count)], ["k", "rid", "pos", "n", "tail"])
    again_ = times > 1
    if again_.any():
        yield told(*spans(rid[again_], pos[again_]))


def again(rows: DataFrame) -> DataFrame:
    """(rid, begin, stop): positions whose key comes at least twice, as runs, from rows as SENT says.

    tail holds 8-byte hashes of one window or more, from pos on; without it the key alone is compared. Keys are dealt
    out and sorted, then read as a stream: what is held is the distinct windows of one key. Keys without tails met HOT
    times or more are also returned as (null, k, count).
    """

    def marks(k, met):
        return pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int64()), pa.array(k), pa.array(met)], ["rid", "begin", "stop"])

    def run(batches):
        key = held = None
        bare = True
        for batch in batches:
            if not batch.num_rows:
                continue
            k, rid, pos, n = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            if (done := n < 0).any():
                yield pa.RecordBatch.from_arrays([pa.array(x[done]) for x in (rid, pos, pos - n)], ["rid", "begin", "stop"])
                batch = batch.filter(pa.array(~done))
                k, rid, pos, n = (x[~done] for x in (k, rid, pos, n))
                if not len(k):
                    continue
            bare = batch.column(4).null_count == len(k)
            size, h = flat_tails(batch.column(4), len(k))
            at = np.repeat(np.arange(len(k)), size)
            pos = pos[at] + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            k, rid, met = k[at], rid[at], n[at]
            if held is not None and k[0] == key:
                k = np.concatenate((np.full(len(held[0]), key), k))
                h, rid, pos, met = (np.concatenate(x) for x in zip(held, (h, rid, pos, met), strict=True))
            elif held is not None and bare and (hot := held[3] >= HOT).any():
                yield marks(np.full(hot.sum(), key), held[3][hot])
            order = np.lexsort((h, k))
            k, h, rid, pos, met = (x[order] for x in (k, h, rid, pos, met))
            first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (h[1:] != h[:-1]))))
            total = np.add.reduceat(met, first)
            # A place met once is told when its key turns out to come again; one met more often has told itself.
            tell = (met == 1) & np.repeat(total > 1, np.diff(np.append(first, len(k))))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans(rid[tell], pos[tell])], ["rid", "begin", "stop"])
            key = k[-1]
            last = k[first] == key
            if bare and (hot := (total >= HOT) & ~last).any():
                yield marks(k[first[hot]], total[hot])
            held = (h[first[last]], rid[first[last]], pos[first[last]], total[last])
        if held is not None and bare and (hot := held[3] >= HOT).any():
            yield marks(np.full(hot.sum(), key), held[3][hot])

    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(run, "rid long, begin long, stop long")


def flat_tails(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes each tail has, and all of them; a null tail is one hash, 0."""
    if column.null_count == n:
        return np.ones(n, np.int64), np.zeros(n, U)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    return np.diff(offsets) // 8, np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(U)


def hot_keys(found: DataFrame) -> np.ndarray:
    """The most frequent of the keys that `again` marked, sorted: at most HOT_KEYS numbers."""
    rows = found.where("rid is null").groupBy("begin").agg(F.max("stop").alias("n")).orderBy(F.desc("n"), "begin").limit(HOT_KEYS).collect()
    return np.sort(np.array([r["begin"] for r in rows], np.int64)).view(U)


def tails(hashes: np.ndarray, begin: np.ndarray, count: np.ndarray) -> pa.Array:
    """count[i] hashes from begin[i] on, as bytes."""
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - begin, count)
    data = np.ascontiguousarray(hashes[place])
    offsets = np.concatenate(([0], np.cumsum(count * 8))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
