"""SimHash near-dedup by a covering code.

Anchors are the words of a code in which every fingerprint is near one: the product of two perfect [23, 12] codes of
covering radius 3 on bits 0-22 and 23-45. A fingerprint is at home at its one nearest anchor and is copied to every
anchor within the radius plus the threshold, split over the two halves in every way. Two fingerprints within the
threshold therefore meet at the home of each, whatever bits differ; members are compared with homes only.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from gramwise.llm.common import fresh, id_kind, materialise, slices, with_row_ids
from gramwise.llm.graph import components, stars
from gramwise.llm.tokens import words

U = np.uint64
SEED, SHINGLE, THRESHOLD = 42, 3, 2
#: Generator polynomial of the perfect binary [23, 12] code, its length, and its covering radius: fixed values.
GENERATOR, LENGTH, RADIUS = 0xC75, 23, 3
#: XXH64's five primes: fixed values.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
#: Pairs compared at once in a task.
PAIRS = 1 << 21


def xxh64_short(data: np.ndarray, begin: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[begin:begin + length]; strings under 32 bytes go together, by length."""
    p1, p2, p3, p4, p5 = map(U, PRIMES)
    out = np.empty(len(begin), U)
    far = np.flatnonzero(length >= 32)
    raw = data.tobytes() if len(far) else b""
    for i in far.tolist():
        out[i] = xxhash.xxh64_intdigest(raw[begin[i] : begin[i] + length[i]], seed)
    data = np.concatenate((data, np.zeros(8, np.uint8)))
    near = np.flatnonzero(length < 32)
    near = near[np.argsort(length[near].astype(np.uint8), kind="stable")]
    cuts = np.searchsorted(length[near], np.arange(33))

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return (x << U(r)) | (x >> U(64 - r))

    def word(at: np.ndarray, n: int) -> np.ndarray:
        w = np.zeros(len(at), U)
        for k in range(n):
            w |= data[at + k].astype(U) << U(8 * k)
        return w

    with np.errstate(over="ignore"):
        for n in range(32):
            own = near[cuts[n] : cuts[n + 1]]
            if not len(own):
                continue
            at = begin[own]
            h = np.full(len(own), U((seed + PRIMES[4] + n) & 0xFFFFFFFFFFFFFFFF), U)
            k = 0
            while k + 8 <= n:
                h ^= turn(word(at + k, 8) * p2, 31) * p1
                h = turn(h, 27) * p1 + p4
                k += 8
            if k + 4 <= n:
                h ^= word(at + k, 4) * p1
                h = turn(h, 23) * p2 + p3
                k += 4
            while k < n:
                h ^= data[at + k].astype(U) * p5
                h = turn(h, 11) * p1
                k += 1
            h ^= h >> U(33)
            h *= p2
            h ^= h >> U(29)
            h *= p3
            out[own] = h ^ (h >> U(32))
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text as uint64: bit k is set if over half of its shingle hashes have it."""
    w = words(texts, lower=True)
    count = np.diff(w.starts)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(w.flat)], pa.int32()), w.flat), pa.scalar(" ", pa.large_string()))
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)
    size = pc.binary_length(w.flat).to_numpy().astype(np.int64)
    begin = np.cumsum(size + 1) - size - 1
    shingles = np.where(count == 0, 0, np.maximum(count - SHINGLE + 1, 1))
    row = np.repeat(np.arange(len(count)), shingles)
    first = w.starts[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(first + SHINGLE, w.starts[1:][row]) - 1
    h = xxh64_short(data, begin[first], begin[last] + size[last] - begin[first])
    out = np.zeros(len(count), U)
    full = np.flatnonzero(shingles)
    if len(full):
        starts = (np.cumsum(shingles) - shingles)[full]
        for k in range(64):
            ones = np.add.reduceat(((h >> U(k)) & U(1)).astype(np.int32), starts)
            out[full] |= (2 * ones > shingles[full]).astype(U) << U(k)
    return out


@lru_cache(maxsize=1)
def cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome, the error patterns of weight up to RADIUS + THRESHOLD: (patterns in order of syndrome and
    weight past the radius, where each syndrome's begin, how many there are up to each weight past the radius)."""
    unit = np.array([syndrome(np.array([1 << k]))[0] for k in range(LENGTH)])
    patterns, syn, past = [], [], []
    for weight in range(RADIUS + THRESHOLD + 1):
        for bits in combinations(range(LENGTH), weight):
            patterns.append(sum(1 << b for b in bits))
            syn.append(int(np.bitwise_xor.reduce(unit[list(bits)])) if bits else 0)
            past.append(max(0, weight - RADIUS))
    patterns, syn, past = np.array(patterns), np.array(syn), np.array(past)
    order = np.lexsort((past, syn))
    n = 1 << (GENERATOR.bit_length() - 1)
    upto = np.stack([np.bincount(syn[past <= p], minlength=n) for p in range(THRESHOLD + 1)], 1)
    return patterns[order], np.concatenate(([0], np.cumsum(upto[:, -1]))), upto


def syndrome(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64).copy()
    top = GENERATOR.bit_length() - 1
    for k in range(LENGTH - 1, top - 1, -1):
        v ^= ((v >> k) & 1) * (GENERATOR << (k - top))
    return v


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which fingerprint, anchor, is it home) for all anchors within reach."""
    patterns, start, upto = cosets()
    mask, check = (1 << LENGTH) - 1, GENERATOR.bit_length() - 1
    one, two = (fps & U(mask)).astype(np.int64), ((fps >> U(LENGTH)) & U(mask)).astype(np.int64)
    s1, s2 = syndrome(one), syndrome(two)
    who, anchor, home = [], [], []
    for past in range(THRESHOLD + 1):
        lower = upto[s1, past - 1] if past else np.zeros(len(fps), np.int64)
        n1, n2 = upto[s1, past] - lower, upto[s2, THRESHOLD - past]
        rows = np.repeat(np.arange(len(fps)), n1 * n2)
        k = np.arange(len(rows)) - np.repeat(np.cumsum(n1 * n2) - n1 * n2, n1 * n2)
        i, j = k // n2[rows], k % n2[rows]
        c1 = one[rows] ^ patterns[start[s1[rows]] + lower[rows] + i]
        c2 = two[rows] ^ patterns[start[s2[rows]] + j]
        who.append(rows)
        anchor.append(((c1 >> check) << (LENGTH - check)) | (c2 >> check))
        home.append((past == 0) & (i == 0) & (j == 0))  # the code is perfect: just one anchor is within the radius
    return np.concatenate(who), np.concatenate(anchor), np.concatenate(home)


@lru_cache(maxsize=1)
def near_masks() -> np.ndarray:
    """All words of weight 1 to THRESHOLD."""
    return np.array([sum(1 << b for b in bits) for w in range(1, THRESHOLD + 1) for bits in combinations(range(64), w)], U)


def compare(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and members of the same anchor; rows are in order of anchor.

    A small anchor's pairs are all compared. In one with more members than there are words within the threshold, each
    home looks its neighbours up in the sorted members: work stays in proportion to the members.
    """
    cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.concatenate((cut, [len(anchor)])))
    group = np.repeat(np.arange(len(cut)), size)
    asks = np.flatnonzero(home & (size[group] > 1))
    masks, a, b = near_masks(), [], []
    big = size[group[asks]] > len(masks)
    few, many = asks[~big], asks[big]
    total = np.cumsum(size[group[few]])
    begin = 0
    while begin < len(few):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS)))
        own = few[begin:stop]
        n = size[group[own]]
        left = np.repeat(own, n)
        right = cut[group[left]] + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count(fp[left] ^ fp[right])
        hit = (near <= THRESHOLD) & (near > 0)
        a.append(fp[left[hit]])
        b.append(fp[right[hit]])
        begin = stop
    for g in np.unique(group[many]):
        members = np.sort(fp[cut[g] : cut[g] + size[g]])
        homes = fp[many[group[many] == g]]
        for k in range(0, len(homes), PAIRS // len(masks)):
            asked = homes[k : k + PAIRS // len(masks), None] ^ masks[None, :]
            at = np.minimum(np.searchsorted(members, asked), len(members) - 1)
            i, j = np.nonzero(members[at] == asked)
            a.append(homes[k + i])
            b.append(asked[i, j])
    return stars(np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def link(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (fp long) within the threshold."""

    def spread(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(U)
            for k in range(0, len(own), 1 << 13):
                who, anchor, home = anchors(own[k : k + (1 << 13)])
                part = own[k : k + (1 << 13)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(part[who]), pa.array(home)], ["anchor", "fp", "home"])

    def meet(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def out():
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            a, b = compare(rows[0], rows[1].view(U), rows[2])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            rows = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last anchor may go on in the next batch
            if cut or (held and held[-1][0][-1] != rows[0][0]):
                held.append(tuple(c[:cut] for c in rows))
                yield out()
                held = []
            held.append(tuple(c[cut:] for c in rows))
        if held:
            yield out()

    dealt = fps.mapInArrow(spread, "anchor int, fp long, home boolean").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(meet, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    Text is lower-cased (A-Z) and cut into words; shingles are 3 words joined by a space, repeats counted (fewer words:
    the whole sequence; none or null: fingerprint zero, which links as any other). Fingerprints link at 2 or fewer
    differing bits; component_id is the smallest id that links reach, null only if all ids there are null. Repeated
    rows count as documents of their own.
    """
    return _grouped(docs, id_col, text_col)[0]


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fingerprints(part.column(2)).view(np.int64))], ["rid", "id", "fp"])

    rows = materialise(with_row_ids(docs, id_col, text_col).mapInArrow(run, f"rid long, id {id_kind(docs, id_col)}, fp long"), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("rid").alias("rep"), F.min("id").alias("least")), "fps")
    comps = components(link(fps.select("fp"))).withColumnRenamed("node", "fp")
    named = materialise(fps.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "components")
    best = named.groupBy("component").agg(F.min("least").alias("component_id"), F.min("rep").alias("keep_rid"))
    of = named.select("fp", "component").join(best, "component").drop("component")
    found = rows.join(of, "fp")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), found.select("id", "rid", "keep_rid")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each component (the smallest id), with all columns."""
    at, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key, drop = fresh(docs, "rid", "drop")
    if docs.groupBy(at).count().where(F.col("count") > 1).limit(1).count() or docs.where(at.isNull()).limit(1).count():
        # Ids don't tell rows apart: number the rows once, in the order of with_row_ids.
        docs = materialise(docs.orderBy(at.asc_nulls_first(), F.sha2(text.cast("binary"), 256)).withColumn(key, F.monotonically_increasing_id()), "numbered")
    else:
        docs = docs.withColumn(key, at)
    _, found = _grouped(docs, key, text_col)
    gone = materialise(found.where("rid != keep_rid").select(F.col("id").alias(drop)), "drop")
    return docs.join(gone, F.col(key) == F.col(drop), "left_anti").drop(key)
