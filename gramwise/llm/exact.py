"""Exact dedup: immutable snapshots screened by static binary-fuse filters.

A batch is first grouped in itself. One digest of each of its texts is screened against the filters of every earlier
snapshot; only what a filter lets through is joined with the snapshot's bucket of that digest and compared byte by
byte, the texts of all snapshots being fetched at once. What remains is new and becomes the next snapshot.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from gramwise.llm.common import ascii_lower, crc_mod, fresh, materialise, own_columns, small

U = np.uint64
#: Digests in one filter: bounds a task's memory, about 10 bytes a digest while it is built.
FILTER_KEYS = 200_000
#: The slices of a table that are taken in one after another, as snapshots arrive.
SLICES = 3


def _slots(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots of each key, in three neighbouring segments, and its 16-bit print."""
    with np.errstate(over="ignore"):
        h = keys + U(seed)
        h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
        h ^= h >> U(33)
    first = ((h >> U(32)) * U(segment * count)) >> U(32)
    mask = U(segment - 1)
    slots = np.stack((first, (first + U(segment)) ^ ((h >> U(18)) & mask), (first + U(2 * segment)) ^ (h & mask))).astype(np.int64)
    return slots, ((h ^ (h >> U(32))) & U(0xFFFF)).astype(np.uint16)


def fuse_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, prints) of distinct uint64 keys.

    Peels slots that only one key uses, round by round, then sets prints in the reverse order so that the three
    slots of each key XOR to its print. A seed that can't be peeled is replaced.
    """
    n = len(keys)
    segment = 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    room = max(n, 2) * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    count = max(1, math.ceil(room / segment) - 2)
    for seed in range(1, 200):
        slots, prints = _slots(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, segment, count)
        size = segment * (count + 2)
        users, names = np.bincount(slots.ravel(), minlength=size), np.zeros(size, np.int64)
        np.add.at(names, slots.ravel(), np.tile(np.arange(n), 3))
        rounds, front, done = [], np.flatnonzero(users == 1), 0
        while len(front):
            key, at = np.unique(names[front], return_index=True)
            rounds.append((key, front[at]))
            done += len(key)
            touched = slots[:, key].ravel()
            np.subtract.at(users, touched, 1)
            np.subtract.at(names, touched, np.tile(key, 3))
            front = np.unique(touched[users[touched] == 1])
        if done == n:
            out = np.zeros(size, np.uint16)
            for key, slot in reversed(rounds):
                own = slots[:, key]
                out[slot] = prints[key] ^ out[own[0]] ^ out[own[1]] ^ out[own[2]]
            return seed, segment, count, out.tobytes()
        count += max(1, count // 20)  # a little more room for the next try
    raise ValueError("no seed can be peeled: the keys are not distinct")


def might_hold(keys: np.ndarray, seed: int, segment: int, count: int, prints: bytes) -> np.ndarray:
    slots, own = _slots(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, segment, count)
    table = np.frombuffer(prints, np.uint16)
    return (table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]) == own


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One filter for each bucket of a snapshot's digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(pdf["digest"].to_numpy().astype(np.int64).view(U))
        return pd.DataFrame([(int(pdf["bucket"].iloc[0]), *fuse_filter(keys))], columns=["bucket", "seed", "segment", "count", "prints"])

    own = snapshot.select("digest", F.pmod("digest", F.lit(buckets)).cast("int").alias("bucket"))
    return own.groupBy("bucket").applyInPandas(build, "bucket int, seed long, segment long, count long, prints binary")


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests of the batch that a filter lets through: all that the snapshot holds, and one in 65,536 others."""

    def test(keys: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(keys) or not len(found):
            return pd.DataFrame({"digest": pd.Series([], dtype="int64")})
        f = found.iloc[0]
        digests = keys["digest"].to_numpy().astype(np.int64)
        return pd.DataFrame({"digest": digests[might_hold(digests.view(U), int(f["seed"]), int(f["segment"]), int(f["count"]), f["prints"])]})

    own = batch.select("digest", F.pmod("digest", F.lit(buckets)).cast("int").alias("bucket")).distinct()
    return own.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, "digest long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, sha, norm) of the wanted (id, sha), from docs (id, text). Only texts of wanted ids are hashed."""
    wanted = small(materialise(wanted.distinct(), "wanted")).select(F.col("id").alias("of"), F.col("sha").alias("text_sha"))
    hit = docs.join(wanted, docs["id"].eqNullSafe(F.col("of"))).select("id", "text_sha", ascii_lower(F.col("text")).alias("norm"))
    return hit.where(F.sha2(F.col("norm").cast("binary"), 256) == F.col("text_sha")).select("id", F.col("text_sha").alias("sha"), "norm").dropDuplicates(["id", "sha"])


def candidates(batch: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(sha, slice, rep, to_sha, to_slice, to_rep): texts of the batch that the snapshot's filters let through, with those
    of the same digest. Buckets are so many that neither side has much more than FILTER_KEYS digests in one."""
    buckets = max(1, -(-max(snapshot.count(), batch.count()) // FILTER_KEYS))
    passed = screen(batch, build_filters(snapshot, buckets), buckets)
    held = snapshot.select("digest", F.col("sha").alias("to_sha"), F.col("slice").alias("to_slice"), F.col("rep").alias("to_rep"))
    return batch.join(passed, "digest").join(held, "digest").select("sha", "slice", "rep", "to_sha", "to_slice", "to_rep")


def match(docs: DataFrame, batch: DataFrame, snapshots: list[DataFrame]) -> DataFrame:
    """(sha, slice, to_sha, to_slice): texts of the batch that one of the snapshots holds, by their bytes.

    batch and snapshots are group tables (sha, digest, slice, rep); docs is (id, text), for the texts to compare.
    """
    pairs = materialise(reduce(DataFrame.unionByName, [candidates(batch, s) for s in snapshots]), "pairs")
    texts = _texts(docs, pairs.select(F.col("rep").alias("id"), "sha").union(pairs.select("to_rep", "to_sha")))
    left = texts.select(F.col("id").alias("a"), F.col("sha").alias("sha"), F.col("norm").alias("one"))
    right = texts.select(F.col("id").alias("b"), F.col("sha").alias("to_sha"), F.col("norm").alias("other"))
    both = pairs.join(left, (pairs["rep"].eqNullSafe(F.col("a"))) & (pairs["sha"] == left["sha"])).drop(left["sha"])
    both = both.join(right, (both["to_rep"].eqNullSafe(F.col("b"))) & (both["to_sha"] == right["to_sha"])).drop(right["to_sha"])
    return both.where("one = other").select("sha", "slice", "to_sha", "to_slice")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (id, sha, slice, n) and classes (sha, slice, keep_id, group_size).

    n is how many rows have that id and text. Rows fall into slices by crc32 of the id, and slices are taken in one
    after another: each text is held by the first slice that brought it.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    hashed = own.select("id", ascii_lower(F.col("text")).alias("norm")).select("id", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.xxhash64("norm").alias("digest"), crc_mod(F.col("id"), slices).cast("int").alias("slice"))
    rows = materialise(hashed.groupBy("id", "sha", "digest", "slice").agg(F.count("*").alias("n")), "rows")
    groups = materialise(rows.groupBy("slice", "sha", "digest").agg(F.max("id").alias("rep"), F.sum("n").alias("size")), "groups")
    snapshots: list[DataFrame] = []
    found: list[DataFrame] = []
    for k in range(slices):
        batch = groups.where(F.col("slice") == k)
        if snapshots:
            found.append(materialise(match(own, batch, snapshots), "hits"))
            batch = batch.join(found[-1].select("sha"), "sha", "left_anti")
        if k < slices - 1:
            snapshots.append(materialise(batch, f"snapshot{k}"))
    links = reduce(DataFrame.unionByName, found)
    named = groups.join(links, ["sha", "slice"], "left").select("sha", "slice", "rep", "size", F.coalesce("to_sha", "sha").alias("to_sha"), F.coalesce("to_slice", "slice").alias("to_slice"))
    named = materialise(named, "named")
    total = named.groupBy("to_sha", "to_slice").agg(F.max("rep").alias("keep_id"), F.sum("size").alias("group_size"))
    return rows, named.join(total, ["to_sha", "to_slice"]).select("sha", "slice", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id stays.
    Of rows equal in id and text just one is marked kept; a group whose ids are all null keeps one, with a null keep_id.
    """
    rows, groups = classes(docs, id_col, text_col)
    found = rows.join(groups, ["sha", "slice"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all columns; of rows equal in id and text, the first by content."""
    rows, groups = classes(docs, id_col, text_col)
    sha, same, of, again, nth = fresh(docs, "sha", "same", "of", "again", "nth")
    keep = materialise(rows.join(groups, ["sha", "slice"]).where(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias(of), F.col("sha").alias(same), (F.col("n") > 1).alias(again)), "keep")
    marked = docs.withColumn(sha, F.sha2(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("binary"), 256))
    out = marked.join(keep, (F.col(sha) == F.col(same)) & F.col(f"`{id_col}`").eqNullSafe(F.col(of)))
    once = out.where(~F.col(again))
    order = W.partitionBy(sha, of).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map")]))
    first = out.where(F.col(again)).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return once.unionByName(first).select(*own_columns(docs))
