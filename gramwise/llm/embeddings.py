"""Embedding near-dedup by a forest of random-projection trees.

Equal vectors are one to begin with. In every tree a node's vectors are split at the median of random projections,
recursively, until they fit a leaf; vectors close to a split go to both sides. A node whose vectors mostly link, as its
sample tells, is a leaf of any size: splits would part its links. Vectors are compared within leaves only, exactly and
in double precision, each pair at the first leaf that has both, and links are united.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gramwise.llm.common import materialise, small
from gramwise.llm.graph import components, stars
from gramwise.shared import checkpoint

COSINE = 0.93
TREES, LEAF, SEED = 6, 1600, 7
#: Random directions that a node is split along at once, and the share of a node's vectors on both sides of a split.
SPLITS, SPILL = 2, 0.12
#: Levels of splits at most; vectors that no projection tells apart stay in one leaf, which is compared in blocks.
LEVELS = 24
#: A node is a leaf when this share of its sampled pairs links (1 / DENSE compared pairs a link, about); vectors sampled.
DENSE, SAMPLE = 0.05, 32
#: Vectors compared at once; a leaf of more than TASK is dealt to parts, and each pair of parts is a task.
BLOCK, TASK = 1024, 4096


def directions(tree: int, level: int, size: int) -> np.ndarray:
    return np.random.default_rng((SEED, tree, level)).standard_normal((SPLITS, size))


def _units(column: pd.Series) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision; scaled by the largest part first, as squares may overflow or vanish."""
    rows = np.stack(column.to_numpy()).astype(float)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _project(vectors: DataFrame, level: int) -> DataFrame:
    """(vec, p): each vector's projections on the directions of all trees at a level."""

    def run(batches):
        for pdf in batches:
            for _, own in pdf.groupby(pdf["vector"].map(len)):
                along = np.concatenate([directions(tree, level, len(own["vector"].iloc[0])) for tree in range(TREES)])
                yield pd.DataFrame({"vec": own["vec"], "p": list(_units(own["vector"]) @ along.T)})

    return vectors.select("vec", "vector").mapInPandas(run, "vec long, p array<double>")


def _dense(now: DataFrame, large: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node) of the large nodes (node, count) whose sampled pairs link often enough to be compared whole."""
    drawn = now.join(large, "node").where(F.pmod(F.xxhash64("node", "vec"), F.col("count")) < SAMPLE).select("node", "vec")

    def share(pdf):
        rows = _units(pdf["vector"])
        pairs = len(rows) * (len(rows) - 1)
        hits = np.count_nonzero(np.triu(rows @ rows.T >= COSINE, 1)) * 2
        return pd.DataFrame({"node": pdf["node"].iloc[:1], "dense": [pairs > 0 and hits >= DENSE * pairs]})

    drawn = small(materialise(drawn, "drawn"))
    return vectors.select("vec", "vector").join(drawn, "vec").groupBy("node").applyInPandas(share, "node long, dense boolean").where("dense").select("node")


def forest(vectors: DataFrame) -> DataFrame:
    """(leaf, vec) of vectors (label, vec, vector): the leaves of all trees; a vector has one or more in each tree.

    Each round splits the nodes that are too large and not dense, all at once; a label's trees part at its first split,
    as they would begin with the same vectors. Medians and the spill's borders are approximate
    percentiles, summed up by node; a node's vectors never meet in one task, only those of a leaf's part. Rows hold a number
    of the tree and node; the vectors themselves stay where they are.
    """
    now = vectors.select(F.lit(0).alias("tree"), F.xxhash64("label").alias("node"), "vec")
    done: DataFrame | None = None
    for level in range(LEVELS + 1):
        large = checkpoint(now.groupBy("node").count().where(F.col("count") > LEAF))
        if level < LEVELS and large.take(1):
            large = checkpoint(large.join(_dense(now, large, vectors), "node", "left_anti"))
        large = large.select("node")
        last = level == LEVELS or not large.take(1)
        leaves = (now if last else now.join(large, "node", "left_anti")).select(F.col("node").alias("leaf"), "vec")
        done = leaves if done is None else done.unionByName(leaves)
        if last:
            return done
        at = F.col("tree") * SPLITS
        open_ = now.join(large, "node", "left_semi")
        if level == 0:
            open_ = open_.select(F.explode(F.array(*map(F.lit, range(TREES)))).alias("tree"), "node", "vec").withColumn("node", F.xxhash64("tree", "node"))
        open_ = open_.join(_project(vectors, level), "vec")
        open_ = materialise(open_.select("tree", "node", "vec", *[F.get("p", at + k).alias(f"p{k}") for k in range(SPLITS)]), f"level{level}")
        border = [0.5 - SPILL / 2, 0.5, 0.5 + SPILL / 2]
        cuts = open_.groupBy("node").agg(*[F.percentile_approx(f"p{k}", border, 2000).alias(f"c{k}") for k in range(SPLITS)])
        split = open_.join(cuts, "node")
        for k in range(SPLITS):
            p, c = F.col(f"p{k}"), F.col(f"c{k}")
            own = F.when((p >= c[0]) & (p < c[2]), F.array(F.lit(0), F.lit(1))).when(p < c[1], F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
            split = split.withColumn(f"s{k}", F.explode(own))
        now = materialise(split.select("tree", F.xxhash64("node", *[f"s{k}" for k in range(SPLITS)]).alias("node"), "vec"), f"nodes{level}")
    raise AssertionError("not reached")


def _shared(left: list[np.ndarray], right: list[np.ndarray], leaf: int) -> np.ndarray:
    """Whether a row of left and one of right have a smaller leaf than this in common."""
    flat = [np.concatenate(x) for x in (left, right)]
    own = np.intersect1d(*flat)
    own = own[own < leaf]
    sides = []
    for lists, ids in zip((left, right), flat, strict=True):
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        has = np.isin(ids, own)
        side = np.zeros((len(lists), len(own)), np.float32)
        side[row[has], np.searchsorted(own, ids[has])] = 1
        sides.append(side)
    return sides[0] @ sides[1].T > 0


def _blocks(vectors: np.ndarray, leaves: list[np.ndarray], leaf: int, cut: int):
    """(rows, columns, links, those counted at this leaf) of blocks of rows against blocks of rows: each pair of vectors
    once, or with a cut the pairs of one before and one after it."""
    n = len(vectors)
    for i in range(0, cut or n, BLOCK):
        rows = slice(i, min(i + BLOCK, cut or n))
        for j in range(cut or i, n, BLOCK):
            cols = slice(j, min(j + BLOCK, n))
            dot = vectors[rows] @ vectors[cols].T
            hit = dot >= COSINE
            # Close calls exactly, and the same whichever leaf it is.
            a, b = np.nonzero(np.abs(dot - COSINE) <= 1e-9)
            hit[a, b] = np.einsum("ij,ij->i", vectors[rows][a], vectors[cols][b]) >= COSINE
            if i == j:
                hit = np.triu(hit, 1)
            if hit.any():
                yield rows, cols, hit, hit & ~_shared(leaves[rows], leaves[cols], leaf)


def _united(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of links that unite what all links of a block do: the first of each row and column, and those
    that still join what these leave apart. Columns are numbered after the rows."""
    n = len(hit)
    a, b = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    a, b = np.concatenate((a, hit[:, b].argmax(0))), np.concatenate((hit[a].argmax(1), b))
    label = np.arange(n + hit.shape[1])
    x, y = stars(a, b + n)
    label[x] = y
    c, d = np.nonzero(hit & (label[:n, None] != label[None, n:]))
    return np.concatenate((a, c)), np.concatenate((b, d))


def compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """(vec, links, to): links counted at this leaf, and a star over the vectors that links join here.

    The rows are two parts of a leaf, i and j, whose pairs are compared, or one part against itself."""
    pdf = pdf.sort_values(["part", "vec"])
    vec, weight = pdf["vec"].to_numpy(), pdf["copies"].to_numpy()
    one, two = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    cut = int((pdf["part"] == one).sum()) if one != two else 0
    links, left, right = np.zeros(len(vec), np.int64), [vec[:0]], [vec[:0]]
    if one == two or 0 < cut < len(vec):
        for rows, cols, hit, first in _blocks(_units(pdf["vector"]), pdf["leaves"].tolist(), int(pdf["leaf"].iloc[0]), cut):
            links[rows] += first @ weight[cols]
            links[cols] += first.T @ weight[rows]
            a, b = _united(hit)
            x, y = stars(vec[rows][a], vec[cols][b])
            left.append(x)
            right.append(y)
    x, y = stars(np.concatenate(left), np.concatenate(right))
    to = dict(zip(x.tolist(), y.tolist(), strict=True))
    return pd.DataFrame({"vec": vec, "links": links, "to": pd.array([to.get(v, v) for v in vec.tolist()], dtype="int64")})


def _dealt(leaves: DataFrame) -> DataFrame:
    """(leaf, i, j, part, vec): each leaf's vectors by part, at every pair of parts that they take part in."""
    large = small(checkpoint(leaves.groupBy("leaf").count().where(F.col("count") > TASK)))
    parts = F.coalesce(F.ceil(F.col("count") / TASK), F.lit(1)).cast("int")
    dealt = leaves.join(large, "leaf", "left").select("leaf", "vec", parts.alias("parts"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec", F.lit(SEED)), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("leaf", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "vec")


def near_dedup(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of table.

    Rows link when labels are equal and not null and the cosine is 0.93 or more, of the pairs that share a leaf; none
    below it link. Vectors that are null, empty or zero or hold null or non-finite parts, and rows with a null label,
    link with nothing; vectors of other lengths are compared apart. Rows with a null id count as links of
    others, have component_id of the smallest id they reach (null if none) and are kept if that is null. Rows that
    repeat an id are rows of their own: each has its links, and all with the smallest id of a component are kept.
    """
    parts = F.col(vector_col)
    good = F.col(label_col).isNotNull() & (F.size(parts) > 0) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(parts, lambda x: x != 0)
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), parts.alias("vector"), F.coalesce(good, F.lit(False)).alias("good"))
    keyed = rows.where("good").groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    keyed = materialise(keyed.withColumn("vec", F.monotonically_increasing_id()), "distinct")  # numbered once, and written
    unit = keyed.select("vec", "copies", "vector", F.concat_ws(":", "label", F.size("vector")).alias("label"))
    leaves = materialise(forest(unit), "leaves")
    lists = leaves.groupBy("vec").agg(F.collect_set("leaf").alias("leaves"))  # at most a few for each tree
    known = unit.select("vec", "copies", "vector").join(lists, "vec")
    found = _dealt(leaves).join(known, "vec").groupBy("leaf", "i", "j").applyInPandas(compare, "vec long, links long, to long")
    found = materialise(found, "found")
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    comps = components(found.where("vec != to").select(F.col("vec").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "vec")
    named = keyed.join(links, "vec").join(comps, "vec", "left").withColumn("component", F.coalesce("component", "vec"))
    named = materialise(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(least, "component").select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    hits = rows.where("good").join(known, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector"))).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = hits.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
