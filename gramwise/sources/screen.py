"""Candidate texts from screen trees and from recognised lines.

A tree is a relation of nodes. In the order of a breadth-first walk the children of a node stand side by side, and so do all
nodes so many levels below it: numbers in that order make ancestors and subtrees a few ranges. They are found from three
numbers of each node, a scan at a time; texts stay in the tables and are joined to what the walks meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gramwise.functions import fixed
from gramwise.functions.text import NOT_BLANK, count_prices, has_price, let, may_have_price, normalize, take, trim, units
from gramwise.operators.dedupe import fold
from gramwise.shared import apart, materialise, release
from gramwise.sources.texts import analysed


def own_text(text: Column, description: Column) -> Column:
    """The text, and on a new line the description if it says something else."""
    filled = lambda c: F.when(c.rlike(NOT_BLANK), c)
    return trim(F.concat_ws("\n", filled(text), F.when(~F.coalesce(description.eqNullSafe(text), F.lit(False)), filled(description))))


#: Nodes whose subtrees are walked at once.
SLICE = 16_384


class Tree:
    """The nodes of one scan that can be reached from a root, numbered in the order of a breadth-first walk: roots and children
    by child_ord, then by node_id. An id that a scan repeats counts once."""

    def __init__(self, ids: np.ndarray, parents: np.ndarray, is_root: np.ndarray, child_ord: np.ndarray):
        own, first = np.unique(ids, return_index=True)
        above, is_root, child_ord = parents[first], is_root[first], child_ord[first]
        up = np.minimum(np.searchsorted(own, above), len(own) - 1)
        up = np.where(~is_root & (own[up] == above), up, np.where(is_root, -1, -2))
        by_parent = np.lexsort((own, child_ord, up))
        n_children = np.bincount(up[up >= 0], minlength=len(own))
        start = np.searchsorted(up[by_parent], np.arange(len(own)))
        level, levels = by_parent[up[by_parent] == -1], []
        self.roots = len(level)
        while len(level):
            levels.append(level)
            n = n_children[level]
            level = by_parent[np.repeat(start[level], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        order = np.concatenate(levels) if levels else np.zeros(0, np.int64)
        self.ids, self.rows = own[order], first[order]
        n = n_children[order]
        self.stop = self.roots + np.cumsum(n)  # children of node i: start[i] to stop[i]
        self.start = self.stop - n
        place = np.full(len(own), -1)
        place[order] = np.arange(len(order))
        above = up[order]
        self.up = np.where(above >= 0, place[above], -1)

    def ancestors(self, nodes: np.ndarray, most: int) -> np.ndarray:
        """A row for each node: its parent, the parent's parent and so on, -1 above a root."""
        out, now = [], nodes
        for _ in range(most):
            now = np.where(now >= 0, self.up[now], -1)
            out.append(now)
        return np.column_stack(out) if out else np.zeros((len(nodes), 0), np.int64)

    def below(self, node: int, most: int) -> np.ndarray:
        """The first nodes that a walk from node meets, itself included."""
        return self.all_below(np.array([node]), most)[1]

    def all_below(self, nodes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of each of the nodes, one after the other: places in nodes, and what is met. A range for each level."""
        at, low, high, room, levels = np.arange(len(nodes)), nodes, nodes + 1, np.full(len(nodes), most), []
        while len(at):
            n = np.minimum(high - low, room)
            levels.append((np.repeat(at, n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())))
            low, high, room = self.start[low], self.stop[high - 1], room - n
            on = (low < high) & (room > 0)
            at, low, high, room = at[on], low[on], high[on], room[on]
        if not levels:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, met = (np.concatenate(x) for x in zip(*levels, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], met[order]


def reachable(nodes: DataFrame) -> DataFrame:
    """Without children that no walk gets to, after more children of their parent than are ever visited: a list of millions of
    rows is short work. Only parents that have so many are looked at."""
    most = fixed.VISITED + fixed.SUBTREE_NODES
    wide = nodes.where("parent_id is not null").groupBy("scan_id", "parent_id").count().where(F.col("count") > most)
    if not wide.take(1):
        return nodes
    # The first children are among the first of each of some parts of them, as many parts as leave tasks of one size twice: the
    # root of how many times too many there are. The order is the same in both, so nothing is decided otherwise.
    parts = F.ceil(F.sqrt(F.col("count") / most)).cast("long")
    of_wide = nodes.join(wide.select("scan_id", "parent_id", parts.alias("_parts")), ["scan_id", "parent_id"]).withColumn("_part", F.pmod(F.xxhash64("node_id"), "_parts"))
    wide = wide.select("scan_id", "parent_id")
    order, first = ("child_ord", "node_id"), of_wide
    for by in (("scan_id", "parent_id", "_part"), ("scan_id", "parent_id")):
        first = first.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    return nodes.join(wide, ["scan_id", "parent_id"], "left_anti").unionByName(first.select(*nodes.columns))


def lists(n: int, places: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """n lists, null but at the places (in order), which have so many of the values each."""
    each, null = np.zeros(n, np.int64), np.ones(n, bool)
    each[places], null[places] = sizes, False
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(values, pa.int64()), mask=pa.array(null))


def walked(nodes: DataFrame, every: bool = True) -> DataFrame:
    """(scan_id, node_id, seq, ups, below) from (scan_id, node_id, parent_id, child_ord, seed, size): seq numbers the nodes in
    the order of a walk. Of seeds that a walk visits, ups has up to CLIMB ancestors, the parent first. Of those ancestors,
    below has the nodes of which their texts are made, in order: walks end at SUBTREE_NODES nodes, or at SUBTREE_UNITS of
    size and one for each text before a node; nodes of size 0 have no text to use.

    A task holds four numbers of each node of one scan. Nodes without a way to a root are left out; so are, unless every
    node is wanted, those that have no ups and no below and are in none: most of a screen with more than walks meet.
    """
    names = ["node_id", "parent_id", "child_ord", "seed", "size"]
    schema = "scan_id bigint, node_id bigint, seq bigint, ups array<bigint>, below array<bigint>"

    def walk(scan: int, table: pa.Table) -> pa.RecordBatch:
        ids, parents, child_ord, seed, size = (table.column(c) for c in names)
        tree = Tree(ids.to_numpy(), parents.fill_null(0).to_numpy(), parents.is_null().to_numpy(), child_ord.to_numpy())
        n = len(tree.ids)
        size, seed = size.to_numpy()[tree.rows], seed.to_numpy()[tree.rows]
        seeds = np.flatnonzero(seed[: fixed.VISITED])
        ups = tree.ancestors(seeds, fixed.CLIMB)
        own = ups >= 0
        above = lists(n, seeds, own.sum(axis=1), tree.ids[ups[own]])
        tops = np.unique(ups[own])
        used = np.zeros(n, bool)
        used[seeds] = used[tops] = True
        n_below, ids = [], []
        for k in range(0, len(tops), SLICE):
            part = tops[k : k + SLICE]
            at, met = tree.all_below(part, fixed.SUBTREE_NODES)
            taken = np.where(size[met] > 0, size[met] + 1, 0)
            before = np.cumsum(taken) - taken
            before -= before[np.searchsorted(at, np.arange(len(part)))][at]
            good = (before < fixed.SUBTREE_UNITS) & (taken > 0)
            n_below.append(np.bincount(at[good], minlength=len(part)))
            ids.append(tree.ids[met[good]])
            used[met[good]] = True
        none = np.zeros(0, np.int64)
        below = lists(n, tops, np.concatenate([none, *n_below]), np.concatenate([none, *ids]))
        out = pa.RecordBatch.from_arrays([pa.array(np.full(n, scan)), pa.array(tree.ids), pa.array(np.arange(1, n + 1)), above, below], ["scan_id", "node_id", "seq", "ups", "below"])
        return out if every else out.take(pa.array(np.flatnonzero(used)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            scans = batch.column("scan_id").to_numpy()
            cuts = [0, *(np.flatnonzero(scans[1:] != scans[:-1]) + 1).tolist(), len(scans)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low < high:
                    if held and scans[low] != now:
                        yield walk(now, pa.Table.from_batches(held))
                        held = []
                    now = int(scans[low])
                    held.append(batch.slice(low, high - low))
        if held:
            yield walk(now, pa.Table.from_batches(held))

    numbers = nodes.where("scan_id is not null and node_id is not null").select(F.col("scan_id").cast("long"), *[F.col(c).cast("long") for c in names[:2]], F.coalesce(F.col("child_ord").cast("long"), F.lit(0)).alias("child_ord"), "seed", F.col("size").cast("long"))
    return numbers.repartition("scan_id").sortWithinPartitions("scan_id", "node_id", "parent_id", "child_ord").mapInArrow(run, schema)


def score(text: Column, class_name: Column, width: Column, height: Column) -> Column:
    """How much a text looks like one product's card."""
    (low, high, good), (most, fair), bad = fixed.SCORE_LENGTH
    by_length = let(units(text), lambda n: F.when(n.between(low, high), good).when(n <= most, fair).otherwise(bad))
    (one, best), (few, some), others = fixed.SCORE_PRICES
    by_prices = let(count_prices(normalize(text)), lambda n: F.when(n == one, best).when(n.between(one, few), some).otherwise(others))
    by_class = F.when(F.lower(F.coalesce(class_name, F.lit(""))).rlike(fixed.CARD_CLASS), fixed.SCORE_CLASS).otherwise(0.0)
    return by_length + by_prices + by_class + F.when((width > fixed.CARD_BOUNDS[0]) & (height > fixed.CARD_BOUNDS[1]), fixed.SCORE_BOUNDS).otherwise(0.0)


def node_candidates(nodes: DataFrame) -> DataFrame:
    """(scan_id, seq, raw_text): the best text at or above each node with a price, each text once, in order of first sight.

    Ids are unique in a scan."""
    box = (F.col("w"), F.col("h"))
    numbers = nodes.select("scan_id", "node_id", "parent_id", "child_ord", own_text(F.col("text"), F.col("content_desc")).alias("own"), "class_name", (F.col("r") - F.col("l")).alias("w"), (F.col("b") - F.col("t")).alias("h"))
    size = F.when(units(F.col("own")).between(1, fixed.OWN_MOST - 1), units(F.col("own"))).otherwise(0)
    nodes = materialise(numbers.select("*", (may_have_price(F.col("own")) & has_price(F.col("own"))).alias("seed"), size.alias("size")), "nodes")
    reached = reachable(nodes)
    walks = walked(reached.select("scan_id", "node_id", "parent_id", "child_ord", "seed", "size"), every=False)
    tree = materialise(apart(reached.select("scan_id", "node_id", "own", "class_name", "w", "h"), walks, "scan_id", "node_id"), "tree")
    release(nodes)
    seeds = tree.where("ups is not null")
    own = seeds.select("scan_id", "seq", F.lit(0).alias("up"), F.col("own").alias("text"), score(F.col("own"), F.col("class_name"), *box).alias("score"))
    ups = seeds.select("scan_id", "seq", F.posexplode("ups").alias("up", "node_id"))
    met = tree.where("below is not null").select("scan_id", F.col("node_id").alias("top"), F.posexplode("below").alias("n", "node_id"))
    lines = apart(met, tree.select("scan_id", "node_id", "own"), "scan_id", "node_id").groupBy("scan_id", "top").agg(F.array_sort(F.collect_list(F.struct("n", "own"))).alias("lines"))
    text = let(F.array_join(F.array_distinct(F.transform("lines", lambda x: x["own"])), "\n"), lambda c: take(c, fixed.SUBTREE_UNITS))
    # A generator, as in analyze: a filter would be pushed below and the text made twice.
    texts = lines.select("scan_id", F.col("top").alias("node_id"), F.explode(F.filter(F.array(text), has_price)).alias("text"))
    scored = apart(texts, tree.select("scan_id", "node_id", "class_name", "w", "h"), "scan_id", "node_id").select("scan_id", "node_id", "text", score(F.col("text"), F.col("class_name"), *box).alias("score"))
    climbed = apart(ups, scored, "scan_id", "node_id").select("scan_id", "seq", (F.col("up") + 1).alias("up"), "text", "score")
    best = own.unionByName(climbed).groupBy("scan_id", "seq").agg(F.max(F.struct("score", (-F.col("up")).alias("near"), "text")).alias("best"))
    good = best.select("scan_id", "seq", F.col("best.text").alias("raw_text")).where(units(F.col("raw_text")).between(*fixed.CANDIDATE_LENGTH))
    return good.groupBy("scan_id", "raw_text").agg(F.min("seq").alias("seq")).select("scan_id", "seq", "raw_text")


def best_scrollable(nodes: DataFrame) -> DataFrame:
    """(scan_id, node_id, score): the scrollable node that is largest, tall and named like a list; the first of equals."""
    nodes = reachable(nodes)
    walks = walked(nodes.select("scan_id", "node_id", "parent_id", "child_ord", F.lit(False).alias("seed"), F.lit(0).alias("size"))).where(F.col("seq") <= fixed.SCROLL_VISITED).select("scan_id", "node_id", "seq")
    tree = apart(nodes.where("scrollable"), walks, "scan_id", "node_id")
    width, height = (F.col("r") - F.col("l")).cast("double"), (F.col("b") - F.col("t")).cast("double")
    value = width * height * F.when(height > width * fixed.TALL, fixed.TALL_FACTOR).otherwise(1.0)
    value = value * F.when(F.lower(F.coalesce("class_name", F.lit(""))).rlike(fixed.SCROLL_CLASS), fixed.SCROLL_FACTOR).otherwise(1.0)
    best = tree.withColumn("score", value).groupBy("scan_id").agg(F.max(F.struct("score", (-F.col("seq")).alias("first"), "node_id")).alias("best"))
    return best.select("scan_id", "best.node_id", "best.score")


def ocr_context(lines: DataFrame) -> DataFrame:
    """(scan_id, block_no, line_no, context): two lines before and after each line with a price, within its block."""
    around = W.partitionBy("scan_id", "block_no").orderBy("line_no").rowsBetween(-fixed.AROUND, fixed.AROUND)
    return lines.withColumn("context", F.array_join(F.collect_list("line_text").over(around), "\n")).where(has_price(F.col("line_text"))).select("scan_id", "block_no", "line_no", "context")


def ocr_candidates(lines: DataFrame) -> DataFrame:
    """(scan_id, block_no, place, raw_text): whole blocks with a price and the contexts of their lines, each text once."""
    blocks = lines.groupBy("scan_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line_text"))).alias("rows"))
    whole = blocks.select("scan_id", "block_no", F.lit(-1).alias("place"), trim(F.array_join(F.transform("rows", lambda x: x["line_text"]), "\n")).alias("raw_text")).where(has_price(F.col("raw_text")))
    every = whole.unionByName(ocr_context(lines).select("scan_id", "block_no", F.col("line_no").alias("place"), F.col("context").alias("raw_text")))
    first = every.groupBy("scan_id", "raw_text").agg(F.min(F.struct("block_no", "place")).alias("at"))
    return first.select("scan_id", "at.block_no", "at.place", "raw_text")


def drop_noise(items: DataFrame, from_tree: Column | bool = True) -> DataFrame:
    """Without items that are sums, taxes or fees: named so, with neither quantity nor calories. For screen trees only."""
    noise = F.lower("raw_text").rlike(fixed.TOTALS) & F.col("quantity").isNull() & F.col("calories").isNull()
    return items.where(~(noise & F.lit(from_tree)))


def node_items(nodes: DataFrame) -> DataFrame:
    """A scan of screen trees from end to end: the items of each scan after the fold, without noise, with item_key and place."""
    items = drop_noise(analysed(node_candidates(nodes)))
    return fold(items, ["scan_id"], ["seq"])


def ocr_items(lines: DataFrame) -> DataFrame:
    """The same of recognised lines; noise stays."""
    texts = ocr_candidates(lines).withColumnRenamed("place", "line")
    return fold(analysed(texts), ["scan_id"], ["block_no", "line"])
