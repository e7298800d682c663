import random
import time

import numpy as np
from pyspark.sql import functions as F

from gramwise.functions import analyze
from gramwise.functions.text import has_price, may_have_price
from gramwise.operators import item_key
from gramwise.plans import QUERIES
from gramwise.sources import best_scrollable, drop_noise, files_of, in_batches, node_candidates, ocr_candidates, texts
from gramwise.sources.screen import Tree, reachable, walked

NODES = "scan_id long, node_id long, parent_id long, child_ord int, text string, content_desc string, class_name string, l int, t int, r int, b int, scrollable boolean"


def test_candidates_climb_to_the_card(spark):
    rows = [
        (1, 1, None, 0, None, None, "list", 0, 0, 400, 800, True),
        (1, 2, 1, 0, None, None, "CardView", 0, 0, 300, 100, False),
        (1, 3, 2, 0, "Gala apples", "Gala apples", "text", 0, 0, 90, 20, False),
        (1, 4, 2, 1, "1 kg", None, "text", 0, 0, 90, 20, False),
        (1, 5, 2, 2, "$4.49", "price", "text", 0, 0, 90, 20, False),
        (1, 6, 1, 1, " ", "Pears $3.00 per bag", "text", 0, 0, 90, 20, False),
    ]
    found = {r["raw_text"] for r in node_candidates(spark.createDataFrame(rows, NODES)).collect()}
    assert "Gala apples\n1 kg\n$4.49\nprice" in found


def test_best_scrollable_first_of_equals(spark):
    rows = [(1, 1, None, 0, None, None, "x", 0, 0, 10, 10, False), (1, 3, 1, 0, None, None, "pane", 0, 0, 100, 100, True), (1, 2, 1, 1, None, None, "pane", 0, 0, 100, 100, True)]
    assert best_scrollable(spark.createDataFrame(rows, NODES)).first()["node_id"] == 3


def test_deep_trees_are_whole(spark):
    rows = [(1, k, k - 1 if k else None, 0, None, None, "x", 0, 0, 10, 10, k == 66) for k in range(67)]
    assert best_scrollable(spark.createDataFrame(rows, NODES).coalesce(1)).first()["node_id"] == 66


def test_a_chain_of_thousands(spark):
    """The price at the bottom of 4,000 levels has seven ancestors, and a walk from the root meets it."""
    chain = [(s, k, k - 1 if k else None, 0, "Tea $6" if k == 3999 else f"n{k}", None, "x", 0, 0, 10, 10, k == 3998) for s in (1, 2) for k in range(4000)]
    start = time.time()
    assert [r["node_id"] for r in best_scrollable(spark.createDataFrame(chain, NODES)).collect()] == [3998, 3998]
    found = node_candidates(spark.createDataFrame(chain, NODES)).collect()
    assert [(r["seq"], r["raw_text"]) for r in found] == [(4000, "n3998\nTea $6")] * 2
    assert time.time() - start < 60


def walk(children, node):
    queue = [node]
    for n in queue:
        queue += children.get(n, [])
    return queue


def test_trees_against_walks():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(1, 40)
        ids = rng.sample(range(100), n)
        rows = [(i, None if k == 0 or rng.random() < 0.05 else rng.choice(ids[:k] if rng.random() < 0.95 else range(200, 300)), rng.randint(0, 3)) for k, i in enumerate(ids)]
        rng.shuffle(rows)
        children = {}
        for i, p, o in sorted(rows, key=lambda r: (r[2], r[0])):
            children.setdefault(p, []).append(i)
        order = [x for x in walk(children, None) if x is not None]
        a = np.array
        tree = Tree(a([r[0] for r in rows]), a([r[1] or 0 for r in rows]), a([r[1] is None for r in rows]), a([r[2] for r in rows]))
        assert tree.ids.tolist() == order
        up = {i: p for i, p, _ in rows}
        for k, i in enumerate(order):
            for most in (1, 3, 99):
                assert tree.ids[tree.below(k, most)].tolist() == walk(children, i)[:most]
            line = [i]
            while up[line[-1]] is not None and len(line) < 5:
                line.append(up[line[-1]])
            row = tree.ancestors(a([k]), 4)[0]
            assert tree.ids[row[row >= 0]].tolist() == line[1:]


def test_wide_parents_lose_what_no_walk_gets_to(spark):
    rows = [(1, 1, None, 0, None, None, "x", 0, 0, 10, 10, False)] + [(1, k, 1, k, f"Tea {k} g $6", None, "x", 0, 0, 1, 1, False) for k in range(2, 6000)]
    nodes = spark.createDataFrame(rows, NODES).repartition(3)
    assert reachable(nodes).count() == 5101
    found = node_candidates(nodes).collect()
    assert len(found) == 4999 and max(r["seq"] for r in found) == 5000


def test_nodes_without_a_root_are_left_out(spark):
    rows = [(1, 1, None, 0, "Tea $6", None, "x", 0, 0, 10, 10, False), (1, 2, 9, 0, "Pears $3", None, "x", 0, 0, 10, 10, False), (1, 3, 4, 0, "Plums $2", None, "x", 0, 0, 1, 1, False), (1, 4, 3, 0, None, None, "x", 0, 0, 1, 1, False)]
    assert [r["raw_text"] for r in node_candidates(spark.createDataFrame(rows, NODES)).collect()] == ["Tea $6"]


def test_limits_of_subtree_texts(spark):
    """At most 100 nodes and about 1,200 units of text below a node; longer texts of a node's own don't count."""
    leaf = lambda i, text: (1, i, 2, i, text, None, "text", 0, 0, 90, 20, False)
    top = [(1, 1, None, 0, None, None, "list", 0, 0, 400, 800, True), (1, 2, 1, 0, None, None, "CardView", 0, 0, 300, 100, False)]
    few = spark.createDataFrame(top + [leaf(3, "Tea $6")] + [leaf(i, f"w{i}") for i in range(4, 150)], NODES)
    assert node_candidates(few).first()["raw_text"].split("\n") == ["Tea $6", *[f"w{i}" for i in range(4, 102)]]
    much = spark.createDataFrame(top + [leaf(3, "Tea $6"), leaf(4, "y" * 500)] + [leaf(i, f"{i}😀" * 60) for i in range(5, 20)], NODES)
    text = node_candidates(much).first()["raw_text"]
    assert "y" not in text and len(text.encode("utf-16-le")) // 2 in (1199, 1200)


def test_ocr_context_is_clipped(spark):
    rows = [(1, 1, i, t) for i, t in enumerate(["Tea $6", "a", "b", "c"])]
    found = {r["raw_text"] for r in ocr_candidates(spark.createDataFrame(rows, "scan_id long, block_no int, line_no int, line_text string")).collect()}
    assert found == {"Tea $6\na\nb\nc", "Tea $6\na\nb"}


def test_noise(spark):
    df = spark.createDataFrame([(1, "Subtotal $20.00"), (2, "Subtotal 500 g $20.00"), (3, "Tea $5")], "seq long, raw_text string")
    assert sorted(r["seq"] for r in drop_noise(analyze(df)).collect()) == [2, 3]


def test_no_side_of_a_tree_goes_through_the_driver(spark):
    """Sides that grow with the input are shuffled, however small they look before they are read."""
    rows = [(s, k, 0 if k else None, k, f"Tea {k} g $6", None, "x", 0, 0, 10, 10, True) for s in range(20) for k in range(9)]
    nodes = spark.createDataFrame(rows, NODES)
    for found in (node_candidates(nodes), best_scrollable(nodes)):
        assert found.collect()
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_subtrees_of_many_nodes_at_once():
    rng = np.random.default_rng(3)
    ids = np.arange(300)
    parents = np.array([0, *(int(rng.integers(max(0, i - 20), i)) for i in range(1, 300))])
    tree = Tree(ids, parents, ids == 0, np.zeros(300, np.int64))
    for most in (1, 7, 100):
        at, met = tree.all_below(np.arange(300), most)
        assert all((met[at == k] == tree.below(k, most)).all() for k in range(300))
        children = {k: [c for c in range(300) if tree.up[c] == k] for k in range(300)}
        assert all(met[at == k].tolist() == walk(children, k)[:most] for k in range(300))


def test_a_wide_parent_is_no_task_of_its_own(spark):
    """The first children are told from parts of all of them."""
    nodes = spark.range(60_000).selectExpr("0L scan_id", "id node_id", "if(id = 0, null, 0L) parent_id", "int(60000 - id) child_ord")
    found = reachable(nodes)
    assert found.where("node_id >= 54900").count() == 5100 and found.count() == 5101
    assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()


def test_walks_leave_what_they_meet(spark):
    """Of a card with 3,000 lines, only those of which its text is made are joined to their texts; all are numbered if wanted."""
    lines = [(1, 2 + k, 1, k, k == 0, 10) for k in range(3000)]
    nodes = spark.createDataFrame([(1, 0, None, 0, False, 0), (1, 1, 0, 0, False, 0), *lines], "scan_id long, node_id long, parent_id long, child_ord int, seed boolean, size int")
    used = {r["node_id"]: r for r in walked(nodes, every=False).collect()}
    every = {r["node_id"]: r for r in walked(nodes).collect()}
    assert len(every) == 3002 and used == {i: every[i] for i in range(101)}


def test_prices_are_looked_for_where_one_may_be(spark):
    """The quick test lets every text with a price through, and few others."""
    rows = [("tea $5",), ("5 cad",), ("12.50\tUsD",), ("3 EUR",), ("5 U\u017fD",), ("\u20b9 5",), ("CA$5",), ("w123456",), ("a line of order 77 and what it holds",), ("USD 5",), ("",), ("5\nInr",)]
    got = spark.createDataFrame(rows, "t string").select("t", has_price(F.col("t")).alias("has"), may_have_price(F.col("t")).alias("may")).collect()
    assert all(r["may"] for r in got if r["has"]) and [r["t"] for r in got if r["has"]] == [rows[k][0] for k in (0, 1, 2, 3, 4, 5, 6, 11)]
    assert not any(r["may"] for r in got if r["t"] in ("w123456", "a line of order 77 and what it holds", "USD 5", ""))


def test_parsing_is_dealt_over_tasks(spark, tmp_path):
    """One row group is read by one task, but not parsed by one."""
    spark.range(60_000).selectExpr("id p_partkey", "'tea' p_name", "5.0 p_retailprice", "1 p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert QUERIES["long_item_names"](spark, str(tmp_path)).rdd.getNumPartitions() >= 4


def test_a_text_is_parsed_once_however_often_it_is_seen(spark, monkeypatch):
    seen = []

    def counted(rows):
        seen.append(rows.count())
        return analyze(rows)

    monkeypatch.setattr(texts, "analyze", counted)
    rows = spark.createDataFrame([(i, ("Gala apples\n1 kg\n$4.49", "no price", None, "Pears  \t$3", "Pears $3")[i % 5]) for i in range(200)], "seq long, raw_text string")
    order = ["seq", "raw_text", "name", "price", "currency", "quantity", "calories", "portion", "promotion", "confidence", "item_key"]
    got, want = texts.analysed(rows), analyze(rows).withColumn("item_key", item_key())
    assert got.columns == want.select("seq", "raw_text", *[c for c in want.columns if c not in ("seq", "raw_text")]).columns
    assert seen == [3]
    assert sorted(map(str, got.select(order).collect())) == sorted(map(str, want.select(order).collect()))
    assert got.count() == 120


def test_a_large_batch_is_read_by_many_tasks(spark):
    """And a small one by as many as can be sure of rows: batches of unequal numbers of files would be mixed."""
    batch = F.floor(F.col("id") / 20_000)
    large = spark.range(40_000)
    files = files_of(large, batch, 6)
    assert (files, files_of(spark.range(20_010), batch, 6)) == (6, 2)
    stream = in_batches(large, batch, 2, files)
    query = stream.writeStream.format("noop").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [20_000, 20_000]
