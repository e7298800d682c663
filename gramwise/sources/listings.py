"""Inputs for the engine from the star schema: listings, recognised lines, screen trees, events, recorded screens."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gramwise.shared import scratch_dir

#: Parts that make up a session, and the places that each has for its listings.
SESSION_PARTS, PLACES = 500, 16

#: A listing's text by p_partkey modulo their number. P is the price; inch, cm, more and few follow from the size.
FORMS = (
    "{name}\n{size} oz\n${P}",
    "{name}\n6 x {size} ml\n${P}",
    "{name}\n{size}0 cal\n${P}\nBuy one get one free",
    "{inch} inch pizza ${P}",
    "{name}\n{size} count\n2 for ${P}",
    "{name} combo\n${P}",
    "{name} {size} g Save $2 Now ${P} Regular $1050.00",
    "{name}\n{size} lb\n${P} BOGO 50% off",
    "{name}\n{size} fl oz\nCA${P}",
    "{name} {size} g €{P}",
    "{name}\n{size} kg\n£{P}",
    "{name}\n{size} l ₹{P}",
    "{name}\n৳{P}\n12 pack",
    "{name}\n{P} USD\npack of {size}",
    "{name}\n{size} g\nUS${P} Buy 2 get 1 free",
    "{name}\n{size} kg\n${P} 20% off",
    "{name}\n{size} - {more} kg\n${P}",
    "{cm} cm pizza ${P}",
    "{few} wings {name}\n${P}",
    "triple {name}\n${P}",
    "double {name}\n${P}",
    "single {name} meal\n${P}",
    "{name} party\n${P}",
    "{name} family\n${P}",
    "{name} xl\n${P}",
    "{name} medium\n${P}",
    "kids {name}\n${P}",
    "Subtotal ${P}",
    "{name}\n1,500 g\n${P}",
    "{name}\n{size} g\nA${P}",
    "{name}\n0 g free\n$0.00 then ${P}",
    "{name} 😀\n{size} g\n${P}",
)

#: What is seen of a part: (scan, place in the scan, every how many-th part, what follows the text). In the first scan come
#: copies that are longer, surer, or longer but less sure than the one before; later scans repeat some.
SEEN = ((1, 0, 1, ""), (1, 1, 7, " ."), (1, 2, 11, " 50 cal"), (1, 3, 11, " ............"), (2, 0, 5, " again"), (3, 0, 4, " ..."))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that parses.
TASK_ROWS = 25_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Dealt anew by a key, as parsing is the costly part: into as many tasks as there are cores, more for large tables. A small
    file, or one of few row groups, is read by few tasks, whatever its number of rows. That number is in the file's footer."""
    tasks = -(-df.count() // TASK_ROWS)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, tasks), key)


def form(text: str) -> Column:
    price = F.col("p_retailprice").cast("decimal(10,2)").cast("string")
    size = F.col("p_size")
    known = {"name": F.col("p_name"), "size": size, "P": price, "inch": size % 10 + 8, "more": size + 1, "cm": size % 10 + 20, "few": size % 9 + 2}
    pieces = [x for x in re.split(r"(\{\w+\})", text) if x]
    return F.concat(*[known[x[1:-1]].cast("string") if x[0] == "{" else F.lit(x) for x in pieces])


def form_of(key: Column) -> Column:
    """The text of a part by its key. Only its own form is put together, not all of which one is then taken."""
    out, v = F.lit(None).cast("string"), (key % len(FORMS)).cast("int")
    for k, text in reversed(list(enumerate(FORMS))):
        out = F.when(v == k, form(text)).otherwise(out)
    return out


def listings_of(part: DataFrame) -> DataFrame:
    """(session_id, scan_id, seq, source_package, raw_text) from part: rows in the order of scans and their places."""
    key = F.col("p_partkey")
    text = form_of(key)
    seen = [F.when(key % every == 0, F.struct(F.lit(scan).cast("long").alias("scan"), F.lit(place).alias("place"), F.lit(more).alias("after"))) for scan, place, every, more in SEEN]
    rows = part.select("p_partkey", text.alias("text"), F.explode(F.array_compact(F.array(*seen))).alias("s"))
    return rows.select(
        F.floor(key / SESSION_PARTS).cast("long").alias("session_id"),
        F.col("s.scan").alias("scan_id"),
        (key * PLACES + (F.col("s.scan") - 1) * 4 + F.col("s.place")).cast("long").alias("seq"),
        F.concat(F.lit("shop."), (key % 3).cast("string")).alias("source_package"),
        F.concat("text", "s.after").alias("raw_text"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings_of(dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), "p_partkey"))


def screen_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A screen tree for each session and scan: a list, below it a card for each listing, below that its lines."""
    rows = listings(spark, sf_dir)
    zero, none = F.lit(0), F.lit(None).cast("string")
    box = lambda r, b: (zero.alias("l"), zero.alias("t"), r.cast("int").alias("r"), b.cast("int").alias("b"))
    scan = (F.col("session_id") * 4 + F.col("scan_id")).alias("scan_id")
    place = (F.col("seq") % (SESSION_PARTS * PLACES)).cast("int")
    size = F.length("raw_text")
    root = rows.groupBy("session_id", "scan_id").agg(F.count("*").alias("n")).select(scan, F.lit(-1).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), zero.alias("child_ord"), none.alias("text"), none.alias("content_desc"), F.lit("androidx.RecyclerView").alias("class_name"), *box(F.lit(400), F.lit(800)), F.lit(True).alias("scrollable"))
    cards = rows.select(scan, (F.col("seq") * 64).alias("node_id"), F.lit(-1).cast("long").alias("parent_id"), place.alias("child_ord"), none.alias("text"), none.alias("content_desc"), F.lit("ui.CardItem").alias("class_name"), *box(F.lit(300), size * 3), (F.col("seq") % 7 == 0).alias("scrollable"))
    lines = rows.select("session_id", "scan_id", "seq", F.posexplode(F.split("raw_text", "\n")).alias("n", "line"))
    leaves = lines.select(scan, (F.col("seq") * 64 + 1 + F.col("n")).alias("node_id"), (F.col("seq") * 64).alias("parent_id"), F.col("n").alias("child_ord"), F.col("line").alias("text"), F.when(F.col("n") == 0, F.col("line")).alias("content_desc"), F.lit("ui.Text").alias("class_name"), *box(F.lit(90), F.lit(20)), F.lit(False).alias("scrollable"))
    return root.unionByName(cards).unionByName(leaves)


#: Groups of sessions that see the same, and the days after which what they see comes again.
GROUPS, PHASES = 5, 12


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, phase, place, raw_text): what a group of sessions has on screen on a day, from part."""
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), "p_partkey")
    key = F.col("p_partkey")
    text = form_of(key)
    return part.select((key % GROUPS).alias("grp"), (F.floor(key / GROUPS) % PHASES).alias("phase"), key.cast("int").alias("place"), text.alias("raw_text"))


NODE = ("scan_id", "node_id", "parent_id", "child_ord", "text", "content_desc", "class_name", "l", "t", "r", "b", "scrollable")


def _node(scan, node, parent, child_ord, text, class_name: str, r, b, scrollable) -> list[Column]:
    values = (scan, node, parent, child_ord, text, None, class_name, 0, 0, r, b, scrollable)
    types = ("long", "long", "long", "int", "string", "string", "string", "int", "int", "int", "int", "boolean")
    return [(v if isinstance(v, Column) else F.lit(v)).cast(t).alias(c) for v, t, c in zip(values, types, NODE, strict=True)]


def wide_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trees, each of a root and a child for each order with its own price, every third of which scrolls: more than a walk
    visits."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    key = F.col("o_orderkey")
    text = F.concat(F.lit("Green tea "), key.cast("string"), F.lit(" g $"), (key % 90 + 1).cast("string"))
    leaves = orders.select(*_node(key % 2, key, -1, key, text, "ui.Text", 10, key % 9973 + 1, key % 3 == 0))
    return spark.range(2).select(*_node(F.col("id"), -1, None, 0, None, "ui.Frame", 4, 4, False)).unionByName(leaves)


def crowded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of four cards each, one for each supplier: a short text with the price, then a line for each line item: short ones
    of even suppliers, long ones of odd. A card has more nodes, and of these more text, than is read."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), "l_orderkey", "l_linenumber").distinct()
    s, key = F.col("s"), F.col("l_orderkey") * 8 + F.col("l_linenumber")
    line = F.when(s % 2 == 0, F.concat(F.lit("w"), key.cast("string"))).otherwise(F.concat(F.lit("a line that says more of order "), key.cast("string"), F.lit(" and what it holds")))
    scan, card = F.floor(s / 4), s * 10_000_000_000
    lines = items.select(*_node(scan, card + 2 + key, card, key, line, "ui.Text", 90, 20, False))
    own = items.select("s").distinct()
    cards = own.select(*_node(scan, card, -1, s % 4, None, "ui.CardItem", 300, 100, False))
    prices = own.select(*_node(scan, card + 1, card, 0, F.concat(F.lit("$"), s.cast("string")), "ui.Text", 90, 20, False))
    roots = own.select(scan.alias("k")).distinct().select(*_node(F.col("k"), -1, None, 0, None, "ui.Frame", 4, 4, False))
    return roots.unionByName(cards).unionByName(prices).unionByName(lines)


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, block_no, line_no, line_text): a block of recognised lines for each listing."""
    rows = listings(spark, sf_dir)
    block = F.concat("raw_text", F.lit("\nview more\nshare\nhelp"))
    return rows.select((F.col("session_id") * 4 + F.col("scan_id")).alias("scan_id"), F.col("seq").alias("block_no"), F.posexplode(F.split(block, "\n")).alias("line_no", "line_text"))


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, event_id, ts, package, own): events as screen events, a user being a session and a type a package."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("package"), (F.col("event_type") == "error").alias("own"))


def scan_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, step, collected): how many items a session has after each step, one for each new whole value. Step 0 is
    the scan before the first scroll."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.floor("value").alias("item"))
    order = W.partitionBy("session_id").orderBy("event_id")
    first = F.row_number().over(W.partitionBy("session_id", "item").orderBy("event_id")) == 1
    marked = events.withColumn("new", first.cast("int"))
    return marked.select("session_id", (F.row_number().over(order) - 1).alias("step"), F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int").alias("collected"))


#: Rows of a recorded session by p_partkey modulo SESSION_PARTS: (place, kind, what it names) before that part's listings.
#: Packages: the first, the app's own and a blank one, which count for nothing, and another. Of the two scan-alls, a passive
#: scan was due when the first began, and none when the second did.
RECORDED = ((0, "event", "shop.a"), (40, "event", "own"), (80, "event", " "), (120, "event", "shop.a"), (200, "event", "shop.b"), (240, "start", ""), (280, "stop", ""), (320, "clear", ""), (400, "start", ""), (450, "stop", ""), (480, "mode", "VOLUME"))
OWN_PACKAGE = "own"
#: Parts of a scan, what scans are in turn, and the parts of a session that make a batch of the stream: scans are split.
SCAN_PARTS, SCAN_KINDS, BATCH_PARTS = 20, ("passive", "all", "hand", "ocr"), 130
BATCHES = -(-SESSION_PARTS // BATCH_PARTS)


def recorded(part: DataFrame) -> DataFrame:
    """(session_id, seq, kind, named, scan_id, raw_text) from part: what happened on screen, control rows between items."""
    key, at = F.col("p_partkey"), F.col("p_partkey") % SESSION_PARTS
    row = lambda kind, place, named="", text=None: F.struct(F.lit(kind).alias("kind"), F.lit(named).alias("named"), F.lit(place).alias("place"), (F.lit(None).cast("string") if text is None else text).alias("text"))
    before = [F.when(at == place, row(kind, -1, named)) for place, kind, named in RECORDED]
    text = form_of(key)
    kind = F.get(F.array(*map(F.lit, SCAN_KINDS)), (F.floor(at / SCAN_PARTS) % len(SCAN_KINDS)).cast("int"))
    items = [row(kind, 0, text=text), F.when(key % 7 == 0, row(kind, 1, text=F.concat(text, F.lit(" ."))))]
    done = F.when(at % SCAN_PARTS == SCAN_PARTS - 1, row("done", 2))
    rows = part.select("p_partkey", F.explode(F.array_compact(F.array(*before, *items, done))).alias("r"))
    return rows.select(
        F.floor(key / SESSION_PARTS).cast("long").alias("session_id"),
        (key * PLACES + 1 + F.col("r.place")).cast("long").alias("seq"),
        F.col("r.kind").alias("kind"),
        F.col("r.named").alias("named"),
        F.floor(key / SCAN_PARTS).cast("long").alias("scan_id"),
        F.col("r.text").alias("raw_text"),
    )


#: Files that a batch has at least, and rows of each for there to be more of them.
FILES, FILE_ROWS = 2, 1_000


def files_of(df: DataFrame, batch: Column, tasks: int, parsed: bool = True) -> int:
    """Files for the batches of `in_batches`: a file is read by one task, so as many as there are cores, more for large tables
    that are parsed. All batches have as many, so that none is read with another; the least one settles how many it can fill."""
    rows = [r["count"] for r in df.groupBy(batch.alias("batch")).count().collect()]
    wanted = max(tasks, -(-max(rows, default=0) // TASK_ROWS)) if parsed else tasks
    return max(FILES, min(wanted, min(rows, default=0) // FILE_ROWS))


def in_batches(df: DataFrame, batch: Column, count: int, files: int = FILES) -> DataFrame:
    """df as a stream of `count` batches and no more, batch k of the rows where batch is k: written to the shared folder file by
    file, as a source would leave them."""
    spark = df.sparkSession
    folder = f"{scratch_dir(spark)}/source-{uuid.uuid4().hex}"
    for k in range(count):
        df.where(batch == k).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def scan_all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, ts, kind): events, and the beginnings and ends of scan-alls between them."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "stop").otherwise("event")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
