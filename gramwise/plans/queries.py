"""The engine's queries over the star schema, and SQL that gets the same rows from the tables' columns.

The SQL doesn't parse text: listings are derived from columns of part, so what parsing should find is known. `KNOWN` has it
for each form of a listing; folds, caps and ranks are written in SQL from their rules.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gramwise.functions import analyze, calories, canonical_name, choose_price, fixed, item_name, normalize, portion, prices, promotion, quantity
from gramwise.functions.text import fixed_point, let
from gramwise.operators import badge, collected, display_rows, fold, keep_last, rank, smart_mode, with_metrics
from gramwise.plans.sql import register_functions, register_views
from gramwise.shared import scratch_dir
from gramwise.sources import analysed, best_scrollable, crowded_nodes, dealt, drop_noise, files_of, in_batches, listings, node_candidates, node_items, ocr_candidates, ocr_context, ocr_items, ocr_lines, recorded, scan_all_events, scan_events, scan_sizes, screen_nodes, screens, table, wide_nodes
from gramwise.sources.listings import BATCH_PARTS, BATCHES, FORMS, GROUPS, OWN_PACKAGE, PHASES, SEEN, SESSION_PARTS
from gramwise.streaming import buckets_of, collect_stream, collections, debounced, display, look_stream, looked, package_sessions, passive_scans, scan_all_stops, screen_items, seen, stop_of_scan_all, tasks_of, with_ends
from gramwise.streaming.collect import LOOKED_UP

#: The pause after which a scan runs in queries over events, in microseconds: events are hours apart.
PAUSE = 6 * 3_600_000_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).withColumn("t", normalize(F.col("raw_text")))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(listings(spark, sf_dir))


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumn("raw_text", F.concat(F.lit(" \t"), F.replace("raw_text", F.lit("\n"), F.lit("\n\n\n")), F.lit("  x \r")))
    return rows.select("seq", normalize(F.col("raw_text")).alias("t"))


@query
def extract_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).select("seq", F.posexplode(prices(F.col("t"))).alias("n", "p"))
    return rows.select("seq", "n", "p.amount", "p.index", "p.currency", "p.raw")


@query
def choose_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).withColumn("p", let(prices(F.col("t")), lambda every: choose_price(F.col("t"), every))).select("seq", "p.amount", "p.currency")


@query
def promotion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).withColumn("price", let(prices(F.col("t")), lambda every: choose_price(F.col("t"), every))["amount"])
    return rows.withColumn("p", promotion(F.lower("t"), F.col("price"))).select("seq", "p.*")


@query
def quantity_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).withColumn("q", quantity(F.lower("t"))).select("seq", "q.kind", "q.amount_base", "q.display", "q.confidence", "q.diameter_in")


@query
def calories_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("seq", calories(F.col("t")).alias("calories"))


@query
def portion_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).withColumn("p", portion(F.lower("t"))).select("seq", "p.points", "p.confidence", "p.basis")


@query
def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("seq", item_name(F.col("t")).alias("name"))


@query
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("seq", canonical_name(item_name(F.col("t"))).alias("canonical"))


@query
def analyze_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("session_id", "seq", "name", "price", "currency", F.col("quantity.kind").alias("kind"), "calories", F.col("portion.points").alias("points"), F.col("promotion.type").alias("promotion"), "confidence")


@query
def dedupe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collected(_items(spark, sf_dir)).select("session_id", "place", "seq", "scan_id", "name", "price", "confidence")


@query
def dedupe_in_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(_items(spark, sf_dir), ["session_id", "scan_id"], ["seq"]).select("session_id", "scan_id", "place", "seq", "name")


@query
def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_metrics(_items(spark, sf_dir)).select("seq", "price_per_kg", "price_per_l", "calories_per_dollar", "pizza_area_per_dollar", "price_per_unit", "portion_points_per_dollar")


@query
def smart_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smart_mode(with_metrics(collected(_items(spark, sf_dir))))


def _ranked(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rank(collected(_items(spark, sf_dir)), mode).select("session_id", "rank", "seq", "name", "price", "metric", "metric_label", "mode")

    return run


for _mode in ("MASS", "VOLUME", "CALORIE", "PIZZA", "UNIT", "PORTION", "SMART"):
    QUERIES[f"rank_{_mode.lower()}"] = _ranked(_mode)


@query
def rank_one_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listings as one session, which no cap holds down: ranked over all tasks."""
    items = _items(spark, sf_dir).withColumns({"session_id": F.lit(0).cast("long"), "place": F.col("seq")})
    return rank(items, "MASS", spread=True).select("session_id", "rank", "seq", "name", "price", "metric", "metric_label", "mode")


@query
def sql_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each session, asked for in SQL."""
    register_views(spark, listings(spark, sf_dir), "CALORIE")
    return spark.sql("SELECT r.session_id, r.rank, r.name, r.metric_label, b.badge, i.calories FROM ranked r JOIN badges b USING (session_id) JOIN items i ON i.seq = r.seq WHERE r.rank <= 10")


@query
def sql_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of texts, in SQL."""
    register_functions(spark)
    listings(spark, sf_dir).createOrReplaceTempView("listing_texts")
    return spark.sql("SELECT seq, normalized_text(concat('  ', raw_text, ' ')) AS t, canonical_name(substring_index(raw_text, '\\n', 1)) AS canonical, has_price(raw_text) AS priced FROM listing_texts WHERE instr(raw_text, '\\n') > 0")


@query
def top60_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display_rows(rank(collected(_items(spark, sf_dir)), "MASS"))


@query
def badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badge(collected(_items(spark, sf_dir)))


@query
def fifo_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_last(collected(_items(spark, sf_dir)), 100).select("session_id", "place", "name")


@query
def ocr_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_context(ocr_lines(spark, sf_dir))


@query
def ocr_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_candidates(ocr_lines(spark, sf_dir))


@query
def node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_candidates(screen_nodes(spark, sf_dir)).select("scan_id", "raw_text")


@query
def scroll_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_scrollable(screen_nodes(spark, sf_dir))


@query
def wide_scan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of more nodes than a walk visits."""
    return node_candidates(wide_nodes(spark, sf_dir)).select("scan_id", "seq", "raw_text")


@query
def wide_scroll_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_scrollable(wide_nodes(spark, sf_dir))


@query
def crowded_card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of more nodes and more text than is read."""
    return node_candidates(crowded_nodes(spark, sf_dir)).select("scan_id", "raw_text")


@query
def long_item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names longer than what is taken of them, in UTF-16 units."""
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), "p_partkey")
    text = F.concat(F.repeat(F.concat(F.when(F.col("p_partkey") % 2 == 0, "😀").otherwise("x"), "p_name", F.lit("-")), F.lit(30)), F.lit("\n$"), F.col("p_retailprice").cast("decimal(10,2)").cast("string"))
    return part.select(F.col("p_partkey").alias("seq"), item_name(normalize(text)).alias("name"))


@query
def badge_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of more items than a badge shows."""
    return badge(listings(spark, sf_dir).withColumn("session_id", F.col("scan_id")))


@query
def node_scan_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen trees from end to end: candidates, parsing, noise, fold, automatic mode and rank, by scan."""
    items = node_items(screen_nodes(spark, sf_dir)).withColumnRenamed("scan_id", "session_id")
    return rank(items).select("session_id", "rank", "place", "name", "price", "metric", "metric_label", "mode")


@query
def ocr_scan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines from end to end, up to the fold of each scan."""
    return ocr_items(ocr_lines(spark, sf_dir)).select("scan_id", "place", "block_no", "name", "price", F.col("quantity.kind").alias("kind"), "confidence")


def _streamed(stream: DataFrame, buckets: int | None = None) -> DataFrame:
    """All that a stream in append mode writes, after it has read what there is. Where its state is in buckets, these settle its
    tasks: a stream takes the setting that it is started with."""
    spark, partitions = stream.sparkSession, "spark.sql.shuffle.partitions"
    folder, before = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}", spark.conf.get(partitions)
    if buckets:
        spark.conf.set(partitions, tasks_of(buckets, spark))
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    finally:
        spark.conf.set(partitions, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded screens streamed through the collection, in batches that split scans."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    batch = F.floor(F.col("p_partkey") % SESSION_PARTS / BATCH_PARTS)
    stream = in_batches(part, batch, BATCHES, files_of(part, batch, spark.sparkContext.defaultParallelism))
    return collections(_streamed(collect_stream(recorded(stream), OWN_PACKAGE)))


@query
def collected_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collections(spark, sf_dir).select("session_id", "place", "seq", "item_key", "mode", "smart")


@query
def shown_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display(_collections(spark, sf_dir)).select("session_id", "rank", "title", "metric_text")


def _timed(rows: DataFrame, gap_us: int, buckets: int) -> DataFrame:
    """Rows of (session_id, seq, ts, kind) by weeks as a stream through the debounce. Two more batches of rows of no session, enough
    for all files of a batch, let all pauses pass: the first takes the watermark on, with the second what was due runs."""
    of_week = F.floor(F.dayofmonth("ts") / 7).cast("int")
    files = files_of(rows, of_week, rows.sparkSession.sparkContext.defaultParallelism, parsed=False)
    last, k, each = rows.agg(F.max(F.unix_micros("ts"))).first()[0], F.col("id"), 2 * files
    ends = rows.sparkSession.range(0, 2 * each, 1, 1).select(F.lit(-1).cast("long").alias("session_id"), k.alias("seq"), (F.timestamp_micros(F.lit(last)) + (F.floor(k / each) + 1) * F.expr("INTERVAL 60 DAYS")).alias("ts"), F.lit("stop").alias("kind"))
    week = F.when(F.col("session_id") == -1, F.floor(F.col("seq") / each).cast("int") + 5).otherwise(of_week)
    return passive_scans(in_batches(rows.unionByName(ends), week, 7, files), gap_us, buckets=buckets)


@query
def debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`debounce_scans` by timers, as a stream."""
    events = scan_all_events(spark, sf_dir).withColumn("kind", F.lit("event"))
    buckets = buckets_of(events)
    return _streamed(_timed(events, PAUSE, buckets), buckets)


@query
def passive_scan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same while all is being scanned now and then."""
    events = scan_all_events(spark, sf_dir)
    buckets = buckets_of(events)
    return _streamed(_timed(events, PAUSE, buckets), buckets)


@query
def events_to_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream from events to collections: pauses let passive scans run, these see what is on screen that day, and a session
    keeps its last hundred items; what went may come back."""
    events = scan_all_events(spark, sf_dir).withColumn("kind", F.lit("event"))
    buckets = buckets_of(events)
    scans = _timed(events, PAUSE, buckets)
    scans = scans.withColumns({"grp": F.col("session_id") % GROUPS, "phase": F.floor(F.col("last_us") / 86_400_000_000) % PHASES})
    what, on, cap = screens(spark, sf_dir), ["grp", "phase"], 100
    items = screen_items(what, on, cap)
    if items.count() <= LOOKED_UP:
        return looked(_streamed(look_stream(scans, items, on, cap, buckets), buckets), items).select("session_id", "place", "seq", "item_key")
    found = collections(_streamed(collect_stream(seen(scans, with_ends(what, on), on), cap=cap)))
    return found.where("place is not null").select("session_id", "place", "seq", "item_key")


@query
def stale_stop_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`stale_stop` as a stream of five batches of steps."""
    sizes = scan_sizes(spark, sf_dir)
    return _streamed(scan_all_stops(in_batches(sizes, F.least(F.floor(F.col("step") / 13), F.lit(4)), 5)))


@query
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    amount = F.concat(F.lit("$"), (F.floor(F.col("o_totalprice")) % 90000 + 1).cast("string"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Subtotal "), amount)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Order total 500 g "), amount)).otherwise(F.concat(F.lit("Green tea "), amount))
    return drop_noise(analyze(orders.select(F.col("o_orderkey").alias("seq"), text.alias("raw_text")))).select("seq", "raw_text", "price")


@query
def package_session_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package_sessions(scan_events(spark, sf_dir)).select("session_id", "event_id", "session_no")


@query
def debounce_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounced(scan_events(spark, sf_dir), "6 hours").select("session_id", "n_events", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query
def stale_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_of_scan_all(scan_sizes(spark, sf_dir))


@query
def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 8).alias("v"))
    return values.select("l_orderkey", "l_linenumber", fixed_point(F.col("v"), 2).alias("two"), fixed_point(F.col("v"), 1).alias("one"))


def _rounded(value: str, digits: int) -> str:
    """Text rounded half up from the shortest decimal form."""
    return f"CAST(CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DECIMAL(30, {digits})) AS VARCHAR)"


def _sql_text(text: str) -> str:
    """A form as a SQL expression."""
    known = {"name": "p_name", "size": "p_size", "P": "digits", "inch": "8 + p_size % 10", "more": "p_size + 1", "cm": "20 + p_size % 10", "few": "2 + p_size % 9"}
    quoted = lambda x: " || chr(10) || ".join(f"'{y}'" for y in x.split("\n"))
    return " || ".join(f"CAST({known[x[1:-1]]} AS VARCHAR)" if x[0] == "{" else quoted(x) for x in re.split(r"(\{\w+\})", text) if x)


_MASS, _SINGLE = "MASS_G", 0.98
#: What parsing finds in each form, as SQL, where it isn't what DEFAULT says. name: of the form without what follows it;
#: plain: the canonical name; alone: the text is one line, so that what follows becomes part of the name.
DEFAULT = {"cur": "'USD/CAD'", "raw": "'$' || digits", "kind": "NULL", "amount": "NULL", "display": "NULL", "qconf": "NULL", "inch": "NULL", "cal": "NULL", "promo": "'none'", "label": "''", "mult": "1.0::DOUBLE", "paid": "1",
           "name": "p_name", "plain": "p_name", "alone": "false", "base": "NULL", "bconf": "NULL", "basis": "NULL", "size": "own_size", "size_name": "own_size_name", "meal": "false"}


def _measure(kind: str, factor: str, unit: str, conf: float = _SINGLE, said: str = "p_size") -> dict[str, str]:
    return {"kind": f"'{kind}'", "amount": f"({said}) * {factor}::DOUBLE", "display": f"CAST({said} AS VARCHAR) || ' {unit}'", "qconf": f"{conf}::DOUBLE"}


def _count(said: str) -> dict[str, str]:
    return {"kind": "'COUNT'", "amount": f"({said}) * 1.0::DOUBLE", "display": f"CAST({said} AS VARCHAR) || ' count'", "qconf": "0.9::DOUBLE"}


def _pizza(said: str, unit: str, inch: str) -> dict[str, str]:
    name = f"CAST({said} AS VARCHAR) || ' {unit} pizza'"
    return {"kind": "'PIZZA_AREA_SQIN'", "inch": inch, "amount": f"pi() * pow({inch} / 2.0::DOUBLE, 2)", "display": f"{_rounded(inch, 1)} || '\" pizza'", "qconf": "0.9::DOUBLE", "name": name, "plain": name, "alone": "true", "size": "NULL", "size_name": "NULL"}


def _money(code: str, sign: str) -> dict[str, str]:
    return {"cur": f"'{code}'", "raw": f"'{sign}' || digits"}


def _serving(word: str, points: float, conf: float) -> dict[str, str]:
    return {"base": f"{points}::DOUBLE", "bconf": f"{conf}::DOUBLE", "basis": f"'{word}'", "name": f"'{word} ' || p_name", "plain": f"'{word} ' || p_name"}


def _sized(name: str, factor: float, said: str, before: str) -> dict[str, str]:
    """before: the sizes of a part's own name that are looked for before this one."""
    own = f"own_size_name IN ({before})"
    return {"size": f"CASE WHEN {own} THEN own_size ELSE {factor}::DOUBLE END", "size_name": f"CASE WHEN {own} THEN own_size_name ELSE '{said}' END", "name": name, "plain": name}


def _known() -> tuple[dict[str, str], ...]:
    return (
    _measure(_MASS, "28.349523125", "oz"),
    {**_measure("VOLUME_ML", "6.0", "ml", 1.0), "display": "'6 × ' || p_size || ' ml'"},
    {"cal": "p_size * 10.0::DOUBLE", "promo": "'bogo'", "label": "'Buy 1, get 1'", "mult": "2.0::DOUBLE"},
    _pizza("8 + p_size % 10", "inch", "CAST(8 + p_size % 10 AS DOUBLE)"),
    {**_count("p_size"), "promo": "'bundle'", "label": "'2 for ' || CAST(price AS VARCHAR)", "mult": "2.0::DOUBLE", "paid": "2"},
    {"meal": "true", "name": "p_name || ' combo'", "plain": "p_name || ' combo'"},
    {**_measure(_MASS, "1.0", "g"), "alone": "true", "name": "p_name || ' ' || p_size || ' g Save  Now  Regular'", "plain": "p_name || ' save now regular'"},
    {**_measure(_MASS, "453.59237", "lb"), "promo": "'bogo-percent'", "label": "'Buy 1, get 1 50% off'", "mult": "2.0::DOUBLE / 1.5::DOUBLE", "paid": "2"},
    {**_measure("VOLUME_ML", "29.5735295625", "fl oz"), **_money("CAD", "CA$")},
    {**_measure(_MASS, "1.0", "g"), **_money("EUR", "€"), "alone": "true", "name": "p_name || ' ' || p_size || ' g'"},
    {**_measure(_MASS, "1000.0", "kg"), **_money("GBP", "£")},
    {**_measure("VOLUME_ML", "1000.0", "l"), **_money("INR", "₹")},
    {**_count("12"), **_money("BDT", "৳")},
    {**_count("p_size"), "cur": "'USD'", "raw": "digits || ' USD'"},
    {**_measure(_MASS, "1.0", "g"), **_money("USD", "US$"), "promo": "'buy-x-get-y'", "label": "'Buy 2, get 1'", "mult": "1.5::DOUBLE", "paid": "2"},
    {**_measure(_MASS, "1000.0", "kg"), "promo": "'percent-off-shown'", "label": "'20% off'"},
    _measure(_MASS, "1000.0", "kg", said="p_size + 1"),
    _pizza("20 + p_size % 10", "cm", "((20 + p_size % 10) * 1.0::DOUBLE / 2.54::DOUBLE)"),
    {"base": "(2 + p_size % 9) * 1.0::DOUBLE", "bconf": "0.72::DOUBLE", "basis": "CAST(2 + p_size % 9 AS VARCHAR) || ' food units'", "name": "CAST(2 + p_size % 9 AS VARCHAR) || ' wings ' || p_name", "plain": "CAST(2 + p_size % 9 AS VARCHAR) || ' wings ' || p_name"},
    _serving("triple", 3.0, 0.66),
    _serving("double", 2.0, 0.64),
    {**_serving("single", 1.0, 0.60), "meal": "true", "name": "'single ' || p_name || ' meal'", "plain": "'single ' || p_name || ' meal'"},
    _sized("p_name || ' party'", 2.2, "party", "''"),
    _sized("p_name || ' family'", 1.8, "family", "''"),
    _sized("p_name || ' xl'", 1.55, "extra large", "''"),
    _sized("p_name || ' medium'", 1.0, "medium", "'large'"),
    _sized("'kids ' || p_name", 0.65, "kids/junior", "'large', 'small'"),
    {"alone": "true", "name": "'Subtotal'", "plain": "'subtotal'", "size": "NULL", "size_name": "NULL"},
    {**_measure(_MASS, "1.0", "g", said="1500"), "display": "'1,500 g'"},
    {**_measure(_MASS, "1.0", "g"), "raw": "'A$' || digits"},
    _measure(_MASS, "1.0", "g", said="0"),
    {**_measure(_MASS, "1.0", "g"), "name": "p_name || ' 😀'"},
    )


def _case(column: str) -> str:
    return "CASE v " + " ".join(f"WHEN {v} THEN {known[column]}" for v, known in enumerate(_known()) if column in known) + f" ELSE {DEFAULT[column]} END AS k_{column}"


def _truth() -> str:
    seen = " UNION ALL ".join(f"SELECT *, CAST({scan} AS BIGINT) AS scan_id, {place} AS place, '{more}' AS more FROM part WHERE p_partkey % {every} = 0" for scan, place, every, more in SEEN)
    text = "CASE v " + " ".join(f"WHEN {v} THEN {_sql_text(f)}" for v, f in enumerate(FORMS)) + " END"
    fold = "lambda a, b: CASE WHEN b.c > a.c OR b.n > a.n THEN b ELSE a END"
    states = [f"s1 AS (SELECT session_id, item_key, held, born AS pos FROM o WHERE scan_id = 1 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY born DESC) <= 500)"]
    for k in (2, 3):
        states.append(f"""s{k} AS (SELECT session_id, item_key, held, now AS pos FROM (SELECT session_id, item_key, CASE WHEN s.held IS NULL THEN o.held WHEN o.held IS NULL THEN s.held WHEN o.held.c > s.held.c OR o.held.n > s.held.n THEN o.held ELSE s.held END AS held,
            coalesce(s.pos, {k} * 1000000000000 + o.born) AS now FROM s{k - 1} s FULL JOIN (SELECT * FROM o WHERE scan_id = {k}) o USING (session_id, item_key))
            QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY now DESC) <= 500)""")
    return f"""
WITH b AS ({seen}),
f AS (SELECT p_partkey, p_partkey // 500 AS session_id, scan_id, p_partkey * 16 + (scan_id - 1) * 4 + place AS seq, p_partkey % {len(FORMS)} AS v, p_name, p_size, more, p_retailprice AS price,
             CAST(CAST(p_retailprice AS DECIMAL(10, 2)) AS VARCHAR) AS digits, CASE split_part(p_name, ' ', 1) WHEN 'small' THEN 0.8::DOUBLE WHEN 'large' THEN 1.3::DOUBLE END AS own_size,
             CASE WHEN split_part(p_name, ' ', 1) IN ('small', 'large') THEN split_part(p_name, ' ', 1) END AS own_size_name FROM b),
t AS (SELECT *, {text} || more AS raw_text, {", ".join(map(_case, DEFAULT))} FROM f),
u AS (SELECT *, k_kind AS kind, k_amount AS amount, k_display AS display, k_qconf AS qconf, k_inch AS diameter, k_promo AS promo, k_label AS promo_label, k_mult AS mult, k_paid AS paid, k_cur AS currency,
             k_raw AS said, coalesce(k_cal, CASE WHEN more = ' 50 cal' THEN 50.0::DOUBLE END) AS cal, k_name || CASE WHEN k_alone AND more <> '' THEN ' ' || more ELSE '' END AS name,
             k_plain || CASE WHEN k_alone AND more = ' again' THEN ' again' ELSE '' END AS canonical,
             CASE WHEN k_base IS NOT NULL OR k_size IS NOT NULL OR k_meal THEN coalesce(k_base, 1.0) * coalesce(k_size, 1.0) * CASE WHEN k_meal THEN 1.35::DOUBLE ELSE 1.0 END END AS points,
             CASE WHEN k_base IS NOT NULL OR k_size IS NOT NULL OR k_meal THEN greatest(coalesce(k_bconf, 0.45::DOUBLE), CASE WHEN k_size IS NOT NULL THEN 0.55::DOUBLE ELSE 0 END, CASE WHEN k_meal THEN 0.5::DOUBLE ELSE 0 END) END AS pconf,
             nullif(concat_ws(' + ', k_basis, k_size_name, CASE WHEN k_meal THEN 'meal' END), '') AS basis FROM t),
x AS (SELECT *, price / mult AS effective, CASE currency WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' WHEN 'INR' THEN '₹' WHEN 'BDT' THEN '৳' ELSE '$' END AS sign,
             least(0.67::DOUBLE + coalesce(0.18::DOUBLE * qconf, 0) + CASE WHEN cal IS NOT NULL THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN promo <> 'none' THEN 0.03::DOUBLE ELSE 0 END, 0.99::DOUBLE) AS confidence FROM u),
m AS (SELECT *, CASE WHEN kind = 'MASS_G' AND amount > 0 THEN price / ((amount * mult) / 1000.0::DOUBLE) END AS kg, CASE WHEN kind = 'VOLUME_ML' THEN price / ((amount * mult) / 1000.0::DOUBLE) END AS litre,
        CASE WHEN cal > 0 THEN cal * mult / price END AS cpd, CASE WHEN kind = 'PIZZA_AREA_SQIN' THEN amount * mult / price END AS apd,
        CASE WHEN kind = 'COUNT' THEN price / (amount * mult) END AS unit, CASE WHEN points > 0 THEN points * mult / price END AS ppd,
        concat_ws('|', canonical, digits, coalesce(kind, 'null'), CAST(coalesce(trunc(amount), 0) AS BIGINT), promo) AS item_key FROM x),
o AS (SELECT session_id, scan_id, item_key, min(seq) AS born, list_reduce(list({{'c': confidence, 'n': length(raw_text), 'seq': seq}} ORDER BY seq), {fold}) AS held FROM m GROUP BY ALL),
{", ".join(states)},
d AS (SELECT m.*, row_number() OVER (PARTITION BY s3.session_id ORDER BY s3.pos) - 1 AS spot FROM s3 JOIN m ON m.session_id = s3.session_id AND m.seq = s3.held.seq)
"""


def _metric(mode: str) -> tuple[str, str, str]:
    column, less, label = {
        "MASS": ("kg", True, "sign || {} || '/kg'"), "VOLUME": ("litre", True, "sign || {} || '/L'"), "CALORIE": ("cpd", False, "{} || ' cal/$'"),
        "PIZZA": ("apd", False, "{} || ' in²/$'"), "UNIT": ("unit", True, "sign || {} || '/unit'"), "PORTION": ("ppd", False, "{} || ' est. portion/$'"),
    }[mode]
    return column, column if less else f"-{column}", label.format(_rounded(column, 1 if mode in ("CALORIE", "PIZZA") else 2))


_MODES = ("MASS", "VOLUME", "CALORIE", "PIZZA", "UNIT", "PORTION")


def _smart(source: str) -> str:
    """CTEs up to g (session_id, mode): the automatic mode of the items of source."""
    return f"""c AS (SELECT session_id, count(kg) AS "0", count(litre) AS "1", count(cpd) AS "2", count(apd) AS "3", count(unit) AS "4", count(ppd) AS "5" FROM {source} GROUP BY ALL),
        un AS (SELECT session_id, CAST(name AS INT) AS o, value AS n FROM (UNPIVOT c ON "0", "1", "2", "3", "4", "5")),
        g AS (SELECT session_id, {list(_MODES)}[o + 1] AS mode FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n >= 2 DESC, n DESC, o) AS r FROM un) WHERE r = 1)"""


def _rank_sql(mode: str, select: str = "session_id, rank, seq, name, price, metric, metric_label, mode", where: str = "true", source: str = "d", ctes: str = "") -> str:
    """mode: one of them, SMART, or the name of a column that has it."""
    if mode in _MODES:
        smart, rows, (metric, key, label) = "", f"(SELECT *, '{mode}' AS mode FROM {source})", _metric(mode)
    else:
        pick = lambda k: "CASE mode " + " ".join(f"WHEN '{m}' THEN {_metric(m)[k]}" for m in _MODES) + " END"
        own = "g.mode" if mode == "SMART" else f"CASE {mode} WHEN 'SMART' THEN g.mode ELSE {mode} END"
        smart, rows, metric, key, label = ", " + _smart(source), f"(SELECT z.*, {own} AS mode FROM {source} z JOIN g USING (session_id))", pick(0), pick(1), pick(2)
    return f"""{_truth()}{ctes}{smart}, k AS (SELECT *, {metric} AS metric, {key} AS sort, coalesce({label}, 'price only') AS metric_label FROM {rows}),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sort NULLS LAST, CASE WHEN metric IS NULL THEN price END, spot) AS rank FROM k)
        SELECT {select} FROM r WHERE {where}"""


_SHOWN = """session_id, rank, rank || '. ' || name AS title, metric_label || CASE WHEN promo <> 'none' THEN ' · ' || promo_label ELSE '' END AS metric_text,
    concat_ws(' · ', sign || digits, display, CAST(trunc(cal) AS INT) || ' cal', CAST(trunc(confidence * 100) AS INT) || '%') AS meta, rank = 1 AND metric_label <> 'price only' AS best"""

_OCR = """, l AS (SELECT session_id * 4 + scan_id AS scan_id, seq AS block_no, raw_text || nl || 'view more' || nl || 'share' || nl || 'help' AS block FROM (SELECT *, chr(10) AS nl FROM x)),
    w AS (SELECT scan_id, block_no, block, string_split(block, chr(10)) AS lines, unnest(range(len(string_split(block, chr(10))))) AS line_no FROM l),
    z AS (SELECT scan_id, block_no, CAST(line_no AS INT) AS line_no, block, array_to_string(lines[greatest(line_no - 1, 1):line_no + 3], chr(10)) AS context FROM w
          WHERE regexp_matches(lines[line_no + 1], '[$€£₹৳][0-9]|[0-9] USD'))"""

#: The items of a scan's tree: each text once, without sums, folded.
_NODES = """, e1 AS (SELECT session_id * 4 + scan_id AS sid, min(seq) AS seq, raw_text FROM m WHERE v <> 27 OR cal IS NOT NULL GROUP BY ALL),
    e2 AS (SELECT e1.sid, m.item_key, min(seq) AS born, list_reduce(list({'c': m.confidence, 'n': length(m.raw_text), 'seq': seq} ORDER BY seq), lambda a, b: CASE WHEN b.c > a.c OR b.n > a.n THEN b ELSE a END) AS held
           FROM e1 JOIN m USING (seq) GROUP BY ALL),
    e AS (SELECT m.* EXCLUDE (session_id), e2.sid AS session_id, row_number() OVER (PARTITION BY e2.sid ORDER BY e2.born) - 1 AS spot FROM e2 JOIN m ON m.seq = e2.held.seq)"""

#: What the stream has at the end: rows after the last change of package or clearing, of scans that ended and counted: passive
#: ones but the first of the second scan-all, those of scan-alls, by hand, of recognised lines; only these keep sums. A stop
#: splits the scan that is open. Each scan is folded, then added to what was there.
_STREAM = """, q AS (SELECT session_id, p_partkey % 500 AS born, max(p_partkey % 500) OVER (PARTITION BY session_id) AS most, m.* EXCLUDE (session_id, seq), p_partkey * 16 + 1 + place AS seq,
                     p_partkey % 500 // 20 AS scan, p_partkey % 500 // 20 % 4 AS scan_kind
              FROM (SELECT *, seq % 16 AS place FROM m WHERE scan_id = 1 AND (more = '' OR more = ' .')) m),
    lives AS (SELECT session_id, any_value(CASE WHEN most >= 480 THEN 'VOLUME' ELSE 'SMART' END) AS own_mode FROM q GROUP BY ALL),
    h AS (SELECT *, CASE WHEN most >= 480 THEN 'VOLUME' ELSE 'SMART' END AS own_mode, CASE WHEN scan = 22 AND born >= 450 THEN 22.5 ELSE scan END AS run FROM q
          WHERE born >= CASE WHEN most >= 320 THEN 320 WHEN most >= 200 THEN 200 ELSE 0 END AND scan * 20 + 19 <= most
                AND (scan_kind > 1 OR scan_kind = 0 AND scan <> 20 OR scan IN (13, 21)) AND (v <> 27 OR scan_kind = 3)),
    h1 AS (SELECT session_id, run, item_key, min(seq) AS born, list_reduce(list({'c': confidence, 'n': length(raw_text), 'seq': seq} ORDER BY seq), lambda a, b: CASE WHEN b.c > a.c OR b.n > a.n THEN b ELSE a END) AS held FROM h GROUP BY ALL),
    h2 AS (SELECT session_id, item_key, min(born) AS born, list_reduce(list(held ORDER BY run), lambda a, b: CASE WHEN b.c > a.c OR b.n > a.n THEN b ELSE a END) AS held FROM h1 GROUP BY ALL),
    st AS (SELECT h.*, row_number() OVER (PARTITION BY h2.session_id ORDER BY h2.born) - 1 AS spot FROM h2 JOIN h ON h.session_id = h2.session_id AND h.seq = h2.held.seq)"""

#: Passive scans row by row: what is due (first, last, n), and what a row lets run.
_PASSIVE = """WITH RECURSIVE e AS (SELECT user_id AS session_id, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop' ELSE 'event' END AS kind,
                                row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    s AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS r, false AS scanning, CAST(0 AS BIGINT) AS first_us, CAST(0 AS BIGINT) AS last_us, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ran, CAST(0 AS BIGINT) AS ran_first, CAST(0 AS BIGINT) AS ran_last FROM e
          UNION ALL
          SELECT session_id, r, CASE kind WHEN 'start' THEN true WHEN 'stop' THEN false ELSE scanning END, CASE WHEN counts AND due = 0 THEN us ELSE first_us END, CASE WHEN counts THEN us ELSE last_us END,
                 CASE WHEN kind = 'stop' THEN 0 WHEN counts THEN due + 1 ELSE due END, n - due, first_us, last_us
          FROM (SELECT e.session_id, e.r, e.us, e.kind, s.scanning, s.first_us, s.last_us, s.n, e.kind = 'event' AND NOT s.scanning AS counts, CASE WHEN e.us - s.last_us > 21600000000 THEN 0 ELSE s.n END AS due
                FROM s JOIN e ON e.session_id = s.session_id AND e.r = s.r + 1))
    SELECT session_id, ran_first AS first_us, ran_last AS last_us, ran AS n_events FROM s WHERE ran > 0
    UNION ALL SELECT session_id, first_us, last_us, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY r DESC) AS back FROM s) WHERE back = 1 AND n > 0"""

_TRUTH = _truth()

SQL = {
    "normalize_text": _TRUTH + r"SELECT seq, replace(raw_text, chr(10), 'nn') || ' x' AS t FROM x",
    "extract_prices": _TRUTH + r"""SELECT seq, CAST(n AS INT) AS n, CASE WHEN v = 6 AND n <> 1 THEN CAST(substr(raw, 2) AS DOUBLE) ELSE price END AS amount, CAST(instr(raw_text, raw) - 1 AS INT) AS "index", currency, raw
        FROM (SELECT seq, v, price, currency, raw_text, unnest(CASE WHEN v = 6 THEN ['$2', said, '$1050.00'] ELSE [said] END) AS raw, unnest(CASE WHEN v = 6 THEN [0, 1, 2] ELSE [0] END) AS n FROM x)""",
    "choose_prices": _TRUTH + "SELECT seq, price AS amount, currency FROM x",
    "promotion_rules": _TRUTH + 'SELECT seq, promo AS "type", promo_label AS label, mult AS received_multiplier, paid AS min_paid_units, effective AS effective_price FROM x',
    "quantity_best": _TRUTH + "SELECT seq, kind, amount AS amount_base, display, qconf AS confidence, diameter AS diameter_in FROM x",
    "calories_found": _TRUTH + "SELECT seq, cal AS calories FROM x",
    "portion_points": _TRUTH + "SELECT seq, points, pconf AS confidence, basis FROM x",
    "item_names": _TRUTH + "SELECT seq, name FROM x",
    "canonical_names": _TRUTH + "SELECT seq, canonical FROM x",
    "analyze_listings": _TRUTH + "SELECT session_id, seq, name, price, currency, kind, cal AS calories, points, promo AS promotion, confidence FROM x",
    "dedupe_items": _TRUTH + "SELECT session_id, CAST(spot AS INT) AS place, seq, scan_id, name, price, confidence FROM d",
    "dedupe_in_scan": _TRUTH + "SELECT o.session_id, o.scan_id, CAST(row_number() OVER (PARTITION BY o.session_id, o.scan_id ORDER BY o.born) - 1 AS INT) AS place, m.seq, m.name FROM o JOIN m ON m.session_id = o.session_id AND m.seq = o.held.seq",
    "metric_values": _TRUTH + "SELECT seq, kg AS price_per_kg, litre AS price_per_l, cpd AS calories_per_dollar, apd AS pizza_area_per_dollar, unit AS price_per_unit, ppd AS portion_points_per_dollar FROM m",
    "smart_modes": _TRUTH + ", " + _smart("d") + "SELECT session_id, mode FROM g",
    **{f"rank_{m.lower()}": _rank_sql(m) for m in (*_MODES, "SMART")},
    "rank_one_session": _rank_sql("MASS", source="(SELECT * EXCLUDE (session_id), CAST(0 AS BIGINT) AS session_id, seq AS spot FROM m)"),
    "sql_ranked": _rank_sql("CALORIE", "session_id, rank, name, metric_label, badge, cal AS calories", "rank <= 10", source="(SELECT *, least(count(*) OVER (PARTITION BY session_id), 999) AS badge FROM d)"),
    "sql_text_functions": _TRUTH + "SELECT seq, raw_text AS t, CASE v WHEN 22 THEN p_name || ' party' ELSE trim(regexp_replace(regexp_replace(lower(split_part(raw_text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) END AS canonical, true AS priced FROM x WHERE contains(raw_text, chr(10))",
    "top60_rows": _rank_sql("MASS", _SHOWN, "rank <= 60"),
    "badges": _TRUTH + "SELECT session_id, least(count(*), 999) AS badge FROM d GROUP BY session_id",
    "fifo_cap": _TRUTH + "SELECT session_id, CAST(spot AS INT) AS place, name FROM d QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY spot DESC) <= 100",
    "ocr_contexts": _TRUTH + _OCR + "SELECT scan_id, block_no, line_no, context FROM z",
    "ocr_texts": _TRUTH + _OCR + """,
        e AS (SELECT scan_id, block_no, -1 AS place, block AS raw_text FROM l UNION ALL SELECT scan_id, block_no, line_no, context FROM z)
        SELECT scan_id, block_no, place, raw_text FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, raw_text ORDER BY block_no, place) AS r FROM e) WHERE r = 1""",
    "node_texts": _TRUTH + "SELECT DISTINCT session_id * 4 + scan_id AS scan_id, raw_text FROM x",
    "scroll_targets": _TRUTH + """, n AS (
            SELECT DISTINCT session_id * 4 + scan_id AS scan_id, -1 AS node_id, 0 AS o, 400 * 800 * 1.4::DOUBLE * 1.35::DOUBLE AS score FROM x
            UNION ALL SELECT session_id * 4 + scan_id, seq * 64, 1 + seq % 8000, CAST(300 * (length(raw_text) * 3) AS DOUBLE) * CASE WHEN length(raw_text) * 3 > 300 * 0.55::DOUBLE THEN 1.4::DOUBLE ELSE 1.0 END FROM x WHERE seq % 7 = 0)
        SELECT scan_id, node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, o) AS r FROM n) WHERE r = 1""",
    "wide_scan_texts": """SELECT o_orderkey % 2 AS scan_id, seq + 1 AS seq, 'Green tea ' || o_orderkey || ' g $' || (o_orderkey % 90 + 1) AS raw_text
        FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) AS seq FROM orders) WHERE seq < 5000""",
    "wide_scroll_targets": """WITH n AS (SELECT o_orderkey, o_orderkey % 9973 + 1 AS height, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) AS seq FROM orders),
        s AS (SELECT *, 10 * height * CASE WHEN height > 5.5 THEN 1.4::DOUBLE ELSE 1.0 END AS score FROM n WHERE seq < 4000 AND o_orderkey % 3 = 0)
        SELECT o_orderkey % 2 AS scan_id, o_orderkey AS node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY score DESC, seq) AS r FROM s) WHERE r = 1""",
    # A card, its price, then lines: 100 nodes, or all before 1,200 signs of text are met.
    "crowded_card_texts": """WITH n AS (SELECT DISTINCT l_suppkey AS s, l_orderkey * 8 + l_linenumber AS k FROM lineitem),
        t AS (SELECT s, k, CASE WHEN s % 2 = 0 THEN 'w' || k ELSE 'a line that says more of order ' || k || ' and what it holds' END AS line FROM n UNION ALL SELECT DISTINCT s, 0, '$' || s FROM n),
        c AS (SELECT *, row_number() OVER w + 1 AS n, sum(length(line) + 1) OVER w - length(line) - 1 AS before FROM t WINDOW w AS (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING))
        SELECT s // 4 AS scan_id, left(string_agg(line, chr(10) ORDER BY k), 1200) AS raw_text FROM c WHERE n <= 100 AND before < 1200 GROUP BY s""",
    # A sign beyond the first 65,536 is two units, and half a sign isn't taken.
    "long_item_names": """SELECT seq, CASE WHEN seq % 2 = 1 THEN left(name, 120) ELSE list_aggregate(list_transform(list_filter(range(1, 121), lambda i: i + length(regexp_replace(left(name, CAST(i AS INT)), '[^😀]', '', 'g')) <= 120), lambda i: substr(name, i, 1)), 'string_agg', '') END AS name
        FROM (SELECT p_partkey AS seq, repeat(CASE WHEN p_partkey % 2 = 0 THEN '😀' ELSE 'x' END || p_name || '-', 30) AS name FROM part)""",
    "badge_limit": _TRUTH + "SELECT scan_id AS session_id, least(count(*), 999) AS badge FROM x GROUP BY scan_id",
    "node_scan_ranked": _rank_sql("SMART", "session_id, rank, CAST(spot AS INT) AS place, name, price, metric, metric_label, mode", source="e", ctes=_NODES),
    "ocr_scan_items": _TRUTH + """SELECT o.session_id * 4 + o.scan_id AS scan_id, CAST(row_number() OVER (PARTITION BY o.session_id, o.scan_id ORDER BY o.born) - 1 AS INT) AS place, m.seq AS block_no, m.name, m.price, m.kind, m.confidence
        FROM o JOIN m ON m.session_id = o.session_id AND m.seq = o.held.seq""",
    "collected_stream": _TRUTH + _STREAM + ", " + _smart("st") + """SELECT session_id, CAST(spot AS INT) AS place, seq, item_key, lives.own_mode AS mode, coalesce(g.mode, 'MASS') AS smart
        FROM lives LEFT JOIN st USING (session_id) LEFT JOIN g USING (session_id)""",
    "shown_stream": _rank_sql("own_mode", "session_id, rank, rank || '. ' || name AS title, metric_label || CASE WHEN promo <> 'none' THEN ' · ' || promo_label ELSE '' END AS metric_text", "rank <= 60", source="st", ctes=_STREAM)
        + f" UNION ALL SELECT session_id, 0, '{fixed.NOTHING_YET}', '' FROM lives WHERE session_id NOT IN (SELECT session_id FROM st)",
    "noise_filter": """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 1 THEN 'Order total 500 g $' ELSE 'Green tea $' END || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90000 + 1 AS VARCHAR) AS raw_text,
        CAST(CAST(floor(o_totalprice) AS BIGINT) % 90000 + 1 AS DOUBLE) AS price FROM orders WHERE o_orderkey % 3 <> 0""",
    "package_session_numbers": """WITH e AS (SELECT user_id AS session_id, event_id, ts, event_type AS p FROM events WHERE event_type <> 'error' AND trim(event_type) <> ''),
        c AS (SELECT *, coalesce(CAST(lag(p) OVER (PARTITION BY session_id ORDER BY ts, event_id) <> p AS INT), 0) AS changed FROM e)
        SELECT session_id, event_id, CAST(sum(changed) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS session_no FROM c""",
    "debounce_scans": """WITH e AS (SELECT user_id AS session_id, epoch_us(ts) AS us FROM events),
        c AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY session_id ORDER BY us) > 21600000000 THEN 1 ELSE 0 END AS n FROM e),
        r AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM c)
        SELECT session_id, count(*) AS n_events, min(us) AS first_us, max(us) AS last_us FROM r GROUP BY session_id, run""",
    "passive_scan_stream": _PASSIVE,
    # Scan after scan: what is held stays or is replaced where it stands, what is new follows, and the last hundred stay.
    "events_to_collection": _TRUTH.replace("WITH b AS", "WITH RECURSIVE b AS", 1) + """, ev AS (SELECT user_id AS session_id, epoch_us(ts) AS us FROM events),
        gaps AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY session_id ORDER BY us) > 21600000000 THEN 1 ELSE 0 END AS g FROM ev),
        runs AS (SELECT *, sum(g) OVER (PARTITION BY session_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
        scans AS (SELECT session_id, last_us, row_number() OVER (PARTITION BY session_id ORDER BY last_us) AS step, session_id % 5 AS grp, last_us // 86400000000 % 12 AS phase
                  FROM (SELECT session_id, run, max(us) AS last_us FROM runs GROUP BY ALL)),
        own AS (SELECT p_partkey % 5 AS grp, p_partkey // 5 % 12 AS phase, item_key, min(p_partkey) AS born,
                       list_reduce(list({'k': item_key, 'c': confidence, 'n': length(raw_text), 'seq': p_partkey} ORDER BY p_partkey), lambda a, b: CASE WHEN b.c > a.c OR b.n > a.n THEN b ELSE a END) AS held
                FROM m WHERE scan_id = 1 AND more = '' AND v <> 27 GROUP BY ALL),
        what AS (SELECT grp, phase, list(held ORDER BY born) AS items FROM own GROUP BY ALL),
        todo AS (SELECT session_id, step, list_transform(items, lambda x: {'k': x.k, 'c': x.c, 'n': x.n, 'seq': last_us // 1000 * 1000000 + x.seq}) AS items FROM scans JOIN what USING (grp, phase)),
        kept AS (SELECT session_id, step, items[-100:] AS held FROM todo WHERE step = 1
                 UNION ALL
                 SELECT session_id, step, (list_transform(held, lambda h: coalesce(list_filter(items, lambda x: x.k = h.k AND (x.c > h.c OR x.n > h.n))[1], h))
                                           || list_filter(items, lambda x: NOT list_contains(list_transform(held, lambda h: h.k), x.k)))[-100:]
                 FROM (SELECT t.session_id, t.step, t.items, k.held FROM kept k JOIN todo t ON t.session_id = k.session_id AND t.step = k.step + 1)),
        ends AS (SELECT session_id, held FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step DESC) AS back FROM kept) WHERE back = 1)
        SELECT session_id, CAST(i AS INT) AS place, held[i + 1].seq AS seq, held[i + 1].k AS item_key FROM (SELECT *, unnest(range(len(held))) AS i FROM ends)""",
    "stale_stop": """WITH e AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step,
            CAST(row_number() OVER (PARTITION BY user_id, floor(value) ORDER BY event_id) = 1 AS INT) AS new FROM events),
        c AS (SELECT *, sum(new) OVER w AS collected, step - max(CASE WHEN new = 1 THEN step END) OVER w AS stale FROM e WINDOW w AS (PARTITION BY session_id ORDER BY step ROWS UNBOUNDED PRECEDING))
        SELECT session_id, CAST(step AS INT) AS step, CAST(collected AS INT) AS collected, CAST(stale AS INT) AS stale_rounds
        FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step) AS r FROM c WHERE step >= 90 OR stale >= 5) WHERE r = 1""",
    "formatted_values": f"SELECT l_orderkey, l_linenumber, {_rounded('l_extendedprice / 8', 2)} AS two, {_rounded('l_extendedprice / 8', 1)} AS one FROM lineitem",
}
SQL["debounce_stream"] = SQL["debounce_scans"]
SQL["stale_stop_stream"] = SQL["stale_stop"]
