"""From text to a typed item: promotion, quantity, calories, portion, confidence, all as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gramwise.functions import fixed
from gramwise.functions.text import choose_price, found, item_name, let, normalize, number, once, prices

PROMOTION = "struct<type:string,label:string,received_multiplier:double,min_paid_units:int,effective_price:double>"


def _units(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _has(text: Column, *signs: str) -> Column:
    """Whether one of the signs is in the text: far cheaper than a pattern that needs one."""
    out = F.contains(text, F.lit(signs[0]))
    for sign in signs[1:]:
        out = out | F.contains(text, F.lit(sign))
    return out


def promotion(text: Column, price: Column) -> Column:
    """The first promotion that the normalised, lower-cased text names, as a struct; type none without one."""
    t = text

    def extracted(pattern: str, k: int, *needs: str) -> Column:
        """A group of the pattern's first match; not looked for without one of the signs that it needs."""
        return F.when(_has(t, *needs), F.regexp_extract(t, pattern, k)).otherwise("")

    found_ = F.struct(
        extracted(fixed.BOGO_PERCENT, 1, "%").alias("percent"),
        F.coalesce(extracted(fixed.BUY_GET, 1, "buy").try_cast("int"), F.lit(0)).alias("buy"),
        F.coalesce(extracted(fixed.BUY_GET, 2, "buy").try_cast("int"), F.lit(0)).alias("get"),
        F.coalesce(extracted(fixed.BUNDLE, 1, "for", "/").try_cast("int"), F.lit(0)).alias("count"),
        F.coalesce(number(extracted(fixed.BUNDLE, 2, "for", "/")), F.lit(0.0)).alias("total"),
        extracted(fixed.PERCENT_OFF, 1, "%").alias("off"),
        (_has(t, "bogo", "get", "for") & t.rlike(fixed.BOGO)).alias("bogo"),
        price.alias("price"),
    )
    return let(found_, _offer)


def _offer(x: Column) -> Column:
    """The promotion of what the patterns found, in the order of their tests."""

    def offer(kind: str, label: Column, multiplier: Column, paid: Column, effective: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), label.alias("label"), multiplier.cast("double").alias("received_multiplier"), paid.cast("int").alias("min_paid_units"), effective.alias("effective_price"))

    percent, buy, get, count, total, off, price = (x[c] for c in ("percent", "buy", "get", "count", "total", "off", "price"))
    part = F.least(F.greatest(percent.try_cast("double"), F.lit(0.0)), F.lit(99.0)) / 100.0
    half, more, one = 2.0 / (2.0 - part), F.try_divide(buy.cast("double") + get, buy.cast("double")), F.lit(1.0)
    return (
        F.when(percent != "", offer("bogo-percent", F.concat(F.lit(fixed.BOGO_LABEL + " "), (part * 100).cast("int").cast("string"), F.lit(fixed.OFF_LABEL)), half, F.lit(2), price / half))
        .when(x["bogo"], offer("bogo", F.lit(fixed.BOGO_LABEL), F.lit(2.0), F.lit(1), price / 2.0))
        .when((buy > 0) & (get > 0), offer("buy-x-get-y", F.concat(F.lit(fixed.BUY_LABEL), buy.cast("string"), F.lit(fixed.GET_LABEL), get.cast("string")), more, buy, F.try_divide(price, more)))
        .when((count > 1) & (total > 0), offer("bundle", F.concat(count.cast("string"), F.lit(fixed.FOR_LABEL), total.cast("string")), count, count, F.try_divide(total, count.cast("double"))))
        .when(off != "", offer("percent-off-shown", F.concat(off, F.lit(fixed.OFF_LABEL)), one, F.lit(1), price))
        .otherwise(offer("none", F.lit(""), one, F.lit(1), price))
    )


def _candidate(rank: Column | int, confidence: float, place: Column, kind: Column | str, amount: Column, display: Column, diameter: Column | None = None) -> Column:
    inch = F.lit(None).cast("double") if diameter is None else diameter
    return F.struct(F.lit(rank).alias("rank"), F.lit(confidence).alias("confidence"), (-place).cast("int").alias("place"), F.lit(kind).alias("kind"), amount.cast("double").alias("amount_base"), display.alias("display"), inch.alias("diameter_in"))


def _measured(rows: Column, value, unit, display, confidence: float, base: int) -> Column:
    """Mass or volume candidates of matches; units without a factor give none."""
    factors = _units(fixed.MASS | fixed.VOLUME)

    def one(x: Column, i: Column) -> Column:
        def by_unit(name: Column) -> Column:
            mass = name.isin(*fixed.MASS)
            return _candidate(F.when(mass, 4).otherwise(3), confidence, i + base, F.when(mass, "MASS_G").otherwise("VOLUME_ML"), value(x) * F.try_element_at(factors, name), display(x))

        return let(F.lower(F.regexp_replace(unit(x), r"\s+", " ")), by_unit)

    return F.filter(F.transform(rows, one), lambda c: c["amount_base"].isNotNull())


def quantity(text: Column) -> Column:
    """The best quantity of the normalised, lower-cased text: mass before volume, pizza and count, then the surest, then the
    first."""
    t = text
    group = lambda p, k: lambda x: F.regexp_extract(x, p, k)
    none = F.array().cast("array<string>")
    packs = F.when(_has(t, "x", "×"), F.regexp_extract_all(t, F.lit(fixed.MULTIPACK), F.lit(0))).otherwise(none)
    p1, p2, p3 = (group(fixed.MULTIPACK, k) for k in (1, 2, 3))
    multi = _measured(packs, lambda x: p1(x).try_cast("double") * number(p2(x)), p3, lambda x: F.concat(p1(x), F.lit(" × "), p2(x), F.lit(" "), p3(x)), fixed.PACK_SURE, 0)
    r1, r2, r3 = (group(fixed.RANGE, k) for k in (1, 2, 3))
    ranges = _measured(F.when(_has(t, "-", "–"), F.regexp_extract_all(t, F.lit(fixed.RANGE), F.lit(0))).otherwise(none), lambda x: (number(r1(x)) + number(r2(x))) / 2.0, r3, lambda x: F.concat(r1(x), F.lit("–"), r2(x), F.lit(" "), r3(x), F.lit(" avg")), fixed.RANGE_SURE, 1000)
    start = lambda x: F.greatest(x["at"] - fixed.TIMES_REACH, F.lit(0))
    alone = F.filter(found(t, fixed.SINGLE), lambda x: ~F.substr(t, start(x) + 1, x["at"] - start(x)).rlike(fixed.TIMES_BEFORE))
    s1, s2 = (lambda x, k=k: F.regexp_extract(x["m"], fixed.SINGLE, k) for k in (1, 2))
    single = _measured(alone, lambda x: number(s1(x)), s2, lambda x: F.concat(s1(x), F.lit(" "), s2(x)), fixed.SINGLE_SURE, 2000)
    counts = []
    for k, pattern in enumerate(fixed.COUNTS):
        n = F.regexp_extract(t, pattern, 1).try_cast("double")
        counts.append(let(n, lambda n, k=k: F.when(n > 0, _candidate(1, fixed.COUNT_SURE, F.lit(3000 + k), "COUNT", n, F.concat(n.cast("int").cast("string"), F.lit(" count"))))))
    inches = F.coalesce(number(F.regexp_extract(t, fixed.INCHES, 1)), number(F.regexp_extract(t, fixed.CENTIMETRES, 1)) / 2.54)

    def round_(inch: Column) -> Column:
        area = F.lit(math.pi) * F.pow(inch / 2.0, F.lit(2.0))
        return F.when(inch.between(*fixed.PIZZA_INCHES), _candidate(2, fixed.PIZZA_SURE, F.lit(4000), "PIZZA_AREA_SQIN", area, F.format_string('%.1f" pizza', inch), inch))

    pizza = F.when(_has(t, "pi", "flatbread") & t.rlike(fixed.PIZZA), let(inches, round_))
    best = F.array_max(F.concat(multi, ranges, single, F.filter(F.array(*counts, pizza), lambda c: c.isNotNull())))
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(*[b[c].alias(c) for c in ("kind", "amount_base", "display", "confidence", "diameter_in")])))


def calories(text: Column) -> Column:
    n = number(F.regexp_extract(text, fixed.CALORIES, 1))
    return F.when(_has(F.lower(text), "cal") & (n > 0), n)


def portion(text: Column) -> Column:
    """Portion points of a lower-cased text with a confidence and what they rest on; null without any sign of a portion."""
    t = text
    count = F.regexp_extract(t, fixed.FOOD_UNITS, 1).try_cast("double")
    # All words that say something of a portion, found at once; then they are tested in order.
    said = F.regexp_extract_all(t, F.lit(fixed.PORTION_WORDS), F.lit(0))
    # Most texts say nothing of it: for them nothing is tested.
    return let(F.struct(said.alias("said"), count.alias("count")), lambda x: F.when((F.size(x["said"]) > 0) | x["count"].isNotNull(), _portion(x["said"], x["count"])))


def _portion(said: Column, count: Column) -> Column:
    counted = count.between(1.0, 100.0)
    names = lambda words: F.arrays_overlap(said, F.array(*map(F.lit, words)))
    points, sure, basis = F.lit(None).cast("double"), F.lit(fixed.PORTION_SURE), F.lit("")
    for words, p, c in reversed(fixed.SERVINGS):
        hit = names(words)
        points, sure, basis = F.when(hit, p).otherwise(points), F.when(hit, c).otherwise(sure), F.when(hit, F.lit(words[0])).otherwise(basis)
    points, sure = F.when(counted, count).otherwise(points), F.when(counted, fixed.FOOD_SURE).otherwise(sure)
    basis = F.when(counted, F.concat(count.cast("int").cast("string"), F.lit(fixed.FOOD_LABEL))).otherwise(basis)
    factor, label = F.lit(None).cast("double"), F.lit(None).cast("string")
    for words, f, name in reversed(fixed.SIZES):
        hit = names(words)
        factor, label = F.when(hit, f).otherwise(factor), F.when(hit, F.lit(name)).otherwise(label)

    def joined(now: Column, more: Column) -> Column:
        return F.when(now == "", more).otherwise(F.concat(now, F.lit(" + "), more))

    sized = factor.isNotNull()
    points, sure, basis = F.when(sized, F.coalesce(points, F.lit(1.0)) * factor).otherwise(points), F.when(sized, F.greatest(sure, F.lit(fixed.SIZE_SURE))).otherwise(sure), F.when(sized, joined(basis, label)).otherwise(basis)
    meal = names(fixed.MEAL)
    points, sure, basis = F.when(meal, F.coalesce(points, F.lit(1.0)) * fixed.MEAL_FACTOR).otherwise(points), F.when(meal, F.greatest(sure, F.lit(fixed.MEAL_SURE))).otherwise(sure), F.when(meal, joined(basis, F.lit(fixed.MEAL_LABEL))).otherwise(basis)
    return F.when(points.isNotNull(), F.struct(points.alias("points"), sure.alias("confidence"), basis.alias("basis")))


@once
def _parsed() -> tuple[Column, dict[str, Column], Column, Column]:
    """Of raw_text, normalised: its price; then of it, _price and _lower: what analyze adds."""
    t, low, price = F.col("raw_text"), F.col("_lower"), let(prices(F.col("raw_text")), lambda every: choose_price(F.col("raw_text"), every))
    sure = F.lit(fixed.SURE) + F.coalesce(fixed.SURE_QUANTITY * F.col("quantity.confidence"), F.lit(0.0))
    sure = sure + F.when(F.col("calories").isNotNull(), fixed.SURE_CALORIES).otherwise(0.0)
    sure = sure + F.when(F.col("promotion.type") != "none", fixed.SURE_PROMOTION).otherwise(0.0)
    found_ = {"price": F.col("_price.amount"), "currency": F.col("_price.currency"), "name": item_name(t), "quantity": quantity(low), "calories": calories(t), "portion": portion(low)}
    return price, found_, promotion(low, F.col("price")), F.least(sure, F.lit(fixed.SURE_MOST))


def analyze(listings: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Adds name, price, currency, quantity, calories, portion, promotion and confidence; raw_text becomes normalised.

    Rows without a usable price go before the costlier parsing.
    """
    price, found_, offer, sure = _parsed()
    cheap = listings.where(F.col(text_col).rlike(fixed.PRICE)).withColumn("raw_text", normalize(F.col(text_col)))
    # A generator rather than a filter: it drops rows without a price, and the parse isn't pushed below and done again.
    priced = cheap.select("*", F.explode(F.filter(F.array(price), lambda p: p.isNotNull())).alias("_price")).withColumn("_lower", F.lower("raw_text"))
    out = priced.withColumns(found_).withColumn("promotion", offer)
    return out.withColumn("confidence", sure).drop("_price", "_lower")
