"""Text as column expressions: normalising, numbers, prices, names."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from gramwise.functions import fixed

BLANK = r"[\s\x1c-\x1f]"
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def once[T](build: Callable[[], T]) -> Callable[[], T]:
    """build() done once for each JVM: a column as large as a parse is thousands of calls to it."""
    made: list = []

    @wraps(build)
    def get() -> T:
        if not made or made[0] is not SparkContext._gateway:
            made[:] = [SparkContext._gateway, build()]
        return made[1]

    return get


def let(value: Column, use) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def units(c: Column) -> Column:
    """Length in UTF-16 units, as the limits here count it: signs beyond the first 65,536 are two."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def take(c: Column, n: int) -> Column:
    """The first n UTF-16 units, without half a sign."""

    def cut(b: Column) -> Column:
        half = F.substring(b, 2 * n - 1, 1).between(F.lit(b"\xd8"), F.lit(b"\xdb"))
        return F.decode(F.when(half, F.substring(b, 1, 2 * n - 2)).otherwise(F.substring(b, 1, 2 * n)), "UTF-16BE")

    # As many code points at most are as many units or less than what is wanted for all but long texts.
    return F.when(F.length(c) * 2 <= n, c).otherwise(let(F.encode(c, "UTF-16BE"), cut))


def trim(c: Column) -> Column:
    """Without white space at either end, by Unicode's reckoning (F.trim strips spaces only)."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def normalize(c: Column) -> Column:
    """Null becomes empty, runs of blanks one space. Three or more newlines become the letters nn: that is the result
    to match, as are the other rules here."""
    spaced = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\u00a0"), F.lit(" ")), r"[\t\r ]+", " ")
    return trim(F.regexp_replace(spaced, r"\n{3,}", "nn"))


def number(c: Column) -> Column:
    """A number with thousands commas, or with one comma or point; null if it is none."""

    def parsed(raw: Column) -> Column:
        return F.when(F.contains(raw, F.lit(",")) & raw.rlike(fixed.THOUSANDS), F.replace(raw, F.lit(","), F.lit(""))).otherwise(F.replace(raw, F.lit(","), F.lit("."))).try_cast("double")

    return let(trim(c), parsed)


def found(text: Column, pattern: str) -> Column:
    """The pattern's matches with their offsets: array of (m, at). Pieces between matches give the offsets, added up once."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<m:string,at:int>>")

    def step(s: Column, x: Column) -> Column:
        at = s["n"] + F.length(x["p"])
        return F.struct((at + F.length(x["m"])).alias("n"), F.concat(s["out"], F.array(F.struct(x["m"].alias("m"), at.alias("at")))).alias("out"))

    def offsets(every: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(every))
        return F.aggregate(F.arrays_zip(pieces.alias("p"), every.alias("m")), F.struct(F.lit(0).alias("n"), none.alias("out")), step)["out"]

    return let(matches, lambda every: F.when(F.size(every) > 0, offsets(every)).otherwise(none))


def currency(raw: Column) -> Column:
    out = F.lit(fixed.OTHER_CURRENCY)
    for code, signs in reversed(fixed.CURRENCIES):
        test = F.contains(F.upper(raw), F.lit(code))
        for sign in signs:
            test = test | F.contains(raw, F.lit(sign))
        out = F.when(test, F.lit(code)).otherwise(out)
    return out


def prices(normalized: Column) -> Column:
    """All prices above zero: array of (amount, index, currency, raw). The text is normalised already."""
    every = F.transform(found(normalized, fixed.PRICE), lambda x: F.struct(number(F.regexp_extract(x["m"], fixed.PRICE_NUMBER, 0)).alias("amount"), x["at"].alias("index"), currency(x["m"]).alias("currency"), x["m"].alias("raw")))
    return F.filter(every, lambda p: p["amount"] > 0)


def count_prices(normalized: Column) -> Column:
    """How many `prices` finds, without where and in what currency."""
    every = F.transform(F.regexp_extract_all(normalized, F.lit(fixed.PRICE), F.lit(0)), lambda m: number(F.regexp_extract(m, fixed.PRICE_NUMBER, 0)))
    return F.size(F.filter(every, lambda n: n > 0))


def has_price(c: Column) -> Column:
    return c.rlike(fixed.PRICE)


def may_have_price(c: Column) -> Column:
    """False of most texts without a price: those in ASCII with neither a dollar sign nor a currency's code
    after a digit. Quick."""
    return (F.octet_length(c) > F.length(c)) | F.contains(c, F.lit("$")) | c.rlike(fixed.CURRENCY_CODE)


def choose_price(text: Column, every: Column) -> Column:
    """The price that counts: of a bundle, else one named current, else the least that is no saving where a sale is
    hinted at, else the first. Null without prices."""
    several_for = F.contains(F.lower(text), F.lit("for")) | F.contains(text, F.lit("/"))
    bundle = F.when(several_for, F.get(prices(F.regexp_extract(text, fixed.BUNDLE_PRICE, 2)), F.lit(0)))
    current = F.get(prices(F.regexp_extract(text, fixed.CURRENT_PRICE, 1)), F.lit(0))
    start = lambda p: F.greatest(p["index"] - fixed.SAVING_REACH, F.lit(0))
    usable = F.filter(every, lambda p: ~F.substr(text, start(p) + 1, p["index"] - start(p)).rlike(fixed.SAVING_BEFORE))
    least = F.when(text.rlike(fixed.SALE_HINT), F.array_min(usable))
    several = F.when(F.size(every) > 1, F.coalesce(current, least))
    return F.when(F.size(every) > 0, F.coalesce(bundle, several, F.get(every, F.lit(0))))


def item_name(text: Column) -> Column:
    """The first line of a normalised text that is more than a price and no call to act; at most so many units."""
    lines = F.transform(F.split(text, r"\n+"), trim)
    bare = F.transform(F.filter(lines, lambda x: F.length(x) > 0), lambda x: trim(F.regexp_replace(x, fixed.PRICE, "")))
    good = F.filter(bare, lambda x: (units(x) >= fixed.NAME_LEAST) & ~x.rlike(fixed.NOT_A_NAME))
    whole = take(trim(F.regexp_replace(text, fixed.PRICE, "")), fixed.NAME_MOST)
    return F.coalesce(take(F.get(good, F.lit(0)), fixed.NAME_MOST), F.when(F.length(trim(whole)) > 0, whole), F.lit(fixed.UNNAMED))


def canonical_name(name: Column) -> Column:
    out = F.regexp_replace(F.lower(normalize(name)), fixed.PRICE, " ")
    for pattern in (fixed.NAME_AMOUNT, fixed.NAME_NOISE, "[^a-z0-9]+", r"\s+"):
        out = F.regexp_replace(out, pattern, " ")
    return trim(out)


def fixed_point(value: Column, digits: int) -> Column:
    """Rounded half up, as Java's formatter does."""
    return F.format_string(f"%.{digits}f", value)


def money(value: Column, code: Column) -> Column:
    sign = F.lit("$")
    for name, symbol in fixed.SYMBOLS.items():
        sign = F.when(code == name, F.lit(symbol)).otherwise(sign)
    return F.concat(sign, fixed_point(value, 2))
