"""Goldens: the reference's own test cases and the edge cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from gramwise.functions import analyze, canonical_name, normalize
from gramwise.operators import fold, rank, with_metrics


def items(spark, *texts):
    rows = [(1, 1, i, "shop", t) for i, t in enumerate(texts)]
    return analyze(spark.createDataFrame(rows, "session_id long, scan_id long, seq long, source_package string, raw_text string"))


def one(spark, text):
    return with_metrics(items(spark, text)).first()


def ranked(spark, mode, *texts):
    found = fold(items(spark, *texts), ["session_id"], ["seq"])
    return rank(found, mode).orderBy("rank").collect()


def test_grocery_rank(spark):
    rows = ranked(spark, "MASS", "Honeycrisp apples\n3 lb\n$5.99", "Gala apples\n1.5 kg\n$4.49")
    assert [r["name"] for r in rows] == ["Gala apples", "Honeycrisp apples"]
    assert rows[0]["metric"] == pytest.approx(2.993333, abs=1e-6) and rows[1]["metric"] == pytest.approx(4.401897, abs=1e-6)
    assert rows[0]["metric_label"] == "$2.99/kg"


def test_bogo_calories(spark):
    r = one(spark, "Whopper\n660 cal\n$8.99\nBuy one get one free")
    assert r["promotion"]["type"] == "bogo" and r["calories_per_dollar"] == pytest.approx(2 * 660 / 8.99)


def test_pizza_area(spark):
    a, b = (one(spark, f"{d} inch pizza ${d}.00")["quantity"]["amount_base"] for d in (12, 14))
    assert a == pytest.approx(113.0973, abs=1e-4) and b / a > 1.35


def test_portion_fallback(spark):
    rows = ranked(spark, "PORTION", "Small fries $3.00", "Large fries $4.00")
    assert rows[0]["name"] == "Large fries" and rows[0]["metric"] == pytest.approx(0.325)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Cereal 500 g Save $2 Now $8.99 Regular $10.99", {"price": 8.99}),
        ("TV $1,299.00", {"price": 1.29}),
        ("X $5 CAD", {"currency": "USD/CAD"}),
        ("X 5 CAD", {"currency": "CAD"}),
        ("X A$5", {"currency": "USD/CAD"}),
        ("X C$5", {"currency": "CAD"}),
        ("Milk sale was $10 now only $8", {"price": 8.0}),
        ("Oil Save $2 $9.99 $12", {"price": 9.99}),
        ("Added flavour chips\nBig bag\n$5", {"name": "Big bag"}),
        ("$5", {"name": "Unnamed item"}),
        ("Soda 6 x 200 milliliters $5", {"quantity": None}),
        ('12" pizza $10', {"quantity": None}),
    ],
)
def test_edges(spark, text, expected):
    r = one(spark, text)
    assert {k: r[k] for k in expected} == expected


@pytest.mark.parametrize(
    ("text", "kind", "amount", "confidence"),
    [("Chips 400-500 g $4", "MASS_G", 500, 0.98), ("Soda 12 x 355 ml $6", "VOLUME_ML", 4260, 1.0), ("Rice 1,500 g $3", "MASS_G", 1500, 0.98), ("Water 0 g $1", "MASS_G", 0, 0.98), ("Eggs pack of 12 $3", "COUNT", 12, 0.9)],
)
def test_quantities(spark, text, kind, amount, confidence):
    q = one(spark, text)["quantity"]
    assert (q["kind"], q["amount_base"], q["confidence"]) == (kind, amount, confidence)


@pytest.mark.parametrize(
    ("text", "kind", "label", "multiplier"),
    [
        ("Burger 700 cal $10 BOGO 50% off", "bogo-percent", "Buy 1, get 1 50% off", 2 / 1.5),
        ("Bun $5 BOGO 29% off", "bogo-percent", "Buy 1, get 1 28% off", 2 / 1.71),
        ("Bun $5 BOGO 100% off", "none", "", 1.0),
        ("Bun $5 buy 1 get 1", "none", "", 1.0),
        ("Yogurt 2 for $5 500 g", "bundle", "2 for 5.0", 2.0),
        ("Tea Buy 2 get 1 free $6 300 g", "buy-x-get-y", "Buy 2, get 1", 1.5),
        ("Tea $6 20% off", "percent-off-shown", "20% off", 1.0),
    ],
)
def test_promotions(spark, text, kind, label, multiplier):
    p = one(spark, text)["promotion"]
    assert (p["type"], p["label"]) == (kind, label) and p["received_multiplier"] == pytest.approx(multiplier)


def test_zero_quantity_has_no_metric(spark):
    r = one(spark, "Water 0 g $1")
    assert r["price_per_kg"] is None and r["confidence"] == pytest.approx(0.8464)


def test_rows_without_a_price_go(spark):
    assert items(spark, "hello", None, "").count() == 0


def test_normalize_and_canonical(spark):
    df = spark.createDataFrame([("a\n\n\nb",), (None,), ("  x\t\ty \r",)], "t string")
    assert [r[0] for r in df.select(normalize(F.col("t"))).collect()] == ["annb", "", "x y"]
    names = spark.createDataFrame([("Gala Apples 3 lb $5.99 SALE!",)], "t string")
    assert names.select(canonical_name(F.col("t"))).first()[0] == "gala apples"


def test_smart_mode_without_metrics(spark):
    rows = ranked(spark, "SMART", "Thing one $5", "Thing two $3")
    assert [(r["mode"], r["metric_label"], r["name"]) for r in rows] == [("MASS", "price only", "Thing two"), ("MASS", "price only", "Thing one")]


def test_fold_is_ordered(spark):
    """Three copies of one key: the third survives, at the place of the first, and grouping them otherwise would not do so."""
    q = "struct(cast(null as string) as kind, cast(null as double) as amount_base, cast(null as string) as display, cast(null as double) as confidence, cast(null as double) as diameter_in) as quantity"
    p = "struct('none' as type) as promotion"
    rows = spark.createDataFrame([(1, 1, 0.9, "x" * 10), (1, 2, 0.8, "x" * 20), (1, 3, 0.85, "x" * 5)], "session_id long, seq long, confidence double, raw_text string")
    found = fold(rows.selectExpr("*", "'a' as name", "1.0D as price", q, p), ["session_id"], ["seq"]).collect()
    assert [(r["place"], r["seq"]) for r in found] == [(0, 3)]
