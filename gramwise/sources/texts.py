"""Rows analysed by their distinct texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gramwise.functions import analyze
from gramwise.functions.text import has_price
from gramwise.operators.dedupe import item_key
from gramwise.shared import apart, materialise, release
from gramwise.sources.listings import dealt


def analysed(rows: DataFrame) -> DataFrame:
    """`analyze` of a table of rows with raw_text, and item_key: what is on screen is seen again and again, so each distinct text
    is parsed once, and rows are joined to what is found. Rows and what is found are written, so that neither is made twice."""
    # A generator, as in analyze: a filter would be pushed below and the text made twice.
    priced = F.explode(F.filter(F.array("raw_text"), has_price)).alias("_text")
    rows = materialise(rows.select(*[priced if c == "raw_text" else F.col(f"`{c}`") for c in rows.columns]), "rows")
    texts = materialise(rows.select("_text").distinct(), "texts")
    found = materialise(analyze(dealt(texts, "_text").withColumn("raw_text", F.col("_text"))).withColumn("item_key", item_key()), "found")
    release(texts)
    own = [F.col("raw_text") if c == "_text" else F.col(f"`{c}`") for c in rows.columns]
    return apart(rows, found, "_text").select(*own, *[c for c in found.columns if c not in ("_text", "raw_text")])
