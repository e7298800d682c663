"""The engine from SQL: temporary functions and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gramwise.functions import analyze, canonical_name, normalize
from gramwise.functions.text import has_price
from gramwise.operators import badge, collected, display_rows, rank, with_metrics
from gramwise.sources import analysed

#: Functions of one text, as the expressions of the library; Spark inlines them.
FUNCTIONS = {"normalized_text": (normalize, "STRING"), "canonical_name": (canonical_name, "STRING"), "has_price": (has_price, "BOOLEAN")}


def as_sql(column: Column) -> str:
    """The text of a column that is made of function calls alone."""
    return column._jc.node().sql()


def register_functions(spark: SparkSession) -> None:
    for name, (build, kind) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {as_sql(build(F.col('t')))}")


def register_views(spark: SparkSession, source: str | DataFrame, mode: str = "SMART") -> None:
    """Views over listings (session_id, scan_id, seq, raw_text), a table, a view or rows.

    items has what is parsed of each listing, with metrics; it is as late as any view. collected, ranked, shown and badges are
    of the listings at the time of this call: they are folded and written for it.
    """
    rows = spark.table(source) if isinstance(source, str) else source
    with_metrics(analyze(rows)).createOrReplaceTempView("items")
    own = collected(analysed(rows))
    own.createOrReplaceTempView("collected")
    ranked = rank(own, mode)
    ranked.createOrReplaceTempView("ranked")
    display_rows(ranked).createOrReplaceTempView("shown")
    badge(own).createOrReplaceTempView("badges")
