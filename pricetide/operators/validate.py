"""Observations and tables checked: what is wrong with a row, and which rows break a table's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T


def cleaned(raw: DataFrame) -> DataFrame:
    """Text with white space collapsed and empty as null, identifiers checked, a former price that isn't higher dropped.

    raw: retailer, url, title, price_bani, old_price_bani, currency, brand, ean, size_value, size_unit (more columns stay).
    """
    text = {c: F.nullif(T.collapsed(F.col(c)), F.lit("")) for c in ("retailer", "url", "title", "currency", "brand")}
    return raw.withColumns(text | {"ean": N.gtin(F.col("ean")), "old_price_bani": F.when(F.col("old_price_bani") > F.col("price_bani"), F.col("old_price_bani"))})


def errors() -> Column:
    """What is wrong with a cleaned observation, in order; empty: it is valid."""
    tests = {
        "retailer": F.col("retailer").isNull(),
        "url": ~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)),
        "title": F.col("title").isNull(),
        "price": ~F.coalesce(F.col("price_bani") >= 0, F.lit(False)),
        "currency": ~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False)),
        "size": (F.col("size_value").isNull() != F.col("size_unit").isNull()) | F.coalesce(F.col("size_value") <= 0, F.lit(False)) | F.coalesce(~F.col("size_unit").isin("ml", "l", "g", "kg", "buc"), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(bad, name) for name, bad in tests.items())))


def checked(raw: DataFrame) -> DataFrame:
    return cleaned(raw).withColumn("errors", F.array_join(errors(), ","))


def split(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected observations."""
    rows = checked(raw)
    return rows.where("errors = ''").drop("errors"), rows.where("errors <> ''")


def duplicates(table: DataFrame, *key: str) -> DataFrame:
    """Keys that several rows have, nulls apart."""
    known = table.where(" and ".join(f"{c} is not null" for c in key))
    return known.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def violations(table: DataFrame, rules: dict[str, str]) -> DataFrame:
    """How many rows break each rule (SQL conditions that must not be false)."""
    counted = table.agg(*(F.count_if(F.expr(f"not coalesce({test}, true)")).alias(name) for name, test in rules.items()))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules))))


def snapshot(rows: DataFrame) -> DataFrame:
    """Valid observations under the names of stored listings."""
    return rows.withColumnsRenamed({"brand": "brand_name"})
