"""One retailer's prices against the market's: representatives, lowest and median price, positions, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import rules


def representatives(offers: DataFrame) -> DataFrame:
    """One offer for each product and retailer: in stock before out of stock, then the cheapest, then the lowest id."""
    first = F.min(F.struct((~F.col("in_stock")).alias("out"), "price_bani", "id")).alias("_o")
    return offers.where("product_id is not null").groupBy("product_id", "retailer_id").agg(first).select("product_id", "retailer_id", F.col("_o.price_bani").alias("price_bani"), (~F.col("_o.out")).alias("in_stock"))


def compare(offers: DataFrame, shops: DataFrame) -> DataFrame:
    """Each retailer's price of each product against lowest and median price in stock (half to even)."""
    mine = representatives(offers)
    priced = F.when(F.col("in_stock"), F.col("price_bani"))
    market = mine.groupBy("product_id").agg(F.min(priced).alias("market_min_bani"), F.bround(F.median(priced), 0).cast("bigint").alias("market_median_bani"))
    price, low, mid = F.col("price_bani"), F.col("market_min_bani"), F.col("market_median_bani")
    slugs = F.broadcast(shops.select(F.col("id").alias("retailer_id"), "slug"))
    return mine.join(market, "product_id").join(slugs, "retailer_id").select(
        "product_id", "slug", "price_bani", "in_stock", "market_min_bani", "market_median_bani", N.pct_diff(price, low).alias("vs_min_pct"), N.pct_diff(price, mid).alias("vs_median_pct"),
        F.coalesce(F.col("in_stock") & (price == low), F.lit(False)).alias("is_cheapest"),
    )


def compare_brand(offers: DataFrame, products: DataFrame, brands: DataFrame, shops: DataFrame, brand_key: str) -> DataFrame:
    """`compare` for one brand's products that are offered."""
    own = products.join(F.broadcast(brands.where(F.col("normalized_name") == brand_key).select(F.col("id").alias("brand_id"))), "brand_id", "left_semi")
    return compare(offers.join(own.select(F.col("id").alias("product_id")), "product_id", "left_semi"), shops)


def positions(compared: DataFrame) -> DataFrame:
    """Per retailer: products listed, how often cheapest, mean distance from the median while in stock; over or under the market."""
    distance = F.when(F.col("in_stock"), F.col("vs_median_pct"))
    return compared.groupBy("slug").agg(
        F.count("*").alias("products_listed"), F.count_if("is_cheapest").alias("cheapest_count"), N.round1(F.avg(distance)).alias("avg_vs_median_pct"),
        F.count_if(distance < -rules.MARKET_BAND).alias("under_market"), F.count_if(distance > rules.MARKET_BAND).alias("over_market"),
    ).orderBy("slug")


def retailer_rows(compared: DataFrame, products: DataFrame, slug: str) -> DataFrame:
    """One retailer's products as they are shown."""
    mine = compared.where(F.col("slug") == slug).join(products.select(F.col("id").alias("product_id"), "name", "size_value", "size_unit"), "product_id")
    return mine.select(
        "product_id", "name", N.format_size(F.col("size_value"), F.col("size_unit")).alias("size"), N.format_lei(F.col("price_bani")).alias("price"), N.format_lei(F.col("market_min_bani")).alias("lowest"),
        N.format_lei(F.col("market_median_bani")).alias("median"), N.format_pct(F.col("vs_median_pct")).alias("vs_median"), N.market_position(F.col("vs_median_pct"), F.col("in_stock")).alias("position"), N.heat(F.col("vs_median_pct")).alias("heat"),
    )


def matrix(compared: DataFrame, slugs: list[str]) -> DataFrame:
    """Products by retailers (the columns, named): distance from the median."""
    return compared.groupBy("product_id").pivot("slug", slugs).agg(F.first("vs_median_pct")).orderBy("product_id")
