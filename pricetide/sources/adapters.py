"""The market's relations from star-schema tables: retailers, brands, products, observations, documents.

Every relation is lazy; what a query doesn't use isn't read (column pruning reaches the scan).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import history


@dataclass
class Market:
    """One directory of tables seen as a market."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def retailers(self) -> DataFrame:
        """A supplier each; last crawled when it last shipped."""
        crawled = self.table("lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.max("l_shipdate").cast("timestamp").alias("last_crawled_at"))
        shops = self.table("supplier").select(
            F.col("s_suppkey").alias("id"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"), F.col("s_name").alias("name"),
            (F.col("s_acctbal") >= 0).alias("is_active"), F.lit(24).alias("crawl_interval_hours"),
        )
        return shops.join(crawled, "id", "left")

    @cached_property
    def shops(self) -> DataFrame:
        """Retailers without their crawl times, which cost a scan of all observations."""
        return self.table("supplier").select(F.col("s_suppkey").alias("id"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"), F.col("s_name").alias("name"), (F.col("s_acctbal") >= 0).alias("is_active"))

    @cached_property
    def brands(self) -> DataFrame:
        name = F.col("p_brand")
        return self.table("part").select(name).distinct().select(F.regexp_extract(name, "([0-9]+)", 1).cast("bigint").alias("id"), name.alias("name"), T.brand_key(name).alias("normalized_name"))

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("bigint").alias("brand_id"), F.col("p_name").alias("name"), T.fold(F.col("p_name")).alias("normalized_name"),
            F.col("p_size").cast("decimal(10,3)").alias("size_value"), F.lit("ml").alias("size_unit"), F.col("p_type").alias("category"),
        )

    @cached_property
    def observations(self) -> DataFrame:
        """A line item is one look at a shop's listing of a part."""
        exact = F.col("l_extendedprice") * 100 / F.col("l_quantity")
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("retailer_id"), F.col("l_partkey").alias("listing"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("arrival"), F.col("l_shipdate").cast("timestamp").alias("seen_at"),
            F.round(exact).cast("bigint").alias("price_bani"), F.when(F.col("l_discount") >= 0.05, F.round(exact / (1 - F.col("l_discount"))).cast("bigint")).alias("old_price_bani"),
            (F.col("l_returnflag") != "R").alias("in_stock"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("seller "), F.col("l_linenumber").cast("string"))).alias("seller_name"),
        )

    @cached_property
    def visits(self) -> DataFrame:
        """Events as observations of long histories, arriving in another order than they were made."""
        return self.table("events").select(
            F.col("user_id").alias("retailer_id"), F.col("event_type").alias("listing"), ((F.col("event_id") * 7919) % 1000003).alias("arrival"), F.col("ts").cast("timestamp").alias("seen_at"),
            F.round(F.col("value") * 100).cast("bigint").alias("price_bani"), F.lit(None).cast("bigint").alias("old_price_bani"), (F.col("event_id") % 5 != 0).alias("in_stock"), F.lit(None).cast("string").alias("seller_name"),
        )

    @cached_property
    def history(self) -> DataFrame:
        return history.change_history(self.observations)

    @cached_property
    def offers(self) -> DataFrame:
        """The present state of each listing; a quarter of them isn't linked to a product."""
        state = history.current_state(self.observations)
        linked = F.when((F.col("retailer_id") + F.col("listing")) % 4 != 0, F.col("listing"))
        return state.withColumns({"id": offer_id(), "product_id": linked, "url": F.concat(F.lit("https://shop-"), F.col("retailer_id"), F.lit(".example/p/"), F.col("listing"))})

    @cached_property
    def titles(self) -> DataFrame:
        """A title for each part the way shops write them: with sizes, offers, packs and plus signs."""
        n = F.col("p_partkey")
        size = F.concat_ws(" ", F.col("p_size").cast("string"), F.lit("ml"))
        front = F.when(n % 7 == 0, "PROMO ").when(n % 7 == 1, "[SALE] ").when(n % 7 == 2, "NEW! ").otherwise("")
        tail = F.when(n % 5 == 0, " -20%").when(n % 5 == 1, " + Cadou gel 50 ml").when(n % 5 == 2, " (Reducere 15%)").otherwise("")
        pack = F.when(n % 11 == 0, F.concat(F.lit("2 x "), size)).when(n % 11 == 1, F.concat(size, F.lit(" x 3"))).when(n % 11 == 2, "1,5 l").when(n % 11 == 3, "").otherwise(size)
        marked = F.when(n % 3 == 0, F.concat(F.col("p_name"), F.lit("+"))).otherwise(F.initcap("p_name"))
        return self.table("part").select(n.alias("product_id"), F.col("p_brand").alias("brand"), F.concat(front, F.concat_ws(" ", F.col("p_brand"), marked, F.col("p_type"), pack), tail).alias("title"))


def offer_id() -> Column:
    """One number for (retailer, listing)."""
    return F.col("retailer_id") * 1_000_000_000 + F.col("listing")
