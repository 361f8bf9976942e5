"""When sources are due, why they are skipped, what a run reports, and which pages it can leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_due() -> Column:
    """Null: never crawled, so due."""
    return F.col("last_crawled_at") + F.make_dt_interval(hours=F.col("crawl_interval_hours"))


def due(retailers: DataFrame, as_of: Column) -> DataFrame:
    at = next_due()
    return retailers.select("slug", "is_active", "last_crawled_at", at.alias("next_due_at"), (at.isNull() | (at <= as_of)).alias("is_due"))


def skip_reasons(retailers: DataFrame, as_of: Column, past_deadline: Column) -> DataFrame:
    """Why a run leaves a source out: inactive before not due before out of time; null: it is crawled."""
    late = next_due() > as_of
    reason = F.when(~F.col("is_active"), "retailer is marked inactive").when(late, F.concat(F.lit("not due until "), F.date_format(next_due(), "yyyy-MM-dd HH:mm"))).when(past_deadline, "time limit reached before this retailer's turn")
    return retailers.select("slug", reason.alias("skipped"))


def inactive(retailers: DataFrame, slugs: list[str]) -> DataFrame:
    return retailers.where(F.col("slug").isin(slugs) & ~F.col("is_active")).select("slug")


def unknown(spark_slugs: DataFrame, retailers: DataFrame) -> DataFrame:
    return spark_slugs.join(retailers.select("slug"), "slug", "left_anti")


def run_report(outcomes: DataFrame) -> DataFrame:
    """Per retailer: observations by outcome. outcomes: retailer_id, outcome."""
    return outcomes.groupBy("retailer_id").agg(F.count("*").alias("observations"), *(F.count_if(F.col("outcome") == x).alias(x) for x in ("created", "changed", "unchanged", "stale")))


def run_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("retailers"), *(F.sum(c).alias(c) for c in ("observations", "created", "changed", "unchanged", "stale")))


def report_json(report: DataFrame) -> DataFrame:
    return report.select("retailer_id", F.to_json(F.struct("observations", F.struct("created", "changed", "unchanged", "stale").alias("outcomes"))).alias("json"))


def unseen(pages: DataFrame, offers: DataFrame, since: Column, page_key) -> DataFrame:
    """Pages not among the listings seen since then, by page key."""
    seen = offers.where(F.col("last_seen_at") >= since).select(page_key(F.col("url")).alias("_key")).distinct()
    return pages.withColumn("_key", page_key(F.col("url"))).join(seen, "_key", "left_anti").drop("_key")


def seeded(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """What is there, and of what is wanted the rows whose key isn't."""
    return existing.unionByName(wanted.join(existing.select(key), key, "left_anti").select(existing.columns))
