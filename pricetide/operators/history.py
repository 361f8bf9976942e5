"""Keyed change capture: from observations in order of arrival to state and a change-only history.

A listing is a (retailer_id, listing). An observation older than what its listing has
seen is stale and has no effect (equally old is not stale). All operators partition by
listing, so one exchange of the observations serves their windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import rules

KEY = ["retailer_id", "listing"]
ARRIVAL = ["arrival", "seen_at", "price_bani"]
#: Fields that keep their value when an observation doesn't have them.
KEPT = ["seller_name"]


def marked(observations: DataFrame) -> DataFrame:
    """Observations with `outcome`: created, changed, unchanged or stale."""
    before = Window.partitionBy(*KEY).orderBy(*ARRIVAL).rowsBetween(Window.unboundedPreceding, -1)
    late = observations.withColumns({"_seen": F.max("seen_at").over(before)}).withColumn("stale", F.coalesce(F.col("seen_at") < F.col("_seen"), F.lit(False)))
    # stale rows leave the state alone, so what came before is the last row that isn't stale
    last = lambda c: F.last(F.when(~F.col("stale"), F.col(c)), ignorenulls=True).over(before)
    same = F.col("price_bani").eqNullSafe(last("price_bani")) & F.col("in_stock").eqNullSafe(last("in_stock"))
    outcome = F.when(F.col("_seen").isNull(), "created").when(F.col("stale"), "stale").when(same, "unchanged").otherwise("changed")
    return late.withColumn("outcome", outcome).drop("_seen", "stale")


def change_history(observations: DataFrame) -> DataFrame:
    """A row whenever a listing's price or stock changes; a changed former price alone is none."""
    return marked(observations).where(F.col("outcome").isin("created", "changed")).select(*KEY, "arrival", "seen_at", "price_bani", "old_price_bani", "in_stock")


def current_state(observations: DataFrame) -> DataFrame:
    """One row a listing. Former price and stock are the last ones seen; fields in KEPT the last ones there were."""
    order = F.struct(*ARRIVAL)
    last = lambda c: F.max_by(c, order)
    fresh = marked(observations).where("outcome <> 'stale'")
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in KEPT]
    return fresh.groupBy(*KEY).agg(
        *(last(c).alias(c) for c in ("price_bani", "old_price_bani", "in_stock")), *kept, F.min_by("seen_at", order).alias("first_seen_at"), F.max("seen_at").alias("last_seen_at")
    )


def price_drops(history: DataFrame, since: Column, min_pct: float = 10.0, limit: int | None = 50) -> DataFrame:
    """Listings whose latest price, in stock, is at least min_pct below the one before; steepest first."""
    by_time = Window.partitionBy(*KEY).orderBy("seen_at", "arrival")
    latest = Window.partitionBy(*KEY).orderBy(F.desc("seen_at"), F.desc("arrival"))
    rows = history.select(*KEY, "arrival", "seen_at", "price_bani", "in_stock", F.lag("price_bani").over(by_time).alias("previous_bani"), F.row_number().over(latest).alias("_n"))
    drop = F.col("previous_bani") - F.col("price_bani")
    fallen = rows.where("_n = 1 and in_stock").where((F.col("seen_at") >= since) & (drop > 0) & (drop * 100 >= F.col("previous_bani") * min_pct))
    out = fallen.select(*KEY, "previous_bani", "price_bani", N.drop_pct(F.col("previous_bani"), F.col("price_bani")).alias("drop_pct"), "seen_at", (drop / F.col("previous_bani")).alias("_share"))
    out = out.orderBy(F.desc("_share"), *KEY)
    return (out.limit(limit) if limit else out).drop("_share")


def window_from(history: DataFrame, since: Column) -> DataFrame:
    """History rows from `since` on, and the one in effect at that time."""
    following = F.lead("seen_at").over(Window.partitionBy(*KEY).orderBy("seen_at", "arrival"))
    return history.withColumn("_next", following).where((F.col("seen_at") >= since) | F.col("_next").isNull() | (F.col("_next") >= since)).drop("_next")


def chart_series(history: DataFrame, state: DataFrame) -> DataFrame:
    """Points of a step line: each row's price in lei (null out of stock), the last one drawn on to when the listing was last seen."""
    points = history.select(*KEY, "arrival", "seen_at", "price_bani", "in_stock", F.lit(0).alias("extended"))
    order = F.struct("seen_at", "arrival")
    ends = points.groupBy(*KEY).agg(F.max("seen_at").alias("_at"), F.max("arrival").alias("arrival"), F.max_by("price_bani", order).alias("price_bani"), F.max_by("in_stock", order).alias("in_stock"))
    drawn = ends.join(state.select(*KEY, "last_seen_at"), KEY).where("last_seen_at > _at").select(*KEY, "arrival", F.col("last_seen_at").alias("seen_at"), "price_bani", "in_stock", F.lit(1).alias("extended"))
    return points.unionByName(drawn).withColumn("lei", F.when(F.col("in_stock"), F.col("price_bani") / 100)).drop("price_bani", "arrival")


def absences(observations: DataFrame, runs: DataFrame, stale_after: int = rules.STALE_AFTER) -> DataFrame:
    """(listing, run_at, missed_runs, marked) for each complete run that didn't see a listing known before it.

    runs: retailer_id, run_at, until. A miss counts when the run ends; any sighting starts the count
    again. A listing is marked out of stock once, by the miss that makes `stale_after` in a row, if it
    was in stock. Longer streaks go on counting.
    """
    first = observations.groupBy(*KEY).agg(F.min("seen_at").alias("first"))
    seen = observations.select(*KEY, F.col("seen_at").alias("at"), F.lit(0).alias("run"), "arrival", "in_stock", F.lit(None).cast("timestamp").alias("run_at"))
    ends = first.join(runs, "retailer_id").where("run_at > first")
    ended = ends.select(*KEY, F.col("until").alias("at"), F.lit(1).alias("run"), F.lit(0).cast("bigint").alias("arrival"), F.lit(None).cast("boolean").alias("in_stock"), "run_at")
    upto = Window.partitionBy(*KEY).orderBy("at", "run", "arrival").rowsBetween(Window.unboundedPreceding, 0)
    log = seen.unionByName(ended).withColumns({
        "_island": F.sum(1 - F.col("run")).over(upto), "_stock": F.last("in_stock", ignorenulls=True).over(upto),
        "_miss": ((F.col("run") == 1) & (F.max(F.when(F.col("run") == 0, F.col("at"))).over(upto) < F.col("run_at"))).cast("int"),
    })
    streak = F.sum("_miss").over(Window.partitionBy(*KEY, "_island").orderBy("at", "run").rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("missed_runs", streak).where("_miss = 1").select(*KEY, "run_at", "missed_runs", ((F.col("missed_runs") == stale_after) & F.col("_stock")).alias("marked"))


def give_up(fetches: DataFrame, after: int = rules.RATE_LIMIT_GIVE_UP) -> DataFrame:
    """(retailer_id, n): how many fetches a run makes before `after` refusals (429) in a row end it. fetches: retailer_id, n, status."""
    order = Window.partitionBy("retailer_id").orderBy("n")
    island = F.sum(F.when(F.col("status") != 429, 1).otherwise(0)).over(order)
    log = fetches.withColumn("_island", island)
    refused = F.sum(F.when(F.col("status") == 429, 1).otherwise(0)).over(Window.partitionBy("retailer_id", "_island").orderBy("n"))
    log = log.withColumn("_refused", refused)
    stop = F.min(F.when(F.col("_refused") >= after, F.col("n"))).over(Window.partitionBy("retailer_id"))
    return log.withColumn("_stop", stop).where("_stop is null or n <= _stop").groupBy("retailer_id").agg(F.count("*").alias("fetched"), F.max(F.col("_stop").isNotNull()).alias("stopped"))
