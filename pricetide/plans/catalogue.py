"""Every query by name: how Spark does it, and the same for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import numbers as N
from ..functions import rules
from ..functions import text as T
from ..operators import catalog as C
from ..operators import history as H
from ..operators import market as M
from ..operators import matching as E
from ..operators import schedule as S
from ..operators import validate as V
from ..sources import pages as P
from ..sources import web
from ..sources.adapters import Market
from .relations import PARTS, round1, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Times as microseconds, decimals as doubles: values that compare alike everywhere."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, Ty.TimestampType):
            out[f.name] = F.unix_micros(f.name)
        elif isinstance(f.dataType, Ty.DecimalType):
            out[f.name] = F.col(f.name).cast("double")
    return df.withColumns(out) if out else df


def query(oracle: str | None = None, name: str | None = None):
    def register(run: Callable[[Market], DataFrame]):
        key = name or run.__name__
        QUERIES[key] = lambda spark, path: flat(run(Market(spark, path)))
        if oracle:
            ORACLES[key] = oracle
        return run

    return register


def at(text: str):
    return F.lit(text).cast("timestamp")


# --- change capture, history, drops -----------------------------------------------------

DROPS = """select retailer_id, listing, previous_bani, price_bani, {pct} as drop_pct, epoch_us(seen_at) as seen_at from (
  select *, lag(price_bani) over (partition by retailer_id, listing order by seen_at, arrival) as previous_bani, row_number() over (partition by retailer_id, listing order by seen_at desc, arrival desc) as k from {history})
  where k = 1 and in_stock and seen_at >= timestamp '{since}' and previous_bani > price_bani and (previous_bani - price_bani) * 100 >= previous_bani * {min_pct}"""


def drops_sql(since: str, min_pct: float = 10.0, limit: int | None = None) -> str:
    text = DROPS.format(pct=round1("(previous_bani - price_bani) * 100 / previous_bani"), history="history", since=since, min_pct=min_pct)
    return text + (f" order by (previous_bani - price_bani) / previous_bani desc, retailer_id, listing limit {limit}" if limit else "")


@query(sql(drops_sql("2000-01-01")))
def q9_price_drops(m):
    return H.price_drops(m.history, at("2000-01-01"), 10.0, None)


@query(sql(drops_sql("1995-01-01", 25.0, 50)))
def q9_price_drops_top50(m):
    return H.price_drops(m.history, at("1995-01-01"), 25.0, 50)


@query(sql(drops_sql("2024-01-05"), obs=PARTS["visits"]))
def q9_price_drops_late_arrivals(m):
    return H.price_drops(H.change_history(m.visits), at("2024-01-05"), 10.0, None)


HISTORY = "select retailer_id, listing, arrival, epoch_us(seen_at) as seen_at, price_bani, old_price_bani, in_stock from history"


@query(sql(HISTORY))
def w6_change_history(m):
    return m.history


@query(sql(HISTORY, obs=PARTS["visits"]))
def w7_change_history_late_arrivals(m):
    return H.change_history(m.visits)


@query(sql("select retailer_id, listing, arrival, outcome from outcomes"))
def st1_upsert_outcomes(m):
    return H.marked(m.observations).select("retailer_id", "listing", "arrival", "outcome")


@query(sql("select retailer_id, listing, price_bani, old_price_bani, in_stock, seller_name, epoch_us(first_seen_at) as first_seen_at, epoch_us(last_seen_at) as last_seen_at from state"))
def st4_current_state(m):
    return H.current_state(m.observations)


REPORT = """select retailer_id, count(*) as observations, count(*) filter (where outcome = 'created') as created, count(*) filter (where outcome = 'changed') as changed,
  count(*) filter (where outcome = 'unchanged') as unchanged, count(*) filter (where outcome = 'stale') as stale from outcomes group by 1"""


@query(sql(REPORT, obs=PARTS["visits"]))
def a11_run_report(m):
    return S.run_report(H.marked(m.visits))


@query(sql(f"select count(*) as retailers, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in ('observations', 'created', 'changed', 'unchanged', 'stale'))} from ({REPORT})", obs=PARTS["visits"]))
def a12_run_totals(m):
    return S.run_totals(S.run_report(H.marked(m.visits)))


@query(sql(f"""select retailer_id, '{{"observations":' || observations || ',"outcomes":{{"created":' || created || ',"changed":' || changed || ',"unchanged":' || unchanged || ',"stale":' || stale || '}}}}' as json from ({REPORT})"""))
def snk2_report_json(m):
    return S.report_json(S.run_report(H.marked(m.observations)))


RUNS = """select retailer_id, run_at, run_at + interval 1 day as until from (select distinct user_id as retailer_id from events) cross join
  (select unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), interval 1 day)) as run_at from events)"""
SIGHTS = "select user_id as retailer_id, event_type as listing, event_id as arrival, ts as seen_at, event_id % 5 <> 0 as in_stock from events"


@query(f"""with runs as ({RUNS}), sights as ({SIGHTS}), firsts as (select retailer_id, listing, min(seen_at) as first from sights group by all),
  log as (select retailer_id, listing, seen_at as t, 0 as run, arrival, in_stock, cast(null as timestamp) as run_at from sights union all
          select retailer_id, listing, until, 1, 0, null, run_at from firsts join runs using (retailer_id) where run_at > first),
  filled as (select *, sum(1 - run) over w as island, last_value(in_stock ignore nulls) over w as stock, max(case when run = 0 then t end) over w as seen from log
             window w as (partition by retailer_id, listing order by t, run, arrival rows between unbounded preceding and current row)),
  misses as (select *, row_number() over (partition by retailer_id, listing, island order by t) as missed_runs from filled where run = 1 and seen < run_at)
  select retailer_id, listing, epoch_us(run_at) as run_at, missed_runs, missed_runs = 3 and stock as marked from misses""")
def st3_absences(m):
    first, last = m.visits.agg(F.date_trunc("day", F.min("seen_at")).cast("string"), F.date_trunc("day", F.max("seen_at")).cast("string")).first()
    days = F.explode(F.sequence(at(first), at(last), F.expr("interval 1 day")))
    runs = m.visits.select("retailer_id").distinct().withColumn("run_at", days).withColumn("until", F.expr("run_at + interval 1 day"))
    sights = m.table("events").select(F.col("user_id").alias("retailer_id"), F.col("event_type").alias("listing"), F.col("event_id").alias("arrival"), F.col("ts").cast("timestamp").alias("seen_at"), (F.col("event_id") % 5 != 0).alias("in_stock"))
    return H.absences(sights, runs)


@query("""with log as (select user_id as retailer_id, event_id as n, case when event_type = 'error' or event_id % 2 = 0 then 429 else 200 end as status from events),
  runs as (select *, sum(case when status <> 429 then 1 else 0 end) over (partition by retailer_id order by n) as island from log),
  counted as (select *, sum(case when status = 429 then 1 else 0 end) over (partition by retailer_id, island order by n) as refused from runs),
  stops as (select *, min(case when refused >= 5 then n end) over (partition by retailer_id) as stop from counted)
  select retailer_id, count(*) as fetched, max(stop is not null) as stopped from stops where stop is null or n <= stop group by 1""")
def w12_give_up_after_refusals(m):
    fetches = m.table("events").select(F.col("user_id").alias("retailer_id"), F.col("event_id").alias("n"), F.when((F.col("event_type") == "error") | (F.col("event_id") % 2 == 0), 429).otherwise(200).alias("status"))
    return H.give_up(fetches)


WINDOWED = """select retailer_id, listing, arrival, epoch_us(seen_at) as seen_at, price_bani, old_price_bani, in_stock from
  (select *, lead(seen_at) over (partition by retailer_id, listing order by seen_at, arrival) as next from history) where seen_at >= timestamp '{0}' or next is null or next >= timestamp '{0}'"""


@query(sql(WINDOWED.format("2024-01-10"), obs=PARTS["visits"]))
def w3_history_window(m):
    return H.window_from(H.change_history(m.visits), at("2024-01-10"))


@query(sql("""select retailer_id, listing, epoch_us(seen_at) as seen_at, in_stock, 0 as extended, case when in_stock then price_bani / 100 end as lei from history union all
  select retailer_id, listing, epoch_us(last_seen_at), h.in_stock, 1, case when h.in_stock then h.price_bani / 100 end
  from (select * from history qualify row_number() over (partition by retailer_id, listing order by seen_at desc, arrival desc) = 1) h join state using (retailer_id, listing) where last_seen_at > seen_at""", obs=PARTS["visits"]))
def q12_chart_series(m):
    return H.chart_series(H.change_history(m.visits), H.current_state(m.visits))


# --- catalogue --------------------------------------------------------------------------

SUMMARY = "id, name, brand, size_value, size_unit, category, lowest_price_bani, offer_count, retailer_count, in_stock, on_sale"
SEARCHES: dict[str, tuple[C.Search, str]] = {
    "q1_search_all": (C.Search(), "true"),
    "f1_search_words": (C.Search(q="  RED, Brand#1 "), "contains(folded, 'red') or contains(brand_key, 'red')) and (contains(folded, 'brand') or contains(brand_key, 'brand')) and (contains(folded, '1') or contains(brand_key, '1')"),
    "f2_search_brand": (C.Search(brand="BRAND 13"), "brand_key = 'brand 13'"),
    "f3_search_category": (C.Search(category="ecoNomy"), "lower(category) = 'economy'"),
    "f4_search_price_range": (C.Search(min_price=100000, max_price=250000), "lowest_price_bani between 100000 and 250000"),
    "f5_search_in_stock": (C.Search(in_stock=True), "lowest_price_bani is not null"),
    "f6_search_any_retailer": (C.Search(retailers=["supplier-000000001", "supplier-000000002"]), "id in (select product_id from offers join shops on retailer_id = shops.id where slug in ('supplier-000000001', 'supplier-000000002'))"),
    "f7_search_all_retailers": (C.Search(retailers=["supplier-000000001", "supplier-000000002"], common=True), "id in (select product_id from offers join shops on retailer_id = shops.id where slug in ('supplier-000000001', 'supplier-000000002') group by 1 having count(distinct slug) = 2)"),
    "f8_search_common": (C.Search(common=True), "retailer_count >= 2"),
    "f9_search_listed": (C.Search(hide_unlisted=True), "offer_count > 0"),
}
for _name, (_ask, _where) in SEARCHES.items():
    query(sql(f"select {SUMMARY} from summaries where ({_where})"), _name)(lambda m, ask=_ask: C.search_products(m.products, m.brands, m.offers, m.shops, ask))

PAGES: dict[str, tuple[C.Search, str]] = {
    "o1_page_by_name": (C.Search(q="ring", sort="name", page=2, page_size=24), "contains(folded, 'ring') order by folded, id limit 24 offset 24"),
    "o1_page_by_price": (C.Search(sort="price", page=3, page_size=24), "true order by lowest_price_bani is null, lowest_price_bani, id limit 24 offset 48"),
    "o1_page_by_price_down": (C.Search(sort="-price", page=1, page_size=24), "true order by lowest_price_bani is null, lowest_price_bani desc, id limit 24"),
    "o1_page_by_retailers": (C.Search(sort="retailers", page=1, page_size=24), "true order by retailer_count desc, id limit 24"),
}
for _name, (_ask, _where) in PAGES.items():
    query(sql(f"select {SUMMARY} from summaries where {_where}"), _name)(lambda m, ask=_ask: C.search_products(m.products, m.brands, m.offers, m.shops, ask))


@query(sql("select count(*) as total, cast(greatest(1, ceil(count(*) / 24)) as bigint) as pages from summaries where brand_key = 'brand 13'"))
def o10_page_count(m):
    return C.page_count(C.search_products(m.products, m.brands, m.offers, m.shops, C.Search(brand="Brand#13")), 24).withColumn("pages", F.col("pages").cast("bigint"))


@query(sql("""select product_id, lows.id as offer_id, slug, price_bani, old_price_bani, in_stock, coalesce(in_stock and price_bani = low, false) as is_cheapest, epoch_us(last_seen_at) as last_seen_at
  from lows join shops on retailer_id = shops.id where product_id between 1 and 20"""))
def q3_product_detail(m):
    return C.product_detail(m.offers, m.shops, list(range(1, 21)))


@query(sql("""select slug, listing, epoch_us(seen_at) as seen_at, price_bani, in_stock from (select *, lead(seen_at) over (partition by retailer_id, listing order by seen_at, arrival) as next from history)
  join shops on retailer_id = shops.id where listing between 1 and 50 and (seen_at >= timestamp '1999-01-01' or next is null or next >= timestamp '1999-01-01')"""))
def q4_product_history(m):
    return C.product_history(m.history, m.shops, list(range(1, 51)), at("2000-01-01"), 365)


@query(sql("""select id, slug, name, is_active, coalesce(offer_count, 0) as offer_count, coalesce(product_count, 0) as product_count, epoch_us(last_seen_at) as last_seen_at from shops left join
  (select retailer_id as id, count(*) as offer_count, count(distinct product_id) as product_count, max(last_seen_at) as last_seen_at from offers group by 1) using (id) where is_active"""))
def q5_list_retailers(m):
    return C.list_retailers(m.shops, m.offers, active=True)


@query(sql("select id, name, normalized_name, coalesce(product_count, 0) as product_count from brands left join (select brand_id as id, count(*) as product_count from products group by 1) using (id) where contains(normalized_name, '1')"))
def q6_list_brands(m):
    return C.list_brands(m.brands, m.products, m.offers, q="1")


@query(sql("select id, name, normalized_name, product_count from brands join (select brand_id as id, count(*) as product_count from products where id in (select product_id from offers) group by 1) using (id)"))
def q6_list_brands_listed(m):
    return C.list_brands(m.brands, m.products, m.offers, hide_unlisted=True)


CATEGORY = "select category, count(*) as product_count, 14 as position from products {} group by 1"


@query(sql(CATEGORY.format("")))
def q7_list_categories(m):
    return C.list_categories(m.products, m.offers)


@query(sql(CATEGORY.format("where id in (select product_id from offers)")))
def q7_list_categories_listed(m):
    return C.list_categories(m.products, m.offers, hide_unlisted=True)


query("select distinct p_brand as name from part", "q14_brand_names")(lambda m: C.brand_names(m.brands))
query(sql("select epoch_us(max(last_seen_at)) as last_seen_at, count(*) as offers from offers"), "q15_freshness")(lambda m: C.freshness(m.offers))


# --- market -----------------------------------------------------------------------------

OF_BRAND = " where product_id in (select p_partkey from part where p_brand = 'Brand#13')"
query(sql("select * from compared" + OF_BRAND), "q8_compare_brand")(lambda m: M.compare_brand(m.offers, m.products, m.brands, m.shops, "brand 13"))
query(sql("select * from compared"), "a7_compare_market")(lambda m: M.compare(m.offers, m.shops))
query(sql("select product_id, retailer_id, price_bani, in_stock from reps"), "a8_representatives")(lambda m: M.representatives(m.offers))


@query(sql(f"""select slug, count(*) as products_listed, count(*) filter (where is_cheapest) as cheapest_count, {round1("avg(vs_median_pct) filter (where in_stock)")} as avg_vs_median_pct,
  count(*) filter (where in_stock and vs_median_pct < -2) as under_market, count(*) filter (where in_stock and vs_median_pct > 2) as over_market from compared{OF_BRAND} group by 1"""))
def a9_positions(m):
    return M.positions(M.compare_brand(m.offers, m.products, m.brands, m.shops, "brand 13"))


LEI = "translate(printf('%,.2f', {0} / 100.0), ',.', '.,') || ' lei'"
SHOWN = """case when not in_stock then 'Stoc epuizat' when vs_median_pct is null then '—' when vs_median_pct < -2 then 'Sub piață' when vs_median_pct > 2 then 'Peste piață' else 'La nivelul pieței' end"""


@query(sql(f"""select product_id, name, cast(cast(size_value as bigint) as varchar) || ' ml' as size, {LEI.format('price_bani')} as price, coalesce({LEI.format('market_min_bani')}, '—') as lowest, coalesce({LEI.format('market_median_bani')}, '—') as median,
  coalesce(replace(printf('%+.1f', vs_median_pct), '.', ',') || '%', '—') as vs_median, {SHOWN} as position,
  case when vs_median_pct is null or abs(vs_median_pct) <= 2 then 0.0 else round(0.12 + 0.33 * least(abs(vs_median_pct), 20.0) / 20.0, 4) end as heat
  from compared join products on product_id = products.id where slug = 'supplier-000000007'"""))
def q10_retailer_rows(m):
    return M.retailer_rows(M.compare(m.offers, m.shops), m.products, "supplier-000000007")


GRID = [f"supplier-{n:09d}" for n in (1, 2, 3, 4)]


@query(sql(f"select product_id, {', '.join(f'''max(vs_median_pct) filter (where slug = '{s}') as "{s}"''' for s in GRID)} from compared where slug in ({', '.join(repr(s) for s in GRID)}) group by 1"))
def q11_matrix(m):
    return M.matrix(M.compare(m.offers, m.shops).where(F.col("slug").isin(GRID)), GRID)


# --- schedule ---------------------------------------------------------------------------

WHEN = "2001-12-30 12:00:00"


@query(sql(f"""select slug, is_active, epoch_us(last_crawled_at) as last_crawled_at, epoch_us(last_crawled_at + interval 24 hour) as next_due_at, last_crawled_at is null or last_crawled_at + interval 24 hour <= timestamp '{WHEN}' as is_due from retailers"""))
def q13_schedule(m):
    return S.due(m.retailers, at(WHEN))


@query(sql(f"""select slug, case when not is_active then 'retailer is marked inactive' when last_crawled_at + interval 24 hour > timestamp '{WHEN}' then 'not due until ' || strftime(last_crawled_at + interval 24 hour, '%Y-%m-%d %H:%M')
  when id % 2 = 0 then 'time limit reached before this retailer''s turn' end as skipped from retailers"""))
def f16_skip_reasons(m):
    return S.skip_reasons(m.retailers, at(WHEN), F.col("id") % 2 == 0)


@query(sql("select slug from shops where not is_active and slug in ('supplier-000000001', 'supplier-000000003', 'supplier-000000008', 'supplier-000000011')"))
def f15_inactive(m):
    return S.inactive(m.shops, [f"supplier-{n:09d}" for n in (1, 3, 8, 11)])


@query("select distinct 'supplier-' || lpad(cast(user_id as varchar), 9, '0') as slug from events where user_id not in (select s_suppkey from supplier)")
def f15_unknown(m):
    asked = m.table("events").select(F.concat(F.lit("supplier-"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("slug")).distinct()
    return S.unknown(asked, m.shops)


@query(sql("select retailer_id, listing from offers where last_seen_at < timestamp '1999-06-01'"))
def f11_unseen_pages(m):
    pages = m.observations.select("retailer_id", "listing").distinct().withColumn("url", F.concat(F.lit("https://SHOP-"), F.col("retailer_id"), F.lit(".example/p/"), F.col("listing"), F.lit("/?variant=1#top")))
    pages = pages.withColumn("url", F.regexp_replace("url", "^https://SHOP", "https://Shop"))
    return S.unseen(pages, m.offers, at("1999-06-01"), web.page_key).select("retailer_id", "listing")


@query("""select n_nationkey as id, n_name as name from nation where n_nationkey % 2 = 0 union all select n_nationkey, 'seed ' || n_name from nation where n_nationkey % 2 = 1""")
def snk5_seed(m):
    rows = m.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return S.seeded(rows.where("id % 2 = 0"), rows.withColumn("name", F.concat(F.lit("seed "), F.col("name"))), "id")


# --- validation -------------------------------------------------------------------------

RAW = """select o_orderkey as id, case when o_orderkey % 13 = 0 then '  ' else 'shop ' || o_custkey % 7 end as retailer, case when o_orderkey % 11 = 0 then 'ftp://x/' else 'https://x/' end || o_orderkey as url,
  case when o_orderkey % 17 = 0 then '' else ' ' || o_orderpriority || '  item ' end as title, cast(floor(o_totalprice) as bigint) - 50000 as price_bani, cast(floor(o_totalprice) as bigint) - 50000 + (o_orderkey % 5 - 2) * 100 as old_price_bani,
  case when o_orderkey % 19 = 0 then 'lei' else 'RON' end as currency, case when o_orderkey % 3 = 0 then 'Brand ' || o_orderkey % 9 end as brand,
  substr(cast(o_orderkey * 7919 + 1000000000000 as {text}), 1, 13) as ean, case when o_orderkey % 7 <> 0 then cast(o_orderkey % 4 as double) end as size_value, case when o_orderkey % 14 <> 0 then case when o_orderkey % 23 = 0 then 'oz' else 'ml' end end as size_unit from orders"""
VALID = """case when {0} then '{1},' else '' end"""


def raw(m):
    m.table("orders").createOrReplaceTempView("pt_orders")
    return m.spark.sql(RAW.format(text="string").replace("from orders", "from pt_orders"))


CLEAN = f"""select id, nullif(trim(retailer), '') as retailer, url, nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), '') as title, price_bani, case when old_price_bani > price_bani then old_price_bani end as old_price_bani, currency, brand,
  case when (list_sum(list_transform(range(1, 14), lambda i: cast(ean[i] as bigint) * case when i % 2 = 0 then 3 else 1 end))) % 10 = 0 then ean end as ean, size_value, size_unit from ({RAW.format(text='varchar')})"""


@query(f"""select id, retailer, url, title, price_bani, old_price_bani, currency, brand, ean, size_value, size_unit, rtrim({' || '.join(VALID.format(*x) for x in (
    ('retailer is null', 'retailer'), ("url not like 'http%'", 'url'), ('title is null', 'title'), ('not coalesce(price_bani >= 0, false)', 'price'), ("currency <> 'RON'", 'currency'),
    ("(size_value is null) <> (size_unit is null) or coalesce(size_value <= 0, false) or coalesce(size_unit = 'oz', false)", 'size')))}, ',') as errors from ({CLEAN})""")
def v1_validated(m):
    return V.checked(raw(m))


query("select s, case when length(s) in (8, 12, 13, 14) and list_sum(list_transform(range(1, length(s) + 1), lambda i: cast(reverse(s)[i] as bigint) * case when i % 2 = 0 then 3 else 1 end)) % 10 = 0 then s end as gtin from (select substr(cast(o_orderkey * 104729 + 10000000000000 as varchar), 1, cast(7 + o_orderkey % 8 as bigint)) as s from orders)", "v3_gtin")(
    lambda m: m.table("orders").select(F.expr("substr(cast(o_orderkey * 104729 + 10000000000000 as string), 1, cast(7 + o_orderkey % 8 as int))").alias("s")).select("s", N.gtin(F.col("s")).alias("gtin")))
query("select l_orderkey, l_linenumber, count(*) as rows from lineitem group by 1, 2 having count(*) > 1", "v4_duplicates")(lambda m: V.duplicates(m.table("lineitem"), "l_orderkey", "l_linenumber"))
query("select 'discount' as rule, count(*) filter (where not l_discount < 0.08) as rows from lineitem union all select 'quantity', count(*) filter (where not l_quantity >= 2) from lineitem union all select 'tax', count(*) filter (where not l_tax <= 0.5) from lineitem", "v4_violations")(
    lambda m: V.violations(m.table("lineitem"), {"discount": "l_discount < 0.08", "quantity": "l_quantity >= 2", "tax": "l_tax <= 0.5"}))
query(sql("select count(*) as valid, count(distinct brand_name) as brands from (select brand as brand_name, rtrim({}, ',') as errors from ({}))".format(" || ".join(VALID.format(*x) for x in (
    ("retailer is null", "retailer"), ("url not like 'http%'", "url"), ("title is null", "title"), ("not coalesce(price_bani >= 0, false)", "price"), ("currency <> 'RON'", "currency"),
    ("(size_value is null) <> (size_unit is null) or coalesce(size_value <= 0, false) or coalesce(size_unit = 'oz', false)", "size"))), CLEAN) + " where errors = ''"), "pr2_snapshot")(
    lambda m: V.snapshot(V.split(raw(m))[0]).agg(F.count("*").alias("valid"), F.count_distinct("brand_name").alias("brands")))


# --- texts and numbers ------------------------------------------------------------------

NOISE_SQL = "title"
for _pattern, _with in (
    (r"(?i)(?:\+|\s-|\bcu\b)\s*(?:un\s+)?(?:cadou|gift|gratis|bonus)\b[^)\]]*", " "),
    (r"(?i)[(\[]\s*(?:promo|new|sale)!*\s*[)\]]", " "),
    (r"(?i)\b(?:reducere|discount)\b\s*:?\s*-?\s*\d+(?:[.,]\d+)?\s*%", " "),
    (r"(?i)(^|[^\w%])-\s*\d+(?:[.,]\d+)?\s*%", r"\1 "),
    (r"(?i)(^|[^\w-])(?:promo|outlet|nou)!*($|[^\w-])", r"\1 \2"),
    (r"(?i)(^|[^\w-])(?:new|sale)!+", r"\1 "),
    (r"[(\[]\s*[)\]]", " "),
):
    NOISE_SQL = f"regexp_replace({NOISE_SQL}, '{_pattern}', '{_with}', 'g')"
CLEAN_SQL = f"trim(regexp_replace(regexp_replace({NOISE_SQL}, '\\s+', ' ', 'g'), '^[\\s|,:;/-]+|(?:[\\s|,:;/-]|\\s\\+)+$', '', 'g'))"


@query(sql(f"select product_id, {CLEAN_SQL} as clean, {CLEAN_SQL} as again from titles"))
def t5_clean_title(m):
    clean = T.clean_title(F.col("title"))
    return m.titles.select("product_id", clean.alias("clean")).select("product_id", "clean", T.clean_title(F.col("clean")).alias("again"))


#: The pack or size of a title is what its maker put in; a gift of another size makes it ambiguous.
SIZE_SQL = """case p_partkey % 11 when 2 then 1500.0 when 3 then null else cast(p_size as double) end"""
GIFT = "p_partkey % 5 = 1"


@query(f"""select p_partkey as product_id, case when {GIFT} and p_partkey % 11 = 3 then 50.0 when not ({GIFT}) or {SIZE_SQL} = 50 or (p_partkey % 11 = 0 and p_size * 2 = 50) or (p_partkey % 11 = 1 and p_size * 3 = 50) then {SIZE_SQL} end as size,
  case when {GIFT} and p_partkey % 11 = 3 then 1 when ({SIZE_SQL}) is not null and (not ({GIFT}) or {SIZE_SQL} = 50 or (p_partkey % 11 = 0 and p_size * 2 = 50) or (p_partkey % 11 = 1 and p_size * 3 = 50)) then case p_partkey % 11 when 0 then 2 when 1 then 3 else 1 end end as packs from part""")
def n7_parse_size(m):
    size = N.parse_size(F.col("title"))
    return m.titles.select("product_id", size["value"].cast("double").alias("size"), size["count"].alias("packs"))


WORDS = """list_concat(string_split(lower(p_name), ' '), case when p_partkey % 3 = 0 then ['plus'] else [] end, case when p_type <> 'PROMO' then [lower(p_type)] else [] end)"""


@query(sql(f"select p_partkey as product_id, array_to_string({WORDS}, ' ') as tokens from part"))
def t7_name_tokens(m):
    return m.titles.select("product_id", F.array_join(T.name_tokens(F.col("title"), F.col("brand")), " ").alias("tokens"))


@query(sql("select p_partkey as product_id, case when p_partkey % 3 = 0 then p_name || '+' else array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') end || case when p_type <> 'PROMO' then ' ' || p_type else '' end as name from part"))
def t8_display_name(m):
    return m.titles.select("product_id", T.display_name(F.col("title"), F.col("brand")).alias("name"))


@query("""select p_partkey as product_id, case p_partkey % 11 when 2 then 1500.0 when 3 then case when p_partkey % 5 = 1 then 50.0 end else cast(p_size as double) end as size from part where p_partkey % 11 in (2, 3)""")
def n9_offer_size(m):
    stored = F.when(F.col("product_id") % 2 == 0, F.lit(1.5)).cast("decimal(10,3)")
    titles = m.titles.where("product_id % 11 in (2, 3)").withColumns({"v": F.when(F.col("product_id") % 11 == 2, stored), "u": F.when((F.col("product_id") % 11 == 2) & (F.col("product_id") % 2 == 0), "l"), "title": F.when(F.col("product_id") % 11 == 2, F.lit("crema 1,5 l")).otherwise(F.col("title"))})
    return titles.select("product_id", N.offer_size(F.col("title"), F.col("v"), F.col("u"))["value"].cast("double").alias("size"))


@query(f"""select product_id, case when product_id % 22 = 0 then coalesce(size, p_size * 2.0) when product_id % 2 = 0 then 1500.0 else size end as size from ({ORACLES["n7_parse_size"]}) join part on p_partkey = product_id""")
def n9_offer_size_all(m):
    """n9_offer_size over all titles as they are; half of them have a stored size, some a pack's total."""
    n, total = F.col("product_id"), F.col("product_id") % 22 == 0
    size = m.table("part").select(F.col("p_partkey").alias("product_id"), (F.col("p_size") * 2).cast("decimal(10,3)").alias("twice"))
    stored = F.when(total, F.col("twice")).when(n % 2 == 0, F.lit(1.5)).cast("decimal(10,3)")
    titles = m.titles.join(size, "product_id").withColumns({"v": stored, "u": F.when(total, "ml").when(n % 2 == 0, "l")})
    return titles.select("product_id", N.offer_size(F.col("title"), F.col("v"), F.col("u"))["value"].cast("double").alias("size"))


FOLDED = r"trim(regexp_replace(lower(strip_accents(replace(replace({0}, 'ß', 'ss'), '’', ''''))), '\s+', ' ', 'g'))"


@query(f"select doc_id, md5({FOLDED.format('text')}) as folded from documents")
def t1_fold(m):
    return m.table("documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query(f"select doc_id, md5({FOLDED.format('text')}) as folded from documents where lang <> 'en'")
def t1_fold_exact(m):
    return m.table("documents").where("lang <> 'en'").select("doc_id", F.md5(T.fold_exact("text")).alias("folded"))


@query(f"""select doc_id, trim(regexp_replace(replace({FOLDED.format("substr(text, 1, 60)")}, '''', ''), '[^0-9a-z]+', ' ', 'g')) as brand_key, regexp_replace({FOLDED.format("substr(text, 1, 60)")}, '[^a-z0-9]', '', 'g') as token,
  array_to_string(list_distinct_ordered(w), ' ') as words from (select *, string_split(trim(regexp_replace(replace({FOLDED.format("substr(text, 1, 60)")}, '''', ''), '[^0-9a-z]+', ' ', 'g')), ' ') as w from documents)""".replace("list_distinct_ordered(w)", "list_filter(w, lambda x, i: list_position(w, x) = i)"))
def t2_brand_key(m):
    start = F.substring("text", 1, 60)
    return m.table("documents").select("doc_id", T.brand_key(start).alias("brand_key"), T.brand_token(start).alias("token"), F.array_join(T.search_words_of(start), " ").alias("words"))


@query(f"select doc_id, md5({FOLDED.format('text')}) as folded from documents")
def t1_fold_exact_all(m):
    """t1_fold_exact over all documents, whatever their language."""
    return m.table("documents").select("doc_id", F.md5(T.fold_exact("text")).alias("folded"))


WHOLE_KEY = f"""trim(regexp_replace(replace({FOLDED.format('text')}, '''', ''), '[^0-9a-z]+', ' ', 'g'))"""


@query(f"""select doc_id, md5({WHOLE_KEY}) as brand_key, md5(regexp_replace({FOLDED.format("text")}, '[^a-z0-9]', '', 'g')) as token, md5(array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ')) as words from (select *, string_split({WHOLE_KEY}, ' ') as w from documents)""")
def t2_brand_key_all(m):
    """t2_brand_key over whole texts; digests, as the results are as long as the texts."""
    text = F.col("text")
    return m.table("documents").select("doc_id", F.md5(T.brand_key(text)).alias("brand_key"), F.md5(T.brand_token(text)).alias("token"), F.md5(F.array_join(T.search_words_of(text), " ")).alias("words"))


SPELT = ["L’ORÉAL  paris®", "eau thermale avene", "YSL", "Unknown  Brand™", "  ", "la roche posay", "Kiehls", "NYX cosmetics"]
CANON = ["L'Oréal Paris", "Avène", "Yves Saint Laurent", "Unknown Brand", None, "La Roche-Posay", "Kiehl's", "NYX Professional Makeup"]


def _case(column: str, values: list[str | None]) -> str:
    quoted = ["null" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"case {column} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(quoted)) + " end"


@query(f"select p_partkey as id, {_case('p_partkey', CANON)} as brand, {_case('p_partkey', ['t', 't', 't', 'f', 'f', 't', 't', 't'])} = 't' as known from part")
def t3_canonical_brand(m):
    spelt = F.expr(_case("p_partkey", SPELT).replace("L''", "L\\'").replace("’", "’"))
    rows = m.table("part").select(F.col("p_partkey").alias("id"), spelt.alias("raw"))
    return rows.select("id", T.canonical_brand(F.col("raw")).alias("brand"), T.is_known_brand(F.col("raw")).alias("known"))


NAMES = ["Set cadou Apă de toaletă", "Lac de unghii roșu", "Gucci Bloom Apă de parfum", "Șampon nuanțator", "Balsam par", "Mască de față", "Masca de par", "Vopsea de păr 7.1", "Fixativ volum", "Pensula fond de ten", "Rimel negru", "Gel de duș", "Crema antirid ochi", "Ulei de par", "Serum hidratant", "Obiect necunoscut"]
CATEGORY_SQL = "case " + " ".join(f"when regexp_matches(n, '{p}') then '{c}'" for c, p in rules.CATEGORY_PATTERNS) + f" else '{rules.OTHER}' end"


@query(f"select id, {CATEGORY_SQL} as category from (select p_partkey as id, lower(strip_accents({_case('p_partkey', NAMES)})) || ' ' || lower(p_name) as n from part)")
def t12_categorize(m):
    return m.table("part").select(F.col("p_partkey").alias("id"), T.categorize(F.concat_ws(" ", F.expr(_case("p_partkey", NAMES)), "p_name")).alias("category"))


@query(f"""select id, coalesce(nullif({CATEGORY_SQL}, 'Altele'), said, 'Altele') as category from (select p_partkey as id, lower(p_name) as n from part) left join (
  select p_partkey as id, {CATEGORY_SQL.replace('(n,', '(t,')} as said from (select p_partkey, lower(strip_accents({_case('p_partkey', NAMES)})) as t from part) where {CATEGORY_SQL.replace('(n,', '(t,')} <> 'Altele') using (id)""")
def t13_product_category(m):
    parts = m.table("part")
    names = parts.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))
    titles = parts.select(F.col("p_partkey").alias("product_id"), F.explode(F.array(F.lit(2), F.lit(1))).alias("offer_id"), F.expr(_case("p_partkey", NAMES)).alias("t")).withColumn("title", F.when(F.col("offer_id") == 1, F.lit("obiect")).otherwise(F.col("t")))
    return E.product_category(names, titles).withColumnRenamed("product_id", "id")


@query(f"select category, count(*) as n from (select {CATEGORY_SQL} as category from (select lower(strip_accents({_case('p_partkey', NAMES)})) as n from part)) group by 1")
def t14_backfill_counts(m):
    names = m.table("part").select(F.col("p_partkey").alias("product_id"), F.expr(_case("p_partkey", NAMES)).alias("name"), F.lit(None).cast("string").alias("category"))
    empty = names.limit(0).select("product_id", F.lit(0).alias("offer_id"), F.lit("").alias("title"))
    return E.categorized(names, empty).groupBy("category").agg(F.count("*").alias("n"))


#: Prices written the ways shops do; what they say is known, so the answer is the number they were made of.
@query(sql("select arrival as id, price_bani as marked, price_bani as plain, price_bani as machine, price_bani as low, case when price_bani > 0 then price_bani + 5000 end as high from obs"))
def n1_prices(m):
    bani = F.col("price_bani")
    lei = F.format_number((bani / 100).cast("decimal(18,2)"), 2)  # 12,345.99
    local = F.translate(lei, ",.", ".,")
    more = F.translate(F.format_number(((bani + 5000) / 100).cast("decimal(18,2)"), 2), ",.", " ,")
    rows = m.observations.select(F.col("arrival").alias("id"), F.concat(F.lit("Crema 40 ml -20% "), local, F.lit(" lei")).alias("a"), F.concat(F.lit("-15% "), local).alias("b"), F.concat(lei, F.lit(" RON")).alias("c"), F.concat(F.lit("Lei "), more, F.lit(" acum "), local, F.lit(" LEI")).alias("d"))
    pair = N.parse_price_pair(F.col("d"))
    return rows.select("id", N.parse_price(F.col("a")).alias("marked"), N.parse_price(F.col("b")).alias("plain"), N.parse_machine_price(F.col("c")).alias("machine"), pair["current"].alias("low"), pair["old"].alias("high"))


@query(sql(f"""select arrival as id, case when old_price_bani > price_bani then cast(round_even((old_price_bani - price_bani) * 100 / old_price_bani, 0) as bigint) end as discount, {LEI.format('price_bani')} as lei,
  case when arrival % 150 = 1 then '1 produs' when arrival % 150 = 0 or (arrival % 150 % 100 > 0 and arrival % 150 % 100 < 20) then (arrival % 150) || ' produse' else (arrival % 150) || ' de produse' end as label from obs"""))
def n12_display(m):
    return m.observations.select(F.col("arrival").alias("id"), N.discount_pct(F.col("price_bani"), F.col("old_price_bani")).alias("discount"), N.format_lei(F.col("price_bani")).alias("lei"), N.plural(F.col("arrival") % 150, "produs", "produse").alias("label"))


# --- addresses, robots, sitemaps, pages -------------------------------------------------

@query(r"""select page_id, lower(regexp_extract(u, '^([a-z]+://[^/]*)', 1)) || substr(u, length(regexp_extract(u, '^([a-z]+://[^/]*)', 1)) + 1) as page_key, regexp_matches(url, '(?i)^https?://') as safe, page_id % 3 = 0 as product
  from (select *, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') as u from pages)""")
def u5_page_key(m):
    rows = m.table("pages")
    product = web.url_matches(F.concat(F.lit("https://WWW.shop.example/"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("p/"), F.col("page_id"))).otherwise("about")), ["www.shop.example"], "^/p/[0-9]+$")
    return rows.select("page_id", web.page_key(F.col("url")).alias("page_key"), P.has_https(F.col("url")).alias("safe"), product.alias("product"))


ROBOTS = "User-agent: *\nDisallow: /fr/\nAllow: /fr/8\nDisallow: /*?page=\nCrawl-delay: 2\n\nUser-agent: tide\nUser-agent: other\nDisallow: /de/*1$\nAllow: /de/\nDisallow: /es/ # closed\nCrawl-delay: 0.5\n"


def _robots(m):
    hosts = m.table("pages").select(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host")).distinct()
    return web.robots_rules(hosts.withColumn("text", F.lit(ROBOTS)))


@query(r"""select url, case when regexp_matches(path, '^/fr/8') and not regexp_matches(path, '^/.*\?page=') then true when regexp_matches(path, '^/.*\?page=') then false when regexp_matches(path, '^/fr/') then false else true end as allowed
  from (select distinct url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '#.*$', '') as path from pages)""")
def u8_robots_all(m):
    return web.allowed(m.table("pages"), _robots(m), "Somebody/1.0")


@query(r"""select url, case when regexp_matches(path, '^/de/.*1$') then false when regexp_matches(path, '^/es/') then false else true end as allowed from (select distinct url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '#.*$', '') as path from pages)""")
def w11_robots_named(m):
    return web.allowed(m.table("pages"), _robots(m), "Tide/0.1 (+https://example)")


@query(r"select distinct lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)) as host, 0.5 as delay from pages")
def a14_crawl_delay(m):
    return web.crawl_delay(_robots(m), "tide")


@query("""with hrefs as (select url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages)
  select url, case when regexp_matches(href, '^https?://') then href else regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href end as link from hrefs where regexp_matches(href, '^https?://') or href like '/%'""")
def src13_page_links(m):
    return P.page_links(m.table("pages"))


@query("""with recursive tree as (select 0 as s, 0 as depth union select cast(page_id as integer), depth + 1 from pages join tree on page_id // 6 = s and page_id > 0 where depth < 3) select distinct 'https://x/p/' || page_id as url from pages join tree on page_id % 40 = s""")
def src12_sitemap_tree(m):
    ids = m.table("pages").select("page_id")
    name = lambda c: F.concat(F.lit("https://x/s/"), c)
    maps = ids.where("page_id > 0").select(name(F.floor(F.col("page_id") / 6)).alias("sitemap"), name(F.col("page_id")).alias("loc"), F.lit(True).alias("is_sitemap"))
    urls = ids.select(name(F.col("page_id") % 40).alias("sitemap"), F.concat(F.lit("https://x/p/"), F.col("page_id")).alias("loc"), F.lit(False).alias("is_sitemap"))
    return web.sitemap_pages(maps.unionByName(urls), m.spark.range(1).select(F.lit("https://x/s/0").alias("url")))


@query("select url, page_id % 2 = 0 as is_sitemap, 'https://x/' || page_id as loc from pages where page_id % 5 <> 0")
def src11_sitemap_files(m):
    kind = F.when(F.col("page_id") % 2 == 0, "sitemap").otherwise("url")
    outer = F.when(F.col("page_id") % 2 == 0, "sitemapindex").otherwise("urlset")
    xml = F.concat(F.lit("<?xml version='1.0'?><"), outer, F.lit(" xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><"), kind, F.lit("><loc> https://x/"), F.col("page_id"), F.lit(" </loc></"), kind, F.lit("></"), outer, F.lit(">"))
    files = m.table("pages").select("url", F.when(F.col("page_id") % 5 == 0, F.lit("<broken")).otherwise(xml).cast("binary").alias("content"))
    return web.sitemap_edges(files).select(F.col("sitemap").alias("url"), "is_sitemap", "loc")


@query("""with recursive walk as (select 0 as n, 0 as level union select n * 3 + k, level + 1 from walk, (select unnest([1, 2, 3]) as k) where n * 3 + k < 400) select 'https://x/p/' || n as url, min(level) + 1 as level from walk group by 1""")
def src13_listing_walk(m):
    nodes = m.spark.range(400).select(F.col("id").alias("n"))
    kids = nodes.select("n", F.explode(F.array(*(F.col("n") * 3 + k for k in (1, 2, 3)))).alias("to")).where("to < 400")
    c = lambda x: F.concat(F.lit("https://x/c/"), x)
    links = kids.select(c(F.col("n")).alias("url"), c(F.col("to")).alias("link")).unionByName(nodes.select(c(F.col("n")).alias("url"), F.concat(F.lit("https://x/p/"), F.col("n")).alias("link")))
    return web.reachable(links, m.spark.range(1).select(F.lit("https://x/c/0").alias("url")), lambda u: u.contains("/c/"), lambda u: u.contains("/p/"))


@query("""select event_id, case event_id % 4 when 0 then cast(event_id % 90 as double) when 1 then 3600.0 when 2 then 0.0 end as wait, event_id % 3 = 0 or (event_id % 5 < 3 and event_id % 7 = 0) as challenge from events""")
def u9_refusals(m):
    n = F.col("event_id")
    value = F.when(n % 4 == 0, (n % 90).cast("string")).when(n % 4 == 1, "Mon, 01 Jan 2024 01:00:00 GMT").when(n % 4 == 2, "Sun, 31 Dec 2023 23:00:00 GMT").otherwise("soon")
    status = F.element_at(F.array(*map(F.lit, (403, 429, 503, 200, 404))), (n % 5 + 1).cast("int"))
    body = F.when(n % 7 == 0, "<html>Just a Moment...").otherwise("<html>")
    return m.table("events").select("event_id", web.retry_after(value, at("2024-01-01 00:00:00")).alias("wait"), web.is_challenge(status, F.when(n % 3 == 0, "challenge"), body).alias("challenge"))


def _product_pages(m):
    """A page for each part with its data as shops embed it: one offer, a group of variants, an aggregate, a sale, stray marks."""
    n, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    q = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    offer = q('{"@type":"Offer","price":"', price, '","priceCurrency":"RON","availability":"https://schema.org/', F.when(n % 3 == 0, "OutOfStock").otherwise("InStock"), '"}')
    single = q('{"@type":"Product","name":"', F.col("p_name"), '","brand":{"name":"', F.col("p_brand"), '"},"gtin13":"4006381333931","offers":', offer, "}")
    group = q('{"@graph":[{"@type":"ProductGroup","name":"', F.col("p_name"), '","brand":"', F.col("p_brand"), '","hasVariant":[{"@type":"Product","sku":"a","offers":', offer, '},{"@type":"Product","sku":"b","name":"second","offers":[', offer, "]}]}]}")
    total = q('[{"@type":["http://schema.org/Product"],"name":"', F.col("p_name"), '","offers":{"@type":"AggregateOffer","priceCurrency":"ron","offers":[{"price":', price, ',"seller":{"name":"s1"},"url":"/one"},{"price":"', F.translate(price, ".", ","), '","seller":"s2","url":"/two"},{"price":1,"priceCurrency":"EUR"}]}}]')
    sale = q('{"@type":"Product","name":"', F.col("p_name"), ' "extra" kind","offers":{"priceSpecification":[{"priceType":"https://schema.org/ListPrice","price":99999},{"price":', price, ',"priceCurrency":"RON"}]}}')
    block = F.when(n % 4 == 0, single).when(n % 4 == 1, group).when(n % 4 == 2, total).otherwise(sale)
    html = q('<html><script type="application/ld+json">{broken</script><h1>x</h1><script type="application/ld+json">', block, "</script></html>")
    return m.table("part").select(n.alias("page_id"), q("https://shop.example/p/", n).alias("url"), html.alias("html"))


BANI = "cast(round(p_retailprice * 100) as bigint)"


@query(f"""with base as (select p_partkey as page_id, 'https://shop.example/p/' || p_partkey as page, p_name, p_brand, {BANI} as b, p_partkey % 3 <> 0 as stock from part)
  select page_id, page as url, p_name as title, p_brand as brand, b as price_bani, null::bigint as old_price_bani, stock as in_stock, '4006381333931' as ean, null::varchar as seller_name from base where page_id % 4 = 0
  union all select page_id, page, p_name, p_brand, b, null, stock, null, null from base where page_id % 4 = 1
  union all select page_id, page || '#sku=b', 'second', p_brand, b, null, stock, null, null from base where page_id % 4 = 1
  union all select page_id, 'https://shop.example/one', p_name, null, b, null, true, null, 's1' from base where page_id % 4 = 2
  union all select page_id, 'https://shop.example/two', p_name, null, b, null, true, null, 's2' from base where page_id % 4 = 2
  union all select page_id, page, p_name || ' "extra" kind', null, b, case when 9999900 > b then 9999900 end, true, null, null from base where page_id % 4 = 3""")
def src7_jsonld_observations(m):
    return P.observations(_product_pages(m)).drop("currency", "image_url")


@query(f"""select p_partkey as page_id, 'https://shop.example/p/' || p_partkey as url, p_name as title, p_brand as brand, case when p_partkey % 2 = 0 then {BANI} else {BANI} + 100 end as price_bani, {BANI} + 5000 as old_price_bani, p_partkey % 3 <> 0 as in_stock, '4006381333931' as ean from part""")
def src8_page_event_observations(m):
    n, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(12,2)")
    q = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    event = q('{"*":{"', F.lit(P.EVENTS_KEY), '":{"events":[{"event":{"name":"other"}},{"event":{"name":"product_viewed"},"products":[{"id":', n, ',"name":"', F.col("p_name"), '","brand":"', F.col("p_brand"), '","price":', price.cast("string"), ',"price_base":"', (price + 50).cast("string"), '","stock_status":', F.when(n % 3 == 0, "0").otherwise("1"), "}]}]}}}")
    box = F.when(n % 2 == 1, q('<span id="product-price-', n, '" data-price-amount="', (price + 1).cast("string"), '"></span>')).otherwise("")
    html = q('<script type="text/x-magento-init">', event, "</script>", box, '<script type="application/ld+json">{"@type":"ItemPage","mainEntity":{"@type":"Product","mpn":"4006381333931"}}</script>')
    pages = m.table("part").select(n.alias("page_id"), q("https://shop.example/p/", n).alias("url"), html.alias("html"))
    return P.observations(pages, "page_event").drop("currency", "image_url", "seller_name")


@query("""select p_partkey as page_id, case when p_partkey % 2 = 0 then p_name || ' deluxe' else p_name end as title, case when p_partkey % 3 = 0 then p_brand else 'maker' end as brand, 'pic' as image_url from part""")
def src9_completed(m):
    n = F.col("p_partkey")
    found = m.table("part").select(n.alias("page_id"), F.col("p_name").alias("title"), F.when(n % 3 == 0, F.col("p_brand")).alias("brand"), F.lit(None).cast("string").alias("image_url"))
    markup = m.table("part").select(n.alias("page_id"), F.when(n % 2 == 0, F.concat(F.col("p_name"), F.lit(" deluxe"))).otherwise(F.lit("other heading that is longer")).alias("heading"), F.lit("maker").alias("maker"), F.lit("pic").alias("picture"))
    return P.completed(found, markup)


@query("""select page_id, 'https://shop.example/' || page_id as url, 'Thing ' || page_id as title, page_id % 1000 * 100 + 99 as price_bani, page_id % 3 <> 0 as in_stock from pages where page_id % 2 = 0""")
def src3_structured_data_of_pages(m):
    """Every second of the table's pages gets a block of structured data before its end, the others have none."""
    n = F.col("page_id")
    block = F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"Thing '), n, F.lit('","offers":{"@type":"Offer","price":"'), n % 1000, F.lit('.99","priceCurrency":"RON","availability":"https://schema.org/'), F.when(n % 3 == 0, "OutOfStock").otherwise("InStock"), F.lit('"}}</script>'))
    pages = m.table("pages").select("page_id", F.concat(F.lit("https://shop.example/"), n).alias("url"), F.when(n % 2 == 0, F.concat("html", block)).otherwise(F.col("html")).alias("html"))
    return P.observations(pages).select("page_id", "url", "title", "price_bani", "in_stock")


# --- matching ---------------------------------------------------------------------------

EXTRA = ["", " extra", " m", " 50", "+", ""]
LISTED = """select p_partkey + 1000000 as offer_id, p_brand || ' ' || p_name || {extra} || ' ' || p_size || ' ml' as title, p_brand as brand_name, case when p_partkey % 10 = 0 then lpad(cast(p_partkey as {text}), 13, '0') end as ean,
  cast(null as decimal(10,3)) as size_value, cast(null as {text}) as size_unit from part"""


def _listed(m):
    # titles cost far more than their bytes say: all cores take part, whatever the file's size
    n = max(m.spark.sparkContext.defaultParallelism, int(m.spark.conf.get("spark.sql.shuffle.partitions")))
    part = m.table("part").repartition(n)
    part.createOrReplaceTempView("pt_part")
    offers = m.spark.sql(LISTED.format(extra=_case("p_partkey", EXTRA), text="string").replace("from part", "from pt_part"))
    n = F.col("p_partkey")
    size = F.when(n % 17 != 0, F.col("p_size").cast("decimal(10,3)"))
    products = part.select(n.alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(n % 20 == 0, F.lpad(n.cast("string"), 13, "0")).alias("ean"), size.alias("size_value"), F.when(size.isNotNull(), "ml").alias("size_unit"))
    return offers, products


def _keys(m):
    offers, products = _listed(m)
    return E.stored(E.offer_keys(offers)), E.stored(E.product_keys(products))


_OWN = "case p_partkey % 6 when 1 then ['extra'] when 2 then ['m'] when 3 then ['50'] when 4 then ['plus'] else cast([] as varchar[]) end"
_SPECIAL = "lambda t: regexp_matches(t, '[0-9]') or t = 'plus' or length(t) <= 2"
MATCHING = {
    "mo": f"select p_partkey + 1000000 as offer_id, p_brand as brand, list_concat(string_split(p_name, ' '), {_OWN}) as a, case when p_partkey % 10 = 0 then p_partkey end as ean, p_size as size from part",
    "mp": "select p_partkey as product_id, p_brand as brand, string_split(p_name, ' ') as b, case when p_partkey % 20 = 0 then p_partkey end as p_ean, case when p_partkey % 17 <> 0 then p_size end as p_size from part",
    "mpairs": f"""select *, array_to_string(list_sort(list_intersect(a, b)), ' ') as both_, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: not list_contains(b, x)))), ' ') as own, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: not list_contains(a, x)))), ' ') as other,
      list_filter(list_distinct(list_filter(a, lambda x: not list_contains(b, x))), {_SPECIAL}) as sa, list_filter(list_distinct(list_filter(b, lambda x: not list_contains(a, x))), {_SPECIAL}) as sb
      from mo join mp using (brand) where (p_size is null or size = p_size) and (ean is null or p_ean is null or ean = p_ean)""",
    # the longest common subsequence by a row of bits: bit i is 0 where it grows at character i
    "mlcs": """select *, case when own = '' or other = '' then 0 else length(own) - bit_count(list_reduce(list_concat([cast((1::hugeint << length(own)) - 1 as hugeint)], list_transform(string_split(other, ''), lambda c: list_sum(list_transform(range(length(own)), lambda i: case when own[i + 1] = c then 1::hugeint << i else 0::hugeint end))::hugeint)),
      lambda v, x: ((v + (v & x)) | (v - (v & x))) & ((1::hugeint << length(own)) - 1))) end as m, trim(both_ || ' ' || own) as l, trim(both_ || ' ' || other) as r from mpairs""",
    "mscored": """select *, case when both_ <> '' and (own = '' or other = '') then 100.0 else greatest(100 - 100 * (length(own) + length(other) - 2 * m) / (length(l) + length(r)),
      case when both_ <> '' then greatest(100 - 100 * (length(l) - length(both_)) / (length(l) + length(both_)), 100 - 100 * (length(r) - length(both_)) / (length(r) + length(both_))) else 0 end) end as exact_score from mlcs
      where not (len(list_filter(sa, lambda t: regexp_full_match(t, '[0-9]+'))) > 0 and len(list_filter(sb, lambda t: regexp_full_match(t, '[0-9]+'))) > 0)""",
    "mfound": """select offer_id, product_id, round(exact_score, 2) as score, exact_score, array_to_string(list_filter([case when len(sa) + len(sb) > 0 then 'variant markers differ: ' || array_to_string(list_sort(list_concat(sa, sb)), ', ') end,
      case when p_size is null then 'size unknown' end], lambda x: x is not null), '; ') as doubts from mscored where exact_score >= 75""",
    "mranked": "select *, row_number() over w as place, exact_score - lead(exact_score) over w as lead_ from mfound window w as (partition by offer_id order by exact_score desc, product_id)",
    "mdecided": """select offer_id, case when o.product_id is not null then 'ean' when exact_score >= 90 and doubts = '' and coalesce(lead_, 100) >= 3 then 'fuzzy' when exact_score is not null then 'review' else 'new_product' end as method,
      coalesce(o.product_id, case when exact_score >= 90 and doubts = '' and coalesce(lead_, 100) >= 3 then k.product_id end) as product_id
      from (select mo.offer_id, p.product_id from mo left join mp p on ean = p_ean) o left join (select * from mranked where place = 1) k using (offer_id)""",
}


def msql(text: str) -> str:
    return sql(text, **MATCHING)


@query(msql("select offer_id, product_id, score, doubts from mfound"))
def m4_candidates(m):
    return E.candidates(*_keys(m)).select("offer_id", "product_id", "score", F.array_join("doubts", "; ").alias("doubts"))


@query(msql("select mo.offer_id, mp.product_id from mo join mp on ean = p_ean"))
def m2_by_ean(m):
    offers, products = _listed(m)
    return E.by_ean(E.offer_keys(offers), E.product_keys(products))


def _decided(m):
    offers, products = _keys(m)
    found = E.stored(E.leading(offers, products))
    none = offers.limit(0).select("offer_id", F.lit(0).cast("bigint").alias("product_id"))
    return offers, found, E.decisions(offers, none, found, E.by_ean(offers, products), none.select("offer_id"))


@query(msql("select offer_id, method, product_id, cast(null as varchar) as note from mdecided"))
def m6_decisions(m):
    return _decided(m)[2]


@query(msql("""select offer_id, product_id, score, case when sure and doubts <> '' then doubts || '; several close matches' when sure then 'several close matches' when doubts = '' then 'close score' else doubts end as reason, 'pending' as status from (
  select r.*, first_value(r.exact_score >= 90 and r.doubts = '') over (partition by r.offer_id order by place) as sure from mranked r join mdecided d on r.offer_id = d.offer_id where method = 'review') where place <= 5"""))
def m7_review_rows(m):
    offers, found, decided = _decided(m)
    return E.review_rows(found, decided)


@query(msql("""select 1000000000 + row_number() over (order by p_partkey) as product_id, p_partkey + 1000000 as offer_id, p_brand as brand, p_name || case p_partkey % 6 when 1 then ' extra' when 2 then ' m' when 3 then ' 50' when 4 then '+' else '' end as name, cast(p_size as double) as size_value, 'ml' as size_unit
  from part join mdecided on offer_id = p_partkey + 1000000 where method = 'new_product'"""))
def m9_new_products(m):
    offers, _ = _listed(m)
    return E.new_products(offers, _decided(m)[2], F.lit(1000000000)).drop("normalized_name", "category", "ean")


@query()
def m11_sequential(m):
    offers, products = _listed(m)
    # offers of brands that the catalogue lacks, so that new products are made too
    other = {c: F.regexp_replace(c, "^Brand#", "Marca ") for c in ("title", "brand_name")}
    offers = offers.unionByName(offers.where("offer_id % 7 = 0").withColumns({"offer_id": F.col("offer_id") + 1000000, "ean": F.lit(None).cast("string"), **other}))
    # above a million parts both kinds share numbers, so the words of a new product's name stay with their row
    named = offers.withColumns({"_name": T.display_name(F.col("title"), F.col("brand_name")), "_brand": T.canonical_brand(F.col("brand_name"))})
    own = named.withColumn("own_tokens", T.name_tokens(F.col("_name"), F.col("_brand")))
    return E.sequential(E.stored(E.offer_keys(own, "own_tokens")), E.stored(E.product_keys(products))).groupBy("method").agg(F.count("*").alias("n"), F.count("product_id").alias("linked"), F.count("created_by").alias("made"))


VERDICTS = "select offer_id, product_id, case when (offer_id + product_id) % 3 = 0 then 'approved' else 'rejected' end as verdict, offer_id % 7 as decided from queue where (offer_id + product_id) % 5 <> 0"
QUEUE = "select l_suppkey as offer_id, l_partkey as product_id, 'pending' as status from lineitem group by 1, 2"


@query(f"""with queue as ({QUEUE}), verdicts as ({VERDICTS}), joined as (select queue.*, verdict, decided, first_value(case when verdict = 'approved' then product_id end ignore nulls) over (partition by offer_id order by case when verdict = 'approved' then product_id end nulls last rows between unbounded preceding and unbounded following) as chosen from queue left join verdicts using (offer_id, product_id))
  select offer_id, product_id, case when chosen = product_id then 'approved' when chosen is not null or verdict = 'rejected' then 'rejected' else 'pending' end as status from joined""")
def m12_review_decisions(m):
    queue = m.table("lineitem").select(F.col("l_suppkey").alias("offer_id"), F.col("l_partkey").alias("product_id")).distinct().withColumn("status", F.lit("pending"))
    total = F.col("offer_id") + F.col("product_id")
    verdicts = queue.where(total % 5 != 0).select("offer_id", "product_id", F.when(total % 3 == 0, "approved").otherwise("rejected").alias("verdict"), (F.col("offer_id") % 7).alias("at"))
    return E.approved(queue, verdicts)[0]


@query(f"""with queue as (select *, case when (offer_id + product_id) % 4 = 0 then 'pending' else 'rejected' end as verdict from ({QUEUE})) select offer_id from queue group by 1 having bool_and(verdict = 'rejected') and offer_id % 2 = 0""")
def m13_to_rematch(m):
    total = F.col("offer_id") + F.col("product_id")
    queue = m.table("lineitem").select(F.col("l_suppkey").alias("offer_id"), F.col("l_partkey").alias("product_id")).distinct().withColumn("status", F.when(total % 4 == 0, "pending").otherwise("rejected"))
    return E.to_rematch(queue, m.table("supplier").select(F.col("s_suppkey").alias("offer_id")).where("offer_id % 2 = 1"))


@query("""select p_partkey as product_id, case when p_partkey % 4 = 0 then 'E' || p_partkey when p_partkey % 2 = 0 then 'E' || (p_partkey + 1) end as ean, 'img' || p_partkey as image_url from part""")
def m10_enriched(m):
    n = F.col("p_partkey")
    products = m.table("part").select(n.alias("product_id"), F.when(n % 4 == 0, F.concat(F.lit("E"), n)).alias("ean"), F.lit(None).cast("string").alias("image_url"))
    # of two listings that offer one identifier the earlier gives it; identifiers that a product has are not given again
    links = m.table("part").select((n * 2).alias("offer_id"), n.alias("product_id"), F.when(n % 2 == 0, F.concat(F.lit("E"), n + 1)).when(n % 4 == 1, F.concat(F.lit("E"), n)).otherwise(F.concat(F.lit("E"), n - n % 4)).alias("ean"), F.concat(F.lit("img"), n).alias("image_url"))
    return E.enriched(products, links)


# --- streaming --------------------------------------------------------------------------

@query(sql("select retailer_id, listing, arrival, epoch_us(seen_at) as seen_at, price_bani, in_stock from history", obs=PARTS["visits"]))
def st1_stream_changes(m):
    import uuid

    from ..streaming import upsert

    schema = m.table("events").schema
    source = m.spark.readStream.schema(schema).parquet(f"{m.path}/events.parquet*")
    rows = Market.visits.func(_Streamed(m.spark, m.path, source))
    root = f"{E._scratch(m.spark)}-stream-{uuid.uuid4().hex}"
    upsert.append_history(upsert.changes(rows), f"{root}/history", f"{root}/checkpoint").awaitTermination()
    return m.spark.read.schema(upsert.OUT).parquet(f"{root}/history").drop("outcome")


class _Streamed:
    """A market whose one table is a stream."""

    def __init__(self, spark, path, source):
        self.spark, self.path, self.source = spark, path, source

    def table(self, name):
        return self.source
