"""The market's relations for DuckDB: common table expressions, each with those it needs."""

from __future__ import annotations

import re

BRAND_ID = "cast(regexp_extract(p_brand, '([0-9]+)', 1) as bigint)"
KEY = "partition by retailer_id, listing"
ORDER = "order by arrival, seen_at, price_bani"

PARTS: dict[str, str] = {
    "obs": """select l_suppkey as retailer_id, l_partkey as listing, l_orderkey * 100 + l_linenumber as arrival, l_shipdate as seen_at, cast(round(l_extendedprice * 100 / l_quantity) as bigint) as price_bani,
       case when l_discount >= 0.05 then cast(round(l_extendedprice * 100 / l_quantity / (1 - l_discount)) as bigint) end as old_price_bani, l_returnflag <> 'R' as in_stock,
       case when l_linestatus = 'O' then 'seller ' || l_linenumber end as seller_name from lineitem""",
    "late": f"select *, max(seen_at) over ({KEY} {ORDER} rows between unbounded preceding and 1 preceding) as seen from obs",
    "fresh": f"select *, lag(price_bani) over k as was, lag(in_stock) over k as stocked, row_number() over k as n from late where seen is null or seen_at >= seen window k as ({KEY} {ORDER})",
    "history": "select retailer_id, listing, arrival, seen_at, price_bani, old_price_bani, in_stock from fresh where n = 1 or price_bani is distinct from was or in_stock is distinct from stocked",
    "outcomes": """select retailer_id, listing, arrival, 'stale' as outcome from late where seen_at < seen union all
       select retailer_id, listing, arrival, case when n = 1 then 'created' when price_bani is distinct from was or in_stock is distinct from stocked then 'changed' else 'unchanged' end from fresh""",
    "state": f"""select retailer_id, listing, price_bani, old_price_bani, in_stock, last_value(seller_name ignore nulls) over w as seller_name, first_value(seen_at) over w as first_seen_at, max(seen_at) over w as last_seen_at
       from fresh window w as ({KEY} {ORDER} rows between unbounded preceding and unbounded following) qualify row_number() over ({KEY} order by arrival desc, seen_at desc, price_bani desc) = 1""",
    "offers": "select retailer_id * 1000000000 + listing as id, case when (retailer_id + listing) % 4 <> 0 then listing end as product_id, 'https://shop-' || retailer_id || '.example/p/' || listing as url, * from state",
    "shops": "select s_suppkey as id, lower(replace(s_name, '#', '-')) as slug, s_name as name, s_acctbal >= 0 as is_active from supplier",
    "retailers": "select shops.*, 24 as crawl_interval_hours, last_crawled_at from shops left join (select l_suppkey as id, max(l_shipdate) as last_crawled_at from lineitem group by 1) using (id)",
    "brands": f"select distinct {BRAND_ID} as id, p_brand as name, trim(regexp_replace(lower(p_brand), '[^0-9a-z]+', ' ', 'g')) as normalized_name from part",
    "products": f"select p_partkey as id, {BRAND_ID} as brand_id, p_name as name, lower(p_name) as normalized_name, cast(p_size as double) as size_value, 'ml' as size_unit, p_type as category from part",
    "lows": "select *, min(case when in_stock then price_bani end) over (partition by product_id) as low from offers where product_id is not null",
    "stats": """select product_id, max(low) as lowest_price_bani, count(*) as offer_count, count(distinct retailer_id) as retailer_count, bool_or(in_stock) as in_stock,
       coalesce(bool_or(in_stock and price_bani = low and old_price_bani > price_bani), false) as on_sale from lows group by 1""",
    "summaries": """select products.id, products.name, brands.name as brand, size_value, size_unit, category, lowest_price_bani, coalesce(offer_count, 0) as offer_count, coalesce(retailer_count, 0) as retailer_count,
       coalesce(in_stock, false) as in_stock, coalesce(on_sale, false) as on_sale, products.normalized_name as folded, brands.normalized_name as brand_key
       from products left join brands on brand_id = brands.id left join stats on product_id = products.id""",
    "reps": """select product_id, retailer_id, price_bani, in_stock from offers where product_id is not null qualify row_number() over (partition by product_id, retailer_id order by not in_stock, price_bani, id) = 1""",
    "market": "select product_id, min(price_bani) filter (where in_stock) as market_min_bani, cast(round_even(median(price_bani) filter (where in_stock), 0) as bigint) as market_median_bani from reps group by 1",
    "compared": """select product_id, slug, price_bani, in_stock, market_min_bani, market_median_bani, {min_pct} as vs_min_pct, {mid_pct} as vs_median_pct, coalesce(in_stock and price_bani = market_min_bani, false) as is_cheapest
       from reps join market using (product_id) join shops on retailer_id = shops.id""",
    "visits": """select user_id as retailer_id, event_type as listing, (event_id * 7919) % 1000003 as arrival, ts as seen_at, cast(round(value * 100) as bigint) as price_bani, cast(null as bigint) as old_price_bani,
       event_id % 5 <> 0 as in_stock, cast(null as varchar) as seller_name from events""",
    "titles": """select p_partkey as product_id, p_brand as brand, p_name, p_type, p_size,
       case p_partkey % 7 when 0 then 'PROMO ' when 1 then '[SALE] ' when 2 then 'NEW! ' else '' end || p_brand || ' ' || case when p_partkey % 3 = 0 then p_name || '+' else array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') end
       || ' ' || p_type || ' ' || case p_partkey % 11 when 0 then '2 x ' || p_size || ' ml' when 1 then p_size || ' ml x 3' when 2 then '1,5 l' when 3 then '' else p_size || ' ml' end
       || case p_partkey % 5 when 0 then ' -20%' when 1 then ' + Cadou gel 50 ml' when 2 then ' (Reducere 15%)' else '' end as title from part""",
}


def round1(value: str) -> str:
    return f"(cast(printf('%.1f', {value}) as double) + 0.0)"


PARTS["compared"] = PARTS["compared"].format(min_pct=round1("(price_bani - market_min_bani) * 100 / nullif(market_min_bani, 0)"), mid_pct=round1("(price_bani - market_median_bani) * 100 / nullif(market_median_bani, 0)"))


def sql(query: str, **own: str) -> str:
    """`query` with the relations it names, in order; `own` replaces or adds some."""
    parts = PARTS | own
    used: dict[str, str] = {}

    def need(text: str) -> None:
        for name in parts:
            if name not in used and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                used[name] = ""
                need(parts[name])
                used[name] = used.pop(name) or parts[name]

    need(query)
    return ("with " + ",\n".join(f"{k} as ({v})" for k, v in used.items()) + "\n" if used else "") + query
