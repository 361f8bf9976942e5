import random
from datetime import datetime, timedelta
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricetide.operators import catalog, history, market, matching, schedule, validate
from pricetide.sources import pages, web

OBS = "retailer_id bigint, listing string, arrival bigint, seen_at timestamp, price_bani bigint, old_price_bani bigint, in_stock boolean, seller_name string"
DAY = datetime(2024, 1, 1)


def day(n):
    return DAY + timedelta(days=n)


@pytest.fixture
def seen(table):
    """Observations of one listing: (day, price, in stock) in order of arrival."""
    return lambda *rows, key="a": table(OBS, *((1, key, i, day(d), p, None, s, None) for i, (d, p, s) in enumerate(rows)))


def outcomes(df):
    return [r.outcome for r in history.marked(df).orderBy("arrival").collect()]


def test_outcomes(seen):
    assert outcomes(seen((1, 10, True), (2, 10, True), (1, 5, True), (2, 9, True), (3, 9, False), (4, 9, False))) == ["created", "unchanged", "stale", "changed", "changed", "unchanged"]


def test_a_price_that_comes_back_is_three_rows(seen):
    assert history.change_history(seen((1, 10, True), (2, 12, True), (3, 10, True))).count() == 3


def test_delivered_twice_is_the_same(seen):
    rows = [(1, 10, True), (2, 12, True)]
    assert history.change_history(seen(*rows, rows[-1])).count() == history.change_history(seen(*rows)).count()


def test_state_keeps_what_is_missing(table):
    rows = table(OBS, (1, "a", 1, day(1), 10, 12, True, "s"), (1, "a", 2, day(2), 10, None, True, None))
    state = history.current_state(rows).first()
    assert (state.old_price_bani, state.seller_name, state.first_seen_at, state.last_seen_at) == (None, "s", day(1), day(2))


@pytest.mark.parametrize(("rows", "min_pct", "drop"), [
    ([(1, 10000, True), (2, 7500, True)], 10, 25.0), ([(1, 10000, True), (2, 9000, True)], 10, 10.0), ([(1, 10000, True), (2, 9000, True)], 10.1, None),
    ([(1, 10000, True), (2, 7000, True), (3, 8000, True)], 10, None), ([(1, 10000, False), (2, 8000, True)], 10, 20.0), ([(1, 10000, True), (2, 7000, True), (3, 7000, False)], 10, None),
])
def test_drops(seen, rows, min_pct, drop):
    found = history.price_drops(history.change_history(seen(*rows)), F.lit(day(1)), min_pct).collect()
    assert [r.drop_pct for r in found] == ([drop] if drop else [])


def test_window_keeps_the_price_in_effect(seen):
    kept = history.window_from(history.change_history(seen((1, 1, True), (3, 2, True), (5, 3, True))), F.lit(day(4))).collect()
    assert sorted(r.price_bani for r in kept) == [2, 3]


def test_absences(spark, seen):
    runs = spark.createDataFrame([(1, day(n), day(n) + timedelta(hours=1)) for n in range(2, 7)], "retailer_id bigint, run_at timestamp, until timestamp")
    got = [(r.missed_runs, r.marked) for r in history.absences(seen((1, 5, True)), runs).orderBy("run_at").collect()]
    assert got == [(1, False), (2, False), (3, True), (4, False), (5, False)]


def test_give_up(table):
    log = table("retailer_id int, n int, status int", *((1, i, 429 if i in (2, 3, 5, 6, 7, 8, 9) else 200) for i in range(12)))
    assert [tuple(r) for r in history.give_up(log).collect()] == [(1, 10, True)]


OFFERS = "id int, product_id int, retailer_id int, price_bani int, old_price_bani int, in_stock boolean, last_seen_at timestamp"


def test_compare(table):
    offers = table(OFFERS, (1, 7, 1, 10000, None, True, DAY), (2, 7, 2, 9000, None, True, DAY), (3, 7, 2, 8000, None, True, DAY), (4, 7, 3, 7000, None, False, DAY))
    shops = table("id int, slug string", (1, "a"), (2, "b"), (3, "c"))
    got = {r.slug: r for r in market.compare(offers, shops).collect()}
    assert {(r.market_min_bani, r.market_median_bani) for r in got.values()} == {(8000, 9000)}
    assert (got["a"].vs_min_pct, got["b"].is_cheapest, got["c"].vs_min_pct, got["c"].is_cheapest) == (25.0, True, -12.5, False)


def test_sale_needs_the_lowest_price(table):
    offers = table(OFFERS, (1, 7, 1, 100, 200, True, DAY), (2, 7, 2, 90, None, True, DAY), (3, 8, 1, 50, 60, True, DAY))
    assert {r.product_id: r.on_sale for r in catalog.offer_stats(offers).collect()} == {7: False, 8: True}


def test_unknown_shop_among_all_is_nobody(table):
    products = table("id int, brand_id int, name string, normalized_name string, size_value decimal(10,3), size_unit string, category string", (7, 1, "x", "x", None, None, None))
    brands, shops = table("id int, name string, normalized_name string", (1, "B", "b")), table("id int, slug string", (1, "a"))
    offers = table(OFFERS, (1, 7, 1, 100, None, True, DAY))
    ask = lambda *who: catalog.search_products(products, brands, offers, shops, catalog.Search(retailers=[*who], common=True)).count()
    assert (ask("a"), ask("a", "nobody")) == (1, 0)


def test_schedule(table):
    shops = table("slug string, is_active boolean, last_crawled_at timestamp, crawl_interval_hours int", ("a", True, day(1), 24), ("b", True, None, 24), ("c", False, day(1), 24))
    got = {r.slug: r.skipped for r in schedule.skip_reasons(shops, F.lit(day(1)), F.lit(True)).collect()}
    assert got == {"a": "not due until 2024-01-03 00:00", "b": "time limit reached before this retailer's turn", "c": "retailer is marked inactive"}


def test_validation(table):
    schema = "retailer string, url string, title string, price_bani bigint, old_price_bani bigint, currency string, brand string, ean string, size_value double, size_unit string"
    good, bad = validate.split(table(schema, ("s", "https://x", " a  b ", 5, 4, "RON", "", "1", None, None), (" ", "x", None, -1, 4, "lei", None, None, 1.0, None)))
    assert (good.first().title, good.first().brand, good.first().old_price_bani) == ("a b", None, None)
    assert bad.first().errors == "retailer,url,title,price,currency,size"


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_subsequences():
    for a, b in (("", "x"), ("abcbdab", "bdcaba"), ("crema ten gras", "gel ten"), ("aaaa", "aa")):
        assert matching._matches(a, b) == brute_lcs(a, b)


def test_scores():
    assert matching.token_set_ratio("effaclar duo plus", "effaclar duo plus crema corectoare") == 100
    assert 75 <= matching.token_set_ratio("effaclar duo plus", "effaclar duo plus m") <= 100
    assert matching.token_set_ratio("a b", "c d") < 75


LISTED = "offer_id bigint, title string, brand_name string, ean string, size_value decimal(10,3), size_unit string"
SHELF = "product_id bigint, name string, brand string, ean string, size_value decimal(10,3), size_unit string"


def keys(table, offers, shelf):
    from pricetide.functions import text as T

    o = table(LISTED, *offers)
    name = T.display_name(F.col("title"), F.col("brand_name"))
    named = o.select("offer_id", name.alias("name"), T.canonical_brand(F.col("brand_name")).alias("brand"))
    own = named.select("offer_id", T.name_tokens(F.col("name"), F.col("brand")).alias("own_tokens"))
    return matching.offer_keys(o).join(own, "offer_id"), matching.product_keys(table(SHELF, *shelf))


def test_keys_are_worked_out_once_for_equal_listings(spark, table, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), matching.T.name_tokens

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    monkeypatch.setattr(matching.T, "name_tokens", lambda name, brand: plain(counted(name), brand))
    kinds = [("Acme Crema Ten 50 ml", "Acme", None, None), ("Acme Gel", "Acme", Decimal("50.000"), "ml"), ("Acme Gel", "Acme", None, None), (None, "Acme", None, None), ("Gel", None, None, None)]
    offers = table(LISTED, *((i, *kinds[i % 5][:2], f"e{i}" if i % 2 else None, *kinds[i % 5][2:]) for i in range(60)))
    got = {r.offer_id: r for r in matching.offer_keys(offers, "title").collect()}
    assert seen.value <= 2 * len(kinds) and sorted(got) == list(range(60))
    for i, r in got.items():
        assert (r.title, r.ean) == (kinds[i % 5][0], f"e{i}" if i % 2 else None) and r[1:4] + r[5:8] == got[i % 5][1:4] + got[i % 5][5:8]
    assert (got[0].tokens, got[0].size, got[1].size, got[2].size, got[4].brand_key) == (["crema", "ten"], 50, 50, None, None)
    seen.value = 0
    shelf = table(SHELF, *((i, "Crema Ten" if i % 2 else None, "Acme", f"e{i}", Decimal(i), "ml") for i in range(40)))
    found = {r.product_id: (r.p_name_key, r.p_ean, r.p_size) for r in matching.product_keys(shelf).collect()}
    assert seen.value <= 4 and len(found) == 40 and all(x[1:] == (f"e{i}", i) for i, x in found.items()) and {x[0] for i, x in found.items() if i % 2} == {"crema ten"}


def test_matching_stages(table):
    offers, products = keys(table, [
        (1, "Vichy Mineral 89 50 ml", "Vichy", None, None, None), (2, "Vichy Mineral 98 50 ml", "Vichy", None, None, None), (3, "Vichy Mineral 89 M 50 ml", "Vichy", None, None, None),
        (4, "altceva", "Vichy", "4006381333931", None, None), (5, "2 x 50 ml Vichy Alt", "Vichy", None, None, None), (6, "Fara marca", None, None, None, None),
    ], [(10, "Mineral 89", "Vichy", None, Decimal(50), "ml"), (11, "Cod", "Nuxe", "4006381333931", Decimal(30), "ml")])
    found = matching.candidates(offers, products)
    none = offers.limit(0).select("offer_id", F.lit(0).alias("product_id"))
    got = {r.offer_id: (r.method, r.product_id, r.note) for r in matching.decisions(offers, none, found, matching.by_ean(offers, products), none.select("offer_id")).collect()}
    assert got == {1: ("fuzzy", 10, None), 2: ("new_product", None, None), 3: ("review", None, None), 4: ("ean", 11, None), 5: ("unmatched", None, "multipack of 2"), 6: ("unmatched", None, "brand unknown")}


def test_in_order_a_new_product_is_there_for_the_next(table):
    offers, products = keys(table, [(1, "Nuxe Huile 50 ml", "Nuxe", None, None, None), (2, "Nuxe Huile 50 ml", "Nuxe", "4006381333931", None, None), (3, "Altul", "Vichy", "4006381333931", None, None)], [(9, "Alta", "Vichy", None, Decimal(5), "ml")])
    got = {r.offer_id: (r.method, r.created_by) for r in matching.sequential(offers, products).collect()}
    assert got == {1: ("new_product", 1), 2: ("fuzzy", 1), 3: ("ean", 1)}


def many(table, n=120):
    """Offers and products of two brands with few names, known and unknown sizes, packs, and identifiers."""
    r = random.Random(n)
    name = lambda: " ".join(r.sample("red blue hot cold ring bolt gear 50 30 plus m".split(), r.randint(1, 3)))
    ean = lambda: r.choice([None, None, None, "4006381333931", "4006381333948"])
    size = lambda: r.choice([None, None, Decimal(50), Decimal(100)])
    offers = [(i, f"{r.choice(['', '2 x 50 ml '])}{name()}{r.choice(['', ' 50 ml', ' 100 ml'])}", r.choice(["Vichy", "Nuxe"]), ean(), None, None) for i in range(n)]
    return keys(table, offers, [(1000 + i, name(), r.choice(["Vichy", "Nuxe"]), ean(), s := size(), s and "ml") for i in range(n)])


def slow_candidates(offers, products):
    """Every offer against every product: {(offer, product): (score, sizes known, packs)}."""
    special = lambda words: {t for t in words if any(c.isdigit() for c in t) or t == "plus" or len(t) <= 2}
    out = {}
    for o in offers.collect():
        for p in products.collect():
            sizes = o.size is not None and p.p_size is not None
            if o.brand_key != p.brand_key or not o.tokens or not p.p_tokens or o.ean and p.p_ean and o.ean != p.p_ean or sizes and not (o.unit == p.p_unit and p.p_size in (o.size, o.size * o.packs)):
                continue
            a, b = special({*o.tokens} - {*p.p_tokens}), special({*p.p_tokens} - {*o.tokens})
            score = matching.token_set_ratio(o.name_key, p.p_name_key)
            if score >= 75 and not (any(t.isdigit() for t in a) and any(t.isdigit() for t in b)):
                marks = [f"variant markers differ: {', '.join(sorted(a | b))}"] if a | b else []
                out[o.offer_id, p.product_id] = (score, marks + ([] if sizes else ["size unknown"]) + ([f"multipack of {o.packs}"] if o.packs > 1 else []))
    return out


def test_candidates_are_those_of_every_pair(table):
    offers, products = map(matching.stored, many(table, 60))
    got = {(r.offer_id, r.product_id): (r.exact_score, r.doubts) for r in matching.candidates(offers, products).collect()}
    assert got and got == slow_candidates(offers, products)


def test_rows_are_joined_only_where_names_are_similar(table):
    offers, products = many(table)
    own, theirs = matching._sides(offers, products)
    joined = matching._pairs(own, theirs.drop("ean"), matching._similar(own, theirs, 75.0))
    assert joined.where("ean is null or p_ean is null or ean = p_ean").count() == matching.candidates(offers, products).count() > 0
    assert joined.agg(F.min("exact_score")).first()[0] >= 75


@pytest.mark.parametrize("most", [2, 5])
def test_leading_candidates_are_the_first_places(table, most):
    offers, products = map(matching.stored, many(table))
    every = matching.ranked(matching.candidates(offers, products))
    no = every.where("place in (1, 3)").select("offer_id", "product_id").where("offer_id % 4 = 0")
    for rejected in (None, no):
        want = matching.ranked(matching.candidates(offers, products, rejected)).where(f"place <= {most}").drop("place", "lead").collect()
        got = matching.leading(offers, products, rejected, most=most).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and max(r.place for r in every.collect()) > most


def slow_fold(offers, products, limits):
    """`_fold` by holding each offer against every product."""
    shelf = [{"id": p.product_id, "by": None, "brand": p.brand_key, "tokens": p.p_tokens, "ean": p.p_ean, "size": p.p_size, "unit": p.p_unit} for p in products.sort_values("product_id").itertuples()]
    special = lambda words: {t for t in words if any(c.isdigit() for c in t) or t == "plus" or len(t) <= 2}
    out = []
    for o in offers.sort_values("offer_id").itertuples():
        same, found, product = [p for p in shelf if o.ean and p["ean"] == o.ean], [], None
        for at, p in enumerate(shelf):
            sizes = o.size is not None and p["size"] is not None
            if p["brand"] != o.brand_key or not o.tokens or not p["tokens"] or o.ean and p["ean"] or sizes and not (p["unit"] == o.unit and p["size"] in (o.size, o.size * o.packs)):
                continue
            a, b = special({*o.tokens} - {*p["tokens"]}), special({*p["tokens"]} - {*o.tokens})
            score = matching.token_set_ratio(" ".join(o.tokens), " ".join(p["tokens"]))
            if score >= limits.review and not (any(t.isdigit() for t in a) and any(t.isdigit() for t in b)):
                found.append((-score, at, bool(a or b) or not sizes or o.packs > 1))
        found.sort()
        if same:
            method, product = "ean", same[0]
        elif found:
            sure = -found[0][0] >= limits.auto and not found[0][2] and (len(found) == 1 or found[1][0] - found[0][0] >= limits.margin)
            method, product = ("fuzzy", shelf[found[0][1]]) if sure else ("review", None)
        elif not o.brand_key or o.packs > 1:
            method = "unmatched"
        else:
            method, product = "new_product", {"id": None, "by": o.offer_id, "brand": o.brand_key, "tokens": o.own_tokens, "ean": None, "size": o.size, "unit": o.unit}
            shelf.append(product)
        if product and not product["ean"] and o.ean and not same:
            product["ean"] = o.ean
        out.append((o.offer_id, method, product and product["id"], product and product["by"]))
    return out


def folds(seed, n, words="red blue hot cold ring bolt gear 50 30 plus xl m".split()):
    r = random.Random(seed)
    amount = lambda: r.choice([(None, None), (Decimal(2), "ml"), (Decimal("4.000"), "ml"), (Decimal(4), "g")])
    some = lambda: [r.choice(words) for _ in range(r.randint(r.random() > 0.1, 3))]
    ean = lambda: r.choice([None, None, *"1234567"])
    products = [(i, r.choice("ab"), some(), ean(), *amount()) for i in range(n // 2)]
    offers = [(1000 + i, r.choice(["a", "b", "c", ""]), some(), ean(), *amount(), r.choice([1, 1, 2]), some()) for i in range(n)]
    return pd.DataFrame(offers, columns="offer_id brand_key tokens ean size unit packs own_tokens".split(), dtype=object), pd.DataFrame(products, columns="product_id brand_key p_tokens p_ean p_size p_unit".split(), dtype=object)


@pytest.mark.parametrize("seed", range(40))
def test_fold_is_that_of_every_pair(seed):
    limits = matching.Thresholds(auto=60.0, review=40.0) if seed % 2 else matching.Thresholds()
    got = matching._fold(*folds(seed, 40), limits)
    plain = lambda x: None if pd.isna(x) else x
    assert [tuple(map(plain, r)) for r in got.drop(columns="note").itertuples(index=False)] == slow_fold(*folds(seed, 40), limits)


def test_fold_scores_a_pair_of_names_once(monkeypatch):
    """20 names in 2000 offers and 1000 products: at most each with each, in each of two brands."""
    asked, ratio = [], matching.token_set_ratio
    monkeypatch.setattr(matching, "token_set_ratio", lambda a, b: asked.append(1) or ratio(a, b))
    offers, products = folds(1, 2000, [f"name{chr(97 + i)}" for i in range(20)])
    for frame, columns in ((offers, ("tokens", "own_tokens")), (products, ("p_tokens",))):
        for c in columns:
            frame[c] = frame[c].str[:1]
    matching._fold(offers, products, matching.Thresholds())
    assert len(asked) <= 4 * 20 * 20


def test_reviews(table):
    queue = table("offer_id int, product_id int, status string", (1, 1, "pending"), (1, 2, "pending"), (2, 1, "pending"), (3, 1, "rejected"))
    verdicts = table("offer_id int, product_id int, verdict string, at int", (1, 2, "rejected", 1), (1, 2, "approved", 2), (2, 1, "rejected", 1))
    done, links = matching.approved(queue, verdicts)
    assert {(r.offer_id, r.product_id): r.status for r in done.collect()} == {(1, 1): "rejected", (1, 2): "approved", (2, 1): "rejected", (3, 1): "rejected"}
    assert sorted(r.offer_id for r in matching.to_rematch(done, links).collect()) == [2, 3]


def test_lenient_json():
    assert pages.lenient_json('{"a": "un "citat" aici", "b": 1}') == {"a": 'un "citat" aici', "b": 1}
    assert pages.lenient_json("{") is None


def test_jsonld_of_variants_at_one_address():
    html = '<script type="application/ld+json">{"@type":"ProductGroup","name":"N","hasVariant":[{"@type":"Product","sku":"1","offers":{"price":"10,50"}},{"@type":"Product","offers":{"price":11}},{"@type":"Product","sku":"3","offers":{"price":12,"priceCurrency":"EUR"}}]}</script>'
    assert [(r["url"], r["price_bani"], r["in_stock"]) for r in pages.from_jsonld(html, "https://x/p")] == [("https://x/p", 1050, True)]


def test_robots(table):
    rules = web.robots_rules(table("host string, text string", ("x", "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\n"), ("y", "")))
    urls = table("url string", ("https://x/a/c",), ("https://x/a/b",), ("https://x/f.pdf",), ("https://x/f.pdf?x=1",), ("https://y/a",), ("https://x/robots.txt",))
    got = {r.url: r.allowed for r in web.allowed(urls, rules, "any/1").collect()}
    assert got == {"https://x/a/c": False, "https://x/a/b": True, "https://x/f.pdf": False, "https://x/f.pdf?x=1": True, "https://y/a": True, "https://x/robots.txt": True}


def test_a_category_of_many_pages_is_walked_to_its_end(table):
    page = "https://x/c?page={}".format
    links = [(page(n), page(n + 1)) for n in range(1, 60)] + [(page(n), f"https://x/p/{n}") for n in range(1, 61)]
    walk = lambda **more: {r.url: r.level for r in web.reachable(table("url string, link string", *links), table("url string", (page(1),)), lambda u: u.contains("/c"), lambda u: u.contains("/p/"), **more).collect()}
    assert walk() == {f"https://x/p/{n}": n for n in range(1, 61)}
    assert walk(cap=7) == {f"https://x/p/{n}": n for n in range(1, 8)}


def test_stream_agrees_with_batch(spark, tmp_path):
    from pricetide.streaming import upsert

    rows = [(i % 3, f"l{i % 2}", (i * 7) % 50, day(i % 9), 100 + i % 4, None, i % 5 != 0, None) for i in range(50)]
    batch = spark.createDataFrame(rows, OBS)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    upsert.append_history(upsert.changes(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    want = history.change_history(batch).toPandas()
    key = ["retailer_id", "listing", "arrival", "price_bani", "in_stock"]
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), want[key].sort_values(key).reset_index(drop=True))
