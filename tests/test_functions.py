from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricetide.functions import numbers as N
from pricetide.functions import rules
from pricetide.functions import text as T

FOLD = {"  L’Orée   Țară ": "l'oree tara", "STRAẞE ß": "strasse ss", "Ţesătură\xa0fină": "tesatura fina", "ﬁn ²": "fin 2", "": ""}


def test_fold_agrees_with_unicode(mapped):
    assert mapped(T.fold, *FOLD) == [*FOLD.values()] == [T.folded(x) for x in FOLD] == mapped(T.fold_exact, *FOLD)


def test_brands(mapped):
    assert mapped(T.brand_key, "L'ORÉAL  Paris®", "A-Derma", "™") == ["loreal paris", "a derma", ""]
    assert mapped(T.canonical_brand, "ysl", " Nobody  Known™ ", "", None) == ["Yves Saint Laurent", "Nobody Known", None, None]
    assert len(T.aliases()) >= len(rules.BRANDS)


@pytest.mark.parametrize(("raw", "clean"), [("PROMO Crema 50 ml -20%", "Crema 50 ml"), ("Ser [SALE] + Cadou mini", "Ser"), ("Niacinamide 10% ser", "Niacinamide 10% ser"), ("Set cadou ruj", "Set cadou ruj"), ("Balsam B5+", "Balsam B5+"), ("Ofertă specială: Lapte", "Lapte"), ("NEW! Fard (Reducere 15%)", "Fard"), ("Maybelline New York", "Maybelline New York")])
def test_clean_title(mapped, raw, clean):
    assert mapped(lambda c: T.clean_title(T.clean_title(c)), raw) == mapped(T.clean_title, raw) == [clean]


@pytest.mark.parametrize(("title", "size"), [
    ("Crema 50 ml", (50, "ml", 1)), ("Ulei 1,5 L", (1500, "ml", 1)), ("2 x 50 ml (100 ml)", (50, "ml", 2)), ("50ml x 3", (50, "ml", 3)), ("crema 50 ml + ser 30 ml", None), ("30 lei", None),
    ("60 capsule", (60, "buc", 1)), ("500 mg", (Decimal("0.5"), "g", 1)), ("5 gel", None), ("", None),
])
def test_parse_size(mapped, title, size):
    found = mapped(N.parse_size, title)[0]
    assert (found and (found["value"], found["unit"], found["count"])) == size


@pytest.mark.parametrize(("text", "bani"), [("1.234,99 lei", 123499), ("49,90 RON", 4990), ("de la 30 lei", 3000), ("Lei 1 299", 129900), ("Gel 40 ml 89,99 lei", 8999), ("1.234 lei", 123400), ("-20% 79,99", 7999), ("129.995 lei", 12999500), ("nimic", None), (None, None)])
def test_parse_price(mapped, text, bani):
    assert mapped(N.parse_price, text) == [bani]


def test_machine_prices(mapped):
    assert mapped(N.parse_machine_price, "1234.5", "49,90", "1,234.50", "49.90 RON", "NaN", "-3", "x", None) == [123450, 4990, 123450, 4990, None, None, None, None]
    pair = mapped(N.parse_price_pair, "129,99 lei 99,99 lei", "10 lei", "")
    assert [(p["current"], p["old"]) for p in pair] == [(9999, 12999), (1000, None), (None, None)]


def test_names(spark):
    rows = spark.createDataFrame([("La Roche-Posay Effaclar Duo+ Cremă 40 ml", "LRP"), ("Vichy Minéral 89 pentru ten", "Vichy"), ("x", None)], "t string, b string")
    got = rows.select(F.array_join(T.name_tokens(F.col("t"), F.col("b")), " "), T.display_name(F.col("t"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("effaclar duo plus crema", "Effaclar Duo+ Cremă"), ("mineral 89 ten", "Minéral 89 pentru ten"), ("x", "x")]


def test_rounding_is_half_even_on_the_binary_value(spark):
    values = [5.55, 0.35, 0.45, -0.04, 2.25, 1.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(N.round1(F.col("v"))).collect()
    assert [r[0] for r in got] == [round(v, 1) + 0.0 for v in values]


def test_gtin(mapped):
    assert mapped(N.gtin, "4006381333931", "400-6381 333931", "4006381333932", "12345670", "abc", None) == ["4006381333931", "4006381333931", None, "12345670", None, None]


def test_display(spark):
    rows = spark.createDataFrame([(1234599, 11.1, True, Decimal("40.000")), (None, None, True, None), (-5, -5.0, False, Decimal("1.500"))], "b bigint, p double, s boolean, v decimal(10,3)")
    got = rows.select(N.format_lei(F.col("b")), N.format_pct(F.col("p")), N.market_position(F.col("p"), F.col("s")), N.format_size(F.col("v"), F.lit("ml")), N.heat(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("12.345,99 lei", "+11,1%", "Peste piață", "40 ml", 0.3032), ("—", "—", "—", "", 0.0), ("-0,05 lei", "-5,0%", "Stoc epuizat", "1,5 ml", 0.2025)]


def test_categories(mapped):
    assert mapped(T.categorize, "Set cadou apă de toaletă", "Șampon nuanțator", "Pensula fond de ten", "obiect") == ["Seturi & cadouri", "Șampon", "Accesorii & aparate", "Altele"]
    assert {c for c, _ in rules.CATEGORY_PATTERNS} | {rules.OTHER} == set(rules.CATEGORIES)
