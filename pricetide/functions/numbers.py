"""Prices, sizes and percentages as column expressions; money is integer bani throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import fold, let


def round1(v: Column) -> Column:
    """One decimal, half to even on the exact binary value."""
    return F.expr("0.0D") + F.call_function("format_number", v, F.lit("0.0")).cast("double")


def to_bani(amount: Column) -> Column:
    """Decimal lei to bani, half up."""
    return F.round(amount.cast("decimal(18,6)") * 100, 0).cast("bigint")


def written_number(raw: Column) -> Column:
    """A number as shops write it: of two separators the last is the decimal one; a lone one with three digits after it, or several times, groups thousands."""
    return let(F.translate(raw, rules.GROUP_SPACES, ""), _separated)


def _separated(s: Column) -> Column:
    """What stands behind the last separator is a fraction unless the separators are all of one kind and group thousands."""
    marks = F.translate(s, "0123456789", "")  # the separators alone, in order
    last = F.substring_index(F.translate(s, ",", "."), ".", -1)  # the figures behind the last one
    kinds = F.length(F.translate(marks, ",", "")) * F.length(F.translate(marks, ".", ""))  # 0 if they are all of one kind
    whole = (kinds == 0) & ((F.length(marks) > 1) | (F.length(last) == 3))
    figures = F.translate(s, ".,", "")
    parted = F.concat(F.left(figures, F.length(figures) - F.length(last)), F.lit("."), last)
    return F.when((F.length(marks) == 0) | whole, figures).otherwise(parted).try_cast("decimal(18,6)")


_CURRENCY = "(?:" + "|".join(rules.CURRENCIES) + ")"
#: Figures with single marks between them, as one run: what of it is the price depends on where the currency stands.
_RUN = "[0-9]+(?:[., ][0-9]+)*"
_MARKED = rf"(?i){_CURRENCY}[.]? *{_RUN}|{_RUN} *{_CURRENCY}(?![a-z0-9_])"


def _plain_text(text: Column, use) -> Column:
    """use(text with plain spaces and without percentages), the text computed once however it was made."""
    spaced = F.translate(text, rules.GROUP_SPACES, " " * len(rules.GROUP_SPACES))
    without = lambda x: F.when(F.contains(x, F.lit("%")), F.regexp_replace(x, "-? *[0-9]+(?:[.,][0-9]+)? *%", " ")).otherwise(x)
    return let(spaced, lambda x: let(without(x), use))


def _run_value(run: Column, leading: Column) -> Column:
    """Bani of a run: all of it if its spaces group thousands, else the number at the end that the currency is at."""
    grouped = run.rlike("^[0-9]{1,3}(?: [0-9]{3})+(?:[.,][0-9]+)?$")
    pieces = F.split(run, " ")
    number = F.when(~F.contains(run, F.lit(" ")), run).when(grouped, F.replace(run, F.lit(" "), F.lit(""))).when(leading, pieces[0]).otherwise(F.element_at(pieces, -1))
    return to_bani(written_number(number))


def _marked(text: Column) -> Column:
    value = lambda x: let(F.regexp_extract(x, _RUN, 0), lambda run: _run_value(run, x.rlike("^[A-Za-z]")))
    found = F.transform(F.regexp_extract_all(text, F.lit(_MARKED), F.lit(0)), value)
    # most texts name no currency and need no search for figures
    return F.when(text.rlike(f"(?i){_CURRENCY}"), F.filter(found, lambda x: x.isNotNull())).when(text.isNotNull(), F.array().cast("array<bigint>"))


def extract_prices(text: Column) -> Column:
    """Bani of all amounts with a currency beside them, in order."""
    return _plain_text(text, _marked)


def parse_price(text: Column) -> Column:
    """The first amount with a currency, else the first number."""

    def either(plain: Column) -> Column:
        first = F.nullif(F.regexp_extract(plain, _RUN, 0), F.lit(""))
        return F.coalesce(F.get(_marked(plain), 0), let(first, lambda run: _run_value(run, F.lit(True))))

    return _plain_text(text, either)


def parse_price_pair(text: Column) -> Column:
    """struct(current, old): lowest and, if higher, highest amount."""

    def ends(prices: Column) -> Column:
        low, high = F.array_min(prices), F.array_max(prices)
        return F.struct(low.alias("current"), F.when(high > low, high).alias("old"))

    return let(extract_prices(text), ends)


def parse_machine_price(value: Column) -> Column:
    """Amounts of structured data, where a lone separator is a decimal one; negative or no number is null."""
    return let(F.regexp_replace(F.translate(F.trim(value), rules.GROUP_SPACES, ""), f"(?i){_CURRENCY}[.]?", ""), _machine_written)


def _machine_written(s: Column) -> Column:
    amount = F.replace(s, F.lit(","), F.lit(".")).try_cast("decimal(18,6)")
    return F.when(F.contains(s, F.lit(".")) & F.contains(s, F.lit(",")), parse_price(s)).otherwise(F.when(amount >= 0, to_bani(amount)))


def _factor(table: dict[str, tuple[str, str]], unit: Column) -> Column:
    return F.try_element_at(F.create_map(*(x for k, (_, f) in table.items() for x in (F.lit(k), F.lit(f).cast("decimal(10,3)")))), unit)


def _base(table: dict[str, tuple[str, str]], unit: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, (b, _) in table.items() for x in (k, b))), unit)


def _amount(value: Column, unit: Column) -> Column:
    """struct(value, unit) in base units; null unless positive."""
    number = (F.replace(value, F.lit(","), F.lit(".")).try_cast("decimal(14,4)") * _factor(rules.UNITS, unit)).cast("decimal(18,6)")
    return F.when(number > 0, F.struct(number.alias("value"), _base(rules.UNITS, unit).alias("unit")))


def _amounts(text: Column) -> Column:
    """Distinct amounts in a folded text."""
    values, units = (F.regexp_extract_all(text, F.lit(rules.SIZE), F.lit(k)) for k in (1, 2))
    return F.array_distinct(F.filter(F.zip_with(values, units, _amount), lambda x: x.isNotNull()))


def parse_size(title: Column) -> Column:
    """struct(value, unit, count) of the one package size that a title names; null if there is none or several."""
    return let(fold(title), _size_in)


def _size_in(text: Column) -> Column:
    def pack(pattern: str, count: int, value: int) -> tuple[Column, Column]:
        n = F.regexp_extract(text, pattern, count).try_cast("int")
        one = _amount(F.nullif(F.regexp_extract(text, pattern, value), F.lit("")), F.regexp_extract(text, pattern, value + 1))
        rest = F.array_join(F.split(text, pattern, 2), " ")
        total = F.struct((one["value"] * n).cast("decimal(18,6)").alias("value"), one["unit"].alias("unit"))
        others = F.array_except(_amounts(rest), F.array(one, total))
        size = F.when(F.size(others) == 0, F.struct(one["value"].alias("value"), one["unit"].alias("unit"), n.alias("count")))
        return one.isNotNull() & (n >= 1), size

    found = _amounts(text)
    single = F.when(F.size(found) == 1, F.struct(found[0]["value"].alias("value"), found[0]["unit"].alias("unit"), F.lit(1).alias("count")))
    before, after = pack(rules.PACK_BEFORE, 1, 2), pack(rules.PACK_AFTER, 3, 1)
    return F.when(before[0], before[1]).when(after[0], after[1]).otherwise(single)


def base_size(value: Column, unit: Column) -> Column:
    """struct(value, unit) of a stored size in base units; null for an unknown unit."""
    number = (value.cast("decimal(14,4)") * _factor(rules.STORED_UNITS, unit)).cast("decimal(18,6)")
    return F.when(number.isNotNull(), F.struct(number.alias("value"), _base(rules.STORED_UNITS, unit).alias("unit")))


def offer_size(title: Column, value: Column, unit: Column) -> Column:
    """struct(value, unit, count): the stored size, else the title's; a stored pack total is taken for one item's size."""
    return let(parse_size(title), lambda parsed: _merged(parsed, base_size(value, unit)))


def _merged(parsed: Column, stored: Column) -> Column:
    count = F.coalesce(parsed["count"], F.lit(1))
    total = (stored["value"] == parsed["value"] * count) & (stored["unit"] == parsed["unit"]) & (count > 1)
    from_title = stored.isNull() | F.coalesce(total, F.lit(False))
    return F.struct(F.when(from_title, parsed["value"]).otherwise(stored["value"]).alias("value"), F.when(from_title, parsed["unit"]).otherwise(stored["unit"]).alias("unit"), count.alias("count"))


def pct_diff(price: Column, reference: Column) -> Column:
    return round1((price - reference) * 100 / F.nullif(reference, F.lit(0)))


def drop_pct(previous: Column, price: Column) -> Column:
    return round1((previous - price) * 100 / F.nullif(previous, F.lit(0)))


def discount_pct(price: Column, old: Column) -> Column:
    """Whole per cent off the price before; null if that wasn't higher."""
    return F.when(old > price, F.bround((old - price) * 100 / old, 0).cast("bigint"))


def lei_to_bani(lei: Column) -> Column:
    return F.when(lei > 0, F.bround(lei * 100, 0).cast("bigint"))


def format_lei(bani: Column) -> Column:
    shown = F.translate(F.format_number(F.abs(bani) / F.lit(100).cast("decimal(5,0)"), 2), ",.", ".,")
    return F.when(bani.isNull(), "—").otherwise(F.concat(F.when(bani < 0, "-").otherwise(""), shown, F.lit(" lei")))


def format_pct(pct: Column) -> Column:
    return F.when(pct.isNull(), "—").otherwise(F.concat(F.when(pct >= 0, "+").otherwise("-"), F.replace(F.call_function("format_number", F.abs(pct), F.lit("0.0")), F.lit("."), F.lit(",")), F.lit("%")))


def format_size(value: Column, unit: Column) -> Column:
    """"40 ml", "1,5 l"; empty if either is missing."""
    text = F.regexp_replace(F.regexp_replace(value.cast("decimal(18,6)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(value.isNull() | (F.coalesce(unit, F.lit("")) == ""), "").otherwise(F.replace(F.concat_ws(" ", text, unit), F.lit("."), F.lit(",")))


def plural(count: Column, one: str, many: str) -> Column:
    """Count and noun as Romanian has them: from 20 on (by the last two figures) with "de"."""
    bare = (count == 0) | ((count % 100 > 0) & (count % 100 < 20))
    return F.when(count == 1, F.lit(f"1 {one}")).when(bare, F.concat_ws(" ", count, F.lit(many))).otherwise(F.concat_ws(" ", count, F.lit("de"), F.lit(many)))


def market_position(pct: Column, in_stock: Column) -> Column:
    return F.when(~in_stock, "Stoc epuizat").when(pct.isNull(), "—").when(pct < -rules.MARKET_BAND, "Sub piață").when(pct > rules.MARKET_BAND, "Peste piață").otherwise("La nivelul pieței")


def heat(pct: Column) -> Column:
    """How strongly a cell is coloured: 0 in the band around the market, then 0.12 to 0.45."""
    strength = 0.12 + 0.33 * F.least(F.abs(pct), F.lit(rules.MARKET_SATURATION)) / rules.MARKET_SATURATION
    return F.when(pct.isNull() | F.isnan(pct) | (F.abs(pct) <= rules.MARKET_BAND), 0.0).otherwise(F.round(strength, 4))


def gtin(value: Column) -> Column:
    """A GTIN's digits if its check digit is right, else null."""
    code = F.replace(F.regexp_replace(value, r"(?U)\s+", ""), F.lit("-"), F.lit(""))
    digits = F.reverse(F.split(code, ""))
    weighed = F.aggregate(F.transform(digits, lambda d, i: d.try_cast("int") * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    # the check digit (weight 1) makes the sum a multiple of ten
    return F.when(code.rlike("^[0-9]+$") & F.length(code).isin(rules.GTIN_LENGTHS) & (weighed % 10 == 0), code)
