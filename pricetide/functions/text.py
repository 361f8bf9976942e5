"""Keys and names from listing texts, as column expressions that stay in the JVM.

`fold` covers Latin letters by a translation table made from Unicode's decompositions;
`fold_exact` covers all of Unicode by an Arrow function, for text outside that alphabet.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import rules

APOSTROPHES = "’‘`´"


def folded(text: str) -> str:
    """What `fold` does, for constants on the driver and for `fold_exact`."""
    text = unicodedata.normalize("NFKD", text.translate(dict.fromkeys(map(ord, APOSTROPHES), "'")))
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).casefold().split())


@lru_cache(1)
def _alphabet() -> tuple[str, str, dict[str, str]]:
    """Latin letters that fold to one character, to what, and those that fold to several."""
    one, to, several = "", "", {}
    for k in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2100, 0x2140), *range(0xFB00, 0xFB07)):
        c, f = chr(k), folded(chr(k))
        if c.isspace() or f == c or c in APOSTROPHES:
            continue
        if len(f) == 1:
            one, to = one + c, to + f
        elif len(f) > 1:
            several[c] = f
    return one, to, several


def let(value: Column, use) -> Column:
    """use(value), with `value` computed once however often it is used, which also keeps plans small."""
    return F.get(F.transform(F.array(value), use), 0)


def fold(c: Column) -> Column:
    """Key without case, accents, kinds of apostrophe and runs of white space."""
    one, to, several = _alphabet()
    text = F.translate(F.lower(c), APOSTROPHES + one, "'" * len(APOSTROPHES) + to)
    letters = [k for k, v in several.items() if k.isalpha() or v.isalpha() and len(v) < 4]
    text = reduce(lambda x, k: F.replace(x, F.lit(k), F.lit(several[k])), [k for k in letters if k in "ßŉſt™ﬁﬂﬀĳǆǉǌǳ"], text)
    return collapsed(F.regexp_replace(text, r"\p{M}+", ""))


@F.pandas_udf(StringType())
def fold_exact(c: pd.Series) -> pd.Series:
    return c.map(folded, na_action="ignore")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, "[®™©]", "")


def brand_key(c: Column) -> Column:
    """Folded letters and digits; trademark signs and apostrophes go, other signs part words."""
    return F.trim(F.regexp_replace(F.replace(fold(_plain(c)), F.lit("'"), F.lit("")), "[^0-9a-z]+", " "))


def key_of(text: str) -> str:
    """`brand_key` of a constant."""
    bare = folded("".join(c for c in text if c not in "®™©")).replace("'", "")
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in bare).split())


@lru_cache(1)
def aliases() -> dict[str, str]:
    """Key of each spelling to the display name; a spelling of two brands is an error."""
    out: dict[str, str] = {}
    for name, more in rules.BRANDS.items():
        for spelling in (name, *more):
            if out.setdefault(key_of(spelling), name) != name:
                raise ValueError(f"{spelling!r} is a spelling of {out[key_of(spelling)]!r} and {name!r}")
    return out


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def canonical_brand(c: Column) -> Column:
    """Display name of a known brand; others as they are but for white space and signs; empty is null."""
    return let(F.nullif(collapsed(_plain(c)), F.lit("")), lambda cleaned: F.coalesce(F.try_element_at(_lookup(aliases()), brand_key(cleaned)), cleaned))


def is_known_brand(c: Column) -> Column:
    return F.map_contains_key(_lookup(aliases()), brand_key(c))


def brand_token(c: Column) -> Column:
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def _spelled(phrase: str) -> str:
    """A pattern for a phrase however its letters are accented; words may be hyphenated or run together."""
    letters = (f"[{rules.ACCENTS[c]}]" if c in rules.ACCENTS else c for c in phrase)
    return "".join(letters).replace(" ", r"(?:-|\s*)")


def _any_of(phrases: list[str]) -> str:
    return "(?:" + "|".join(_spelled(p) for p in sorted(phrases, key=len, reverse=True)) + ")"


@lru_cache(1)
def _noise() -> list[str]:
    """What is taken out of titles, one after another: gifts to the end, brackets that only advertise, discounts, slogans, empty brackets."""
    percentage = r"[0-9]+(?:[.,][0-9]+)?\s*%"
    slogan = _any_of(rules.PROMO_PHRASES) + "!*"
    inside = r"[^)\]]*"
    alone = r"(?<![\w-]){}(?![\w-])"
    gift = rf"(?:[+]|\s-|\bcu\b)\s*(?:un\s+)?{_any_of(rules.GIFTS)}\b{inside}"
    advert = "|".join((rf"{inside}\b{_any_of(rules.BRACKETED_GIFTS)}\b{inside}", slogan, _any_of(rules.SHOUTED) + "!*", rf"-\s*{percentage}"))
    lead = rf"\b{_any_of(rules.DISCOUNTS)}\b\s*:?\s*-?"
    return [gift, rf"[(\[]\s*(?:{advert})\s*[)\]]", rf"(?:{lead}|(?<![\w%])-)\s*{percentage}", alone.format(slogan), rf"(?<![\w-]){_any_of(rules.SHOUTED)}!+", r"[(\[]\s*[)\]]"]


def clean_title(c: Column) -> Column:
    """A title without discounts, offers and gifts; applying it again changes nothing."""
    text = collapsed(reduce(lambda x, p: F.regexp_replace(x, f"(?iuU){p}", " "), _noise(), c))
    # what is left over at either end: separators, and a plus sign that nothing follows
    bare = F.btrim(text, F.lit(" -|,:;/"))
    return F.regexp_replace(bare, r"(?:[ |,:;/-]+[+]*)*[ |,:;/-][+]+$", "")


def strip_sizes(c: Column) -> Column:
    return collapsed(reduce(lambda x, p: F.regexp_replace(x, f"(?i){p}", " "), (rules.PACK_BEFORE, rules.PACK_AFTER, rules.SIZE), c))


def _spellings(brand: Column) -> Column:
    """Keys under which a brand may stand in a title, those of most words first."""
    known: dict[str, list[str]] = {}
    for name, more in rules.BRANDS.items():
        known[key_of(name)] = [key_of(x) for x in (name, *more)]
    table = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    listed = F.coalesce(F.try_element_at(table, brand_key(canonical_brand(brand))), F.array().cast("array<string>"))
    every = F.filter(F.array_distinct(F.concat(F.array(brand_key(brand)), listed)), lambda x: x != "")
    by_length = F.reverse(F.array_sort(F.transform(every, lambda x: F.struct(F.size(F.split(x, " ")).alias("n"), x.alias("key")))))
    return F.coalesce(F.transform(by_length, lambda x: x["key"]), F.array().cast("array<string>"))


def name_tokens(title: Column, brand: Column) -> Column:
    """The words that tell a product from others: no noise, size, brand or filler; a plus sign on a word is the word plus."""
    text = strip_sizes(fold(clean_title(title)))
    text = F.regexp_replace(text, r"(?<=[0-9a-z])\+(?![0-9a-z])|\(\s*\+\s*\)", " plus ")
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.replace(text, F.lit("'"), F.lit("")), F.lit("([0-9a-z]+)")), " "), F.lit(" "))

    def without(words: Column, found: Column) -> Column:
        at = F.instr(words, found)
        return F.concat(F.substring(words, F.lit(1), at), F.substring(words, at + F.length(found), F.length(words)))

    def dropped(words: Column) -> Column:
        padded = F.transform(_spellings(brand), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
        return let(F.get(F.filter(padded, lambda x: F.contains(words, x)), 0), lambda found: F.when(found.isNotNull(), without(words, found)).otherwise(words))

    return F.filter(F.split(F.trim(let(words, dropped)), " "), lambda x: (x != "") & ~x.isin(rules.STOPWORDS))


def display_name(title: Column, brand: Column) -> Column:
    """A title without noise, the brand in front (of up to six words) and sizes; the cleaned title if nothing is left."""

    def named(cleaned: Column) -> Column:
        return let(F.split(cleaned, " "), lambda words: F.coalesce(F.nullif(F.btrim(strip_sizes(after_brand(words)), F.lit(" ,-|")), F.lit("")), cleaned))

    def after_brand(words: Column) -> Column:
        most = F.least(F.size(words) - 1, F.lit(6))
        leads = let(_spellings(brand), lambda known: F.when(most >= 1, F.filter(F.sequence(most, F.lit(1), F.lit(-1)), lambda n: F.array_contains(known, brand_key(F.array_join(F.slice(words, 1, n), " "))))))
        return let(F.coalesce(F.get(leads, 0), F.lit(0)), lambda drop: F.array_join(F.slice(words, drop + 1, F.greatest(F.size(words) - drop, F.lit(1))), " "))

    return let(clean_title(title), named)


def distinctive(token: Column) -> Column:
    return token.rlike("[0-9]") | (token == "plus") | (F.length(token) <= 2)


def search_words(text: str) -> list[str]:
    """Distinct words of a query in order, for the driver."""
    bare = folded(text).replace("'", "")
    return list(dict.fromkeys("".join(c if c.isascii() and c.isalnum() else " " for c in bare).split()))


def search_words_of(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.replace(fold(c), F.lit("'"), F.lit("")), F.lit("([0-9a-z]+)")))


def categorize(name: Column) -> Column:
    """The first category one of whose words is in the name."""
    (first, pattern), *rest = rules.CATEGORY_PATTERNS

    def chosen(text: Column) -> Column:
        return reduce(lambda x, r: x.when(text.rlike(r[1]), r[0]), rest, F.when(text.rlike(pattern), first)).otherwise(rules.OTHER)

    return let(fold(name), chosen)
