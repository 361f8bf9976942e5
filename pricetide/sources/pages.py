"""Product pages: structured data blocks and page events to observations.

A dialect is a function (html, url) -> rows; `dialect` registers one by name, and
`observations` runs one over a table of pages, partition by partition.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import rules

Row = dict
DIALECTS: dict[str, Callable[[str, str], list[Row]]] = {}
SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("brand", pa.string()), ("price_bani", pa.int64()), ("old_price_bani", pa.int64()), ("currency", pa.string()), ("in_stock", pa.bool_()), ("ean", pa.string()), ("image_url", pa.string()), ("seller_name", pa.string())])


def dialect(name: str):
    def register(parse: Callable[[str, str], list[Row]]):
        if DIALECTS.setdefault(name, parse) is not parse:
            raise ValueError(f"dialect {name} is there already")
        return parse

    return register


class _Page(HTMLParser):
    """Script blocks by type, the first heading, links and elements with an id."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.scripts: list[tuple[str, str]] = []
        self.heading, self.links, self.by_id = None, [], {}
        self._type = self._text = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if found.get("id"):
            self.by_id.setdefault(found["id"], found)
        if tag == "a" and found.get("href"):
            self.links.append(found["href"])
        if tag == "script":
            self._type, self._text = (found.get("type") or "").strip().lower(), []
        elif tag == "h1" and self.heading is None:
            self.heading, self._type, self._text = "", "h1", []

    def handle_data(self, data):
        if self._text is not None:
            self._text.append(data)

    def handle_endtag(self, tag):
        if self._text is not None and tag in ("script", "h1"):
            text = "".join(self._text)
            if tag == "h1" and self._type == "h1":
                self.heading = " ".join(text.split())
            elif tag == "script":
                self.scripts.append((self._type, text))
            self._type = self._text = None


#: A quotation mark that closes a string is followed by one of these, or by the end.
_CLOSES = re.compile(r"\s*(?:[,:}\]]|$)")


def lenient_json(text: str):
    """JSON that may have line ends and unescaped quotation marks inside strings; None if it can't be read."""
    for candidate in (lambda: text, lambda: _escaped(text)):
        try:
            return json.loads(candidate(), strict=False)
        except json.JSONDecodeError:
            pass
    return None


def _escaped(text: str) -> str:
    """One walk over the text: a mark inside a string that nothing follows which could follow a string is part of it."""
    out, inside, at = [], False, 0
    for m in re.finditer(r'\\.|"', text, re.DOTALL):
        if m[0] != '"':
            continue
        if not inside:
            inside = True
        elif _CLOSES.match(text, m.end()):
            inside = False
        else:
            out += (text[at : m.start()], '\\"')
            at = m.end()
    return "".join([*out, text[at:]])


def _objects(data) -> Iterator[dict]:
    for x in data if isinstance(data, list) else [data]:
        if isinstance(x, list):
            yield from _objects(x)
        elif isinstance(x, dict):
            yield from _objects(x["@graph"]) if "@graph" in x else [x]


def _many(value) -> list:
    return value if isinstance(value, list) else [value]


def _text(value) -> str | None:
    """The first usable text of a value, a list or an object."""
    if isinstance(value, dict):
        return next((_text(value[k]) for k in ("name", "@value", "url", "contentUrl") if k in value), None)
    if isinstance(value, list):
        return next((t for t in map(_text, value) if t), None)
    if isinstance(value, bool) or not isinstance(value, str | int | float):
        return None
    return str(value).strip() or None


def _last_part(value) -> str:
    return (_text(value) or "").rsplit("/", 1)[-1].lower()


def _kinds(obj: dict) -> set[str]:
    return {str(x).rsplit("/", 1)[-1].rsplit(":", 1)[-1].lower() for x in _many(obj.get("@type", []))}


def gtin(value) -> str | None:
    code = "".join(str(value if value is not None else "").split()).replace("-", "")
    if not (code.isascii() and code.isdigit() and len(code) in rules.GTIN_LENGTHS):
        return None
    return code if sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(reversed(code))) % 10 == 0 else None


def _gtin(obj: dict) -> str | None:
    return next((g for k in rules.GTIN_KEYS if (g := gtin(_text(obj.get(k))))), None)


def bani(value) -> int | None:
    """Machine-written amounts: a lone separator is the decimal one, of two the last."""
    from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

    if value is None or isinstance(value, bool) or not isinstance(value, str | int | float):
        return None
    s = "".join(c for c in str(value).strip().lower() if c not in rules.GROUP_SPACES)
    for word in ("lei", "leu", "ron"):
        s = s.replace(f"{word}.", "").replace(word, "")
    if "." in s and "," in s:
        group, point = (",", ".") if s.rfind(".") > s.rfind(",") else (".", ",")
        s = s.replace(group, "").replace(point, ".")
    try:
        amount = Decimal(s.replace(",", "."))
    except InvalidOperation:
        return None
    return int((amount * 100).quantize(Decimal(1), ROUND_HALF_UP)) if amount.is_finite() and amount >= 0 else None


def _offer(obj: dict, currency: str | None = None) -> Row | None:
    specs = [s for s in _many(obj.get("priceSpecification")) if isinstance(s, dict)]
    former = [s for s in specs if _last_part(s.get("priceType")) in rules.OLD_PRICE_TYPES]
    present = [s for s in specs if s not in former]
    price = next((p for p in (bani(obj.get("price")), bani(obj.get("lowPrice")), *(bani(s.get("price")) for s in present[:1])) if p is not None), None)
    if price is None:
        return None
    old = bani(former[0].get("price")) if former else None
    stated = _text(obj.get("priceCurrency")) or next((t for s in specs if (t := _text(s.get("priceCurrency")))), None)
    state = _last_part(obj.get("availability"))
    return {
        "price_bani": price, "old_price_bani": old if old is not None and old > price else None, "currency": (stated or currency or "RON").upper(),
        "in_stock": True if state in rules.IN_STOCK else False if state in rules.OUT_OF_STOCK else None, "url": _text(obj.get("url")), "sku": _text(obj.get("sku")), "gtin": _gtin(obj),
        "seller": _text(obj.get("seller")), "name": _text(obj.get("name")), "image": _text(obj.get("image")),
    }


def _offers(value) -> list[Row]:
    out = []
    for x in _many(value):
        if isinstance(x, dict):
            nested = x.get("offers") if "aggregateoffer" in _kinds(x) else None
            out += [_offer(o, _text(x.get("priceCurrency"))) for o in _many(nested) if isinstance(o, dict)] if nested else [_offer(x)]
    return [o for o in out if o]


def products(page: _Page) -> list[Row]:
    """Products with their offers; each variant of a group is one, with what it lacks from the group."""
    out = []
    for kind, text in page.scripts:
        if kind != "application/ld+json":
            continue
        for obj in _objects(lenient_json(text)):
            kinds = _kinds(obj)
            if "productgroup" in kinds:
                pairs = [(v, obj) for v in _many(obj.get("hasVariant") or []) if isinstance(v, dict)]
            else:
                pairs = [(obj, {})] if "product" in kinds else []
            for own, group in pairs:
                get = lambda k, own=own, group=group: _text(own.get(k)) or _text(group.get(k))
                if get("name"):
                    out.append({"name": get("name"), "brand": get("brand"), "url": get("url"), "image": get("image"), "sku": _text(own.get("sku")), "gtin": _gtin(own), "offers": _offers(own.get("offers"))})
    return out


@dialect("jsonld")
def from_jsonld(html: str, url: str) -> list[Row]:
    """A row for each product's offers in RON. Offers at one address are told apart by article number; without one the first counts."""
    seen, out = set(), []
    for p in products(_Page(html)):
        for o in p["offers"]:
            if o["currency"] != "RON":
                continue
            at = urljoin(url, o["url"] or p["url"] or url)
            if at in seen:
                article = o["sku"] or p["sku"]
                at = f"{at.split('#', 1)[0]}#sku={article}"
                if not article or at in seen:
                    continue
            seen.add(at)
            image = o["image"] or p["image"]
            out.append({
                "url": at, "title": o["name"] or p["name"], "brand": p["brand"], "price_bani": o["price_bani"], "old_price_bani": o["old_price_bani"], "currency": "RON",
                "in_stock": o["in_stock"] is not False, "ean": o["gtin"] or (p["gtin"] if len(p["offers"]) == 1 else None), "image_url": urljoin(url, image) if image else None, "seller_name": o["seller"],
            })
    return out


#: --- fixed value: where the page event of a shop system is kept ---
EVENTS_KEY = "Evx_DataReshape/js/events"


@dialect("page_event")
def from_page_event(html: str, url: str) -> list[Row]:
    """The product of a page's `product_viewed` event; the price box on the page wins over the event's price."""
    page = _Page(html)
    product = next((e["products"][0] for k, t in page.scripts if k == "text/x-magento-init" and EVENTS_KEY in t for e in _events(t) if _viewed(e)), None)
    if not isinstance(product, dict):
        return []
    box = lambda name: bani(page.by_id.get(f"{name}-{product.get('id') or ''}", {}).get("data-price-amount"))
    first = lambda *found: next((x for x in found if x is not None), None)
    price, old = first(box("product-price"), bani(product.get("price"))), first(box("old-price"), bani(product.get("price_base")))
    title = str(product.get("name") or "").strip() or page.heading
    if price is None or not title:
        return []
    entity = next((d["mainEntity"] for k, t in page.scripts if k == "application/ld+json" and isinstance(d := lenient_json(t), dict) and isinstance(d.get("mainEntity"), dict) and d["mainEntity"].get("@type") == "Product"), {})
    join = lambda x: urljoin(url, x) if isinstance(x, str) and x else None
    return [{
        "url": join(product.get("url")) or url, "title": title, "brand": str(product.get("brand") or "").strip() or None, "price_bani": price, "old_price_bani": old if old is not None and old > price else None,
        "currency": str(product.get("currency") or "RON"), "in_stock": product.get("stock_status") in (True, 1, "1", "true", "in_stock"), "ean": gtin(entity.get("gtin13")) or gtin(entity.get("mpn")), "image_url": join(product.get("image")), "seller_name": None,
    }]


def _events(text: str) -> list:
    try:
        found = json.loads(text)["*"][EVENTS_KEY]["events"]
    except (ValueError, KeyError, TypeError):
        return []
    return found if isinstance(found, list) else []


def _viewed(event) -> bool:
    info = event.get("event") if isinstance(event, dict) else None
    return isinstance(info, dict) and info.get("name") == "product_viewed" and isinstance(event.get("products"), list) and bool(event["products"])


def observations(pages: DataFrame, name: str = "jsonld") -> DataFrame:
    """pages: page_id, url, html -> a row for each offer found."""
    parse = DIALECTS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"page_id": i, **r} for i, u, h in zip(*(c.to_pylist() for c in batch.columns)) for r in parse(h or "", u or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return pages.select("page_id", "url", "html").mapInArrow(run, from_arrow_schema(SCHEMA))


def completed(found: DataFrame, markup: DataFrame) -> DataFrame:
    """Observations with what the page's markup says better: a longer heading, a missing brand or picture. markup: page_id, heading, maker, picture."""
    longer = F.startswith("heading", "title") & (F.length("heading") > F.length("title"))
    out = found.join(markup, "page_id", "left")
    return out.withColumns({"title": F.when(longer, F.col("heading")).otherwise(F.col("title")), "brand": F.coalesce("brand", "maker"), "image_url": F.coalesce("image_url", "picture")}).drop("heading", "maker", "picture")


def page_links(pages: DataFrame) -> DataFrame:
    """(url, link): links of pages, absolute, in the JVM."""
    base = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    href = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"')))
    return pages.select("url", base.alias("_base"), href.alias("_href")).select("url", F.when(F.col("_href").rlike("^https?://"), F.col("_href")).when(F.startswith("_href", F.lit("/")), F.concat("_base", "_href")).alias("link")).where("link is not null")


def has_https(c: Column) -> Column:
    """An address that may be shown: http or https."""
    return c.rlike("(?i)^https?://")
