"""What a polite reader of shops decides: addresses, robots rules, sitemaps, listings, refusals."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import rules


def page_key(url: Column) -> Column:
    """A page whatever its query, fragment and final slash; the host in small letters."""
    bare = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")
    host = F.regexp_extract(bare, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1)
    return F.concat(F.lower(host), F.substring(bare, F.length(host) + 1, F.length(bare)))


def last_segment(url: Column) -> Column:
    return F.regexp_extract(page_key(url), "([^/]+)$", 1)


def sku_url(url: Column, sku: Column) -> Column:
    return F.concat(F.split(url, "#")[0], F.lit("#sku="), sku)


def url_matches(url: Column, hosts: list[str], path: str) -> Column:
    """Is it a page of one of the hosts, at a path of that form?"""
    return F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(hosts) & F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")).rlike(path)


def wanted_brand(slug: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.lit(not wanted) | F.array_contains(F.transform(F.array(*map(F.lit, wanted or [""])), lambda w: F.contains(F.regexp_replace(F.lower(slug), "[^a-z0-9]", ""), w)), True), F.lit(True))


def retry_after(value: Column, as_of: Column) -> Column:
    """Seconds to wait: a number, or how long until an HTTP date; never negative, null if it is neither."""
    when = F.try_to_timestamp(F.regexp_replace(F.trim(value), r"^[A-Za-z]+,\s*| GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(F.trim(value).rlike("^[0-9]+$"), F.trim(value).try_cast("double")).when(when.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(when) - F.unix_micros(as_of)) / 1e6))


def is_challenge(status: Column, mitigated: Column, body: Column) -> Column:
    """Does a reply ask whether a person is there?"""
    start = F.lower(F.substring(body, 1, 5000))
    marks = [F.contains(start, F.lit(m)) for m in rules.CHALLENGE_MARKS]
    said = F.coalesce(F.lower(mitigated) == "challenge", F.lit(False))
    return said | (status.isin(rules.CHALLENGE_STATUS) & F.coalesce(marks[0] | marks[1] | marks[2] | marks[3], F.lit(False)))


# --- robots.txt -------------------------------------------------------------------------

RULES = pa.schema([("host", pa.string()), ("agent", pa.string()), ("allow", pa.bool_()), ("length", pa.int32()), ("pattern", pa.string()), ("delay", pa.float64())])


def robots_rules(files: DataFrame) -> DataFrame:
    """files: host, text -> a row for each agent and rule; rows with null `allow` only name an agent or its delay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"host": h, **r} for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in _rules(t or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=RULES)

    return files.select("host", "text").mapInArrow(run, from_arrow_schema(RULES))


def _rules(text: str) -> list[dict]:
    out, agents, body = [], [], False
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon or key == "sitemap":
            continue
        if key == "user-agent":
            agents, body = ([] if body else agents) + [value.lower()], False
            out.append({"agent": value.lower()})
        elif agents and key in ("allow", "disallow"):
            body = True
            out += [{"agent": a, "allow": key == "allow", "length": len(value), "pattern": _regex(value)} for a in agents if value]
        elif agents and key == "crawl-delay":
            body = True
            number = value.replace(".", "", 1)
            out += [{"agent": a, "delay": float(value)} for a in agents if number.isdigit()]
    return out


def _regex(pattern: str) -> str:
    end = pattern.endswith("$")
    parts = unquote(pattern[: len(pattern) - end]).split("*")
    quoted = ["".join(c if c.isalnum() or c in "_/" or not c.isascii() else f"\\{c}" for c in p) for p in parts]
    return f"(?s)^{'.*'.join(quoted)}{'$' if end else ''}"


def _applying(found: DataFrame, agent: str) -> DataFrame:
    """Rules of the groups that name the agent, else of those for all, by host."""
    token = agent.strip().split("/")[0].split()[0].lower()
    named = F.max((F.col("agent") == token).cast("int")).over(Window.partitionBy("host"))
    return found.withColumn("_named", named).where((F.col("agent") == token) | ((F.col("_named") == 0) & (F.col("agent") == "*"))).drop("_named")


def allowed(urls: DataFrame, found: DataFrame, agent: str) -> DataFrame:
    """urls: url -> with `allowed`: the longest rule that fits decides, of equally long ones the one that allows."""
    path = F.coalesce(F.nullif(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.try_parse_url(F.col("url"), F.lit("QUERY"))
    place = F.try_url_decode(F.replace(F.concat(path, F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise("")), F.lit("+"), F.lit("%2B")))
    rows = urls.select("url").distinct().withColumns({"host": F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))), "_path": place})
    rule = _applying(found, agent).where("allow is not null").select("host", "allow", "length", "pattern").distinct()
    fits = rows.join(rule, "host").where((F.col("_path") != "/robots.txt") & F.expr("_path rlike pattern"))
    verdict = fits.groupBy("url").agg(F.max_by("allow", F.struct("length", "allow")).alias("_verdict"))
    return rows.join(verdict, "url", "left").select("url", F.coalesce("_verdict", F.lit(True)).alias("allowed"))


def crawl_delay(found: DataFrame, agent: str) -> DataFrame:
    return _applying(found, agent).groupBy("host").agg(F.max("delay").alias("delay"))


# --- sitemaps and listings --------------------------------------------------------------

LARGEST_SITEMAP = 50 * 1024 * 1024
EDGES = pa.schema([("sitemap", pa.string()), ("loc", pa.string()), ("is_sitemap", pa.bool_())])


def sitemap_edges(files: DataFrame) -> DataFrame:
    """files: url, content (binary, plain or gzip) -> the addresses each names; unreadable ones name none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"sitemap": u, "loc": x, "is_sitemap": s} for u, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x, s in _locations(c or b"")]
            yield pa.RecordBatch.from_pylist(rows, schema=EDGES)

    return files.select("url", "content").mapInArrow(run, from_arrow_schema(EDGES))


def _locations(content: bytes) -> list[tuple[str, bool]]:
    try:
        if content[:2] == b"\x1f\x8b":
            import io

            content = gzip.GzipFile(fileobj=io.BytesIO(content)).read(LARGEST_SITEMAP + 1)
        if len(content) > LARGEST_SITEMAP or b"<!ENTITY" in content:  # no entities from outside
            return []
        root = ElementTree.fromstring(content)
    except (OSError, EOFError, ElementTree.ParseError):
        return []
    name = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    child = {"sitemapindex": "sitemap", "urlset": "url"}.get(name(root))
    return [(loc.text.strip(), child == "sitemap") for e in root.iter() if child and name(e) == child for loc in e if name(loc) == "loc" and (loc.text or "").strip()]


def sitemap_pages(edges: DataFrame, roots: DataFrame, depth: int = rules.SITEMAP_DEPTH) -> DataFrame:
    """Addresses that sitemaps name, from the roots (url) down to `depth` levels, each once."""
    level, pages = roots.select(F.col("url").alias("sitemap")).distinct(), None
    known = level
    for _ in range(depth + 1):
        named = edges.join(level, "sitemap")
        found = named.where("not is_sitemap").select(F.col("loc").alias("url"))
        pages = found if pages is None else pages.unionByName(found)
        level = named.where("is_sitemap").select(F.col("loc").alias("sitemap")).distinct().join(known, "sitemap", "left_anti")
        known = known.unionByName(level)
    return pages.distinct()


def reachable(links: DataFrame, seeds: DataFrame, is_listing, is_product, cap: int = rules.LISTING_PAGES) -> DataFrame:
    """(url, level): product pages that listings link to, breadth first from the seeds (url), however deep; at most `cap` listings are read.

    links: url, link. The cap is a politeness limit of the crawl: listings nearest to the seeds, then by address.
    What is read, `cap` addresses at most, is held on the driver, so that no plan grows with the depth.
    """
    spark = links.sparkSession
    local = lambda rows: spark.createDataFrame(rows, "url string, level int")
    links = links.select("url", "link").distinct()
    onward = links.where(is_listing(F.col("link")) & ~is_product(F.col("link"))).persist()
    front = [r.url for r in seeds.select("url").distinct().orderBy("url").limit(cap).collect()]
    read = dict.fromkeys(front, 0)
    level = 0
    while front and len(read) < cap:
        level += 1
        new = onward.join(F.broadcast(local([(u, 0) for u in front])), "url").select(F.col("link").alias("url")).distinct()
        new = new.join(F.broadcast(local([(u, n) for u, n in read.items()])), "url", "left_anti")
        front = [r.url for r in new.orderBy("url").limit(cap - len(read)).collect()]
        read.update(dict.fromkeys(front, level))
    onward.unpersist()
    found = links.where(is_product(F.col("link"))).join(F.broadcast(local([*read.items()])), "url")
    return found.groupBy(F.col("link").alias("url")).agg((F.min("level") + 1).alias("level"))
