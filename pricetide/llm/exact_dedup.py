"""Exact dedup over an extendible-hash index in shared files. DataFrame operations only.

Texts are equal when they are identical after lower-casing A-Z. A key is the 64-bit hash
of such a text; a bucket owns the keys with one prefix, a range of keys. The directory
doubles (its prefixes get one more bit) until no prefix has more than CAPACITY distinct
keys; neighbours that fit together are one bucket, so only what is overfull is split. A key that
many rows have can't be split by more bits: where it has more rows than one in HOT of all
(and than PAGE), its rows are chained over as many pages as that takes. There are at most HOT
such keys, and only they are broadcast.

Every row and text goes to the task that owns its prefix and page. There the texts of a
key are compared byte by byte (they are grouping keys), so texts that only share a hash
stay apart as links of a chain. What the tasks found is the index: written to shared
files, pages of one text are put together again, and each row looks up its entry by bucket,
page, key and SHA-256.

Of equal texts the row with the largest doc_id stays. Null texts count as empty; rows
with one doc_id and one text both stay in the report, and one of them in the filter; a row
without doc_id stays only if all of its group are without. An empty table gives no rows.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RAW, chosen, staged, whole_texts

CAPACITY, HOT, PAGE = 2048, 100_000, 256


def normalised(text: Column) -> Column:
    """A-Z in small letters and nothing else; `lower` does that for texts of one byte a character, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _keyed(docs: DataFrame) -> DataFrame:
    return whole_texts(docs).select("doc_id", normalised(F.col("text")).alias("text")).withColumn("key", F.xxhash64("text"))


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits).alias("prefix")


def directory(keys: DataFrame) -> tuple[DataFrame, int]:
    """(prefix, bucket) after all splits, for each prefix that occurs, and the bits of a prefix; keys: distinct keys."""
    bits = max(1, (keys.count() // CAPACITY).bit_length() + 1)
    while True:
        counts = staged(keys.groupBy(_prefix(bits)).agg(F.count("*").alias("n")))
        if bits > 60 or (counts.agg(F.max("n")).first()[0] or 0) <= CAPACITY:
            break
        bits += 1
    levels = counts.select("prefix", "n", F.explode(F.sequence(F.lit(max(0, bits - 6)), F.lit(bits))).alias("bits")).withColumn("bucket", F.expr(f"shiftrightunsigned(prefix, {bits} - bits)"))
    fits = levels.groupBy("bits", "bucket").agg(F.sum("n").alias("size")).where(F.col("size") <= CAPACITY)
    leaf = levels.join(fits, ["bits", "bucket"]).groupBy("prefix").agg(F.min(F.struct("bits", "bucket")).alias("leaf"))
    return staged(leaf.select("prefix", F.expr("concat(leaf.bits, ':', hex(leaf.bucket))").alias("bucket"))), bits


def index(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index (bucket, page, key, text_sha256, link, keep_id, group_size) in shared files, and `rows` with bucket and page."""
    keys = staged(rows.groupBy("key").agg(F.count("*").alias("n")))
    most = max(PAGE, (keys.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.broadcast(staged(keys.where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("pages"))))
    buckets, bits = directory(keys.select("key"))
    entries = _keyed(docs).join(hot, "key", "left").select(_prefix(bits), _page(), "key", "text", "doc_id", "pages")
    owned = entries.repartition("prefix", "page").groupBy("prefix", "page", "key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"), F.max("pages").alias("pages"))
    pages = staged(owned.select("prefix", "page", "key", F.sha2("text", 256).alias("text_sha256"), F.when(F.col("pages") > 1, F.col("text")).alias("chained"), "keep_id", "n"))
    text = Window.partitionBy("bucket", "key", "text_sha256", "chained")
    chain = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    found = pages.join(buckets, "prefix").select("bucket", "page", "key", "text_sha256", F.dense_rank().over(chain).alias("link"), F.max("keep_id").over(text).alias("keep_id"), F.sum("n").over(text).alias("group_size"))
    asked = rows.join(hot, "key", "left").withColumns({"prefix": _prefix(bits), "page": _page()}).join(buckets, "prefix").drop("prefix", "pages")
    return staged(found), asked


def _page() -> Column:
    return F.when(F.col("pages").isNull(), 0).otherwise(F.expr("cast(pmod(xxhash64(doc_id), pages) as int)")).alias("page")


_ENTRY = ["bucket", "page", "key", "text_sha256"]


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that stay: one of each group of equal texts."""
    rows = staged(whole_texts(docs).withColumn("raw", F.expr(RAW)).select("doc_id", "raw", normalised(F.col("text")).alias("text")).select("doc_id", "raw", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("text_sha256")))
    found, asked = index(docs, rows)
    kept = asked.join(found, _ENTRY).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return chosen(docs, kept.groupBy("doc_id", "key", "text_sha256").agg(F.min("raw").alias("raw")), once=True)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, link (its text's place among texts with the same key)."""
    rows = staged(_keyed(docs).select("doc_id", "key", F.sha2("text", 256).alias("text_sha256")))
    found, asked = index(docs, rows)
    return asked.join(found, _ENTRY).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.col("link").cast("long").alias("link"))


ORACLE = f"""
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id is not distinct from max(doc_id) over same as kept, sha256(t) as text_sha256, cast(1 as bigint) as link
from (select doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as t from documents)
window same as (partition by t)
"""
