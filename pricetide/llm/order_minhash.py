"""Near-duplicates by order MinHash, verified by banded alignment.

A text is the sequence of its words (letters and digits, in small letters). Two texts are
similar if aligning their words gives SIMILAR or more: with m words matched in order of n
and k, similarity = m / (n + k - m). If five-word shingles aligned in order reach SIMILAR, the
words do too; one changed word breaks five shingles but counts once.

Candidates come from sketches of five-word shingles (a shorter text is one shingle). A sketch
orders the shingles, each labelled with how often it occurred before, by a seeded hash, takes
the lowest few and writes them down in the order of the text: two texts agree in it with a
probability that falls with their edit distance, as moved passages change the order. KINDS
lists how many shingles a sketch takes for texts of which length, and how many sketches there
are; lengths overlap by more than two similar texts can differ. A pair that shares a share J
of its shingles is found by one sketch of t with probability J^t or so, and missed by all with
(1 - J^t)^sketches: for long texts at J = 0.7 4 in a million, at 0.6 2 in 10,000, at 0.5 8 in 1,000,
at 0.4 9 in 100 (changed words spread evenly give J = 0.4 at a similarity of 0.8, 0.5 at 0.86, 0.6 at
0.9); for those of 14 to 47 words 4 in a million at 0.6, 3 in 10,000 at 0.5, 8 in 1,000 at 0.4. Pairs
without a five-word shingle in common are not found: so below five words only equal texts are.

A bucket is a key of a sketch with all texts that have it. First, in the sketches below FIRST,
each text is held against one leader of its bucket, which puts nearly all texts of a group of
copies in one class at a cost of a few comparisons each. Then, in all sketches, only buckets with
texts of different classes go on: each text is held against a leader drawn anew for that bucket
if it is in another class, and mixed buckets are split by the texts' next sketch, with new leaders,
SPLITS times. Up to here work is in proportion to the texts in buckets. What leaders leave open is then settled
exactly (`_rest`): of each bucket that still has several classes all pairs of different classes are
held against each other, but for those that two bounds rule out: their lengths, and the words
they don't have in common (`odd`: one bit for each of PARITY places). So every two texts that agree in a sketch end in one class if they are similar, whoever leads.
No bucket and no text's partners are capped. The bounds are looked at for each text outside a bucket's largest class
against each text in it, so for a bucket of many classes their number grows with its square, and so can that of the pairs that pass.

Verification aligns the words within a band as wide as SIMILAR allows, many columns at a time
in the bits of one number. Texts linked at all are one class (connected components); of a
class the lowest doc_id leads. Equal word sequences are one text from the start; null and
empty texts have none, and are one class by equality. Rows with the same doc_id are kept apart;
a row without doc_id leads only where all of its class are without. Empty tables give no rows.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import words as W
from .common import RAW, blocks, chosen, removed, shared_dir, staged, whole_texts
from .sanitise import folded

SHINGLE, SIMILAR = 5, 0.8
#: Texts of so many shingles, the lowest so many taken, so many sketches.
KINDS = ((1, 16, 1, 16), (10, 64, 2, 28), (44, 1 << 40, 3, 36))
FIRST, SPLITS = 12, 1
#: Places in which words are counted to tell texts apart that can't be similar.
PARITY = 2048
#: Hashes held at once while sketching, and bytes of words in one Arrow batch of pairs.
AT_ONCE = 1 << 21


def word_ids(texts: list[str]) -> list[np.ndarray]:
    """The words of each text (letters and digits, in small letters) as 64-bit hashes."""
    r = W.runs([t.lower() for t in texts])
    word = (r.kinds == W.LETTER) | (r.kinds == W.DIGIT)
    starts, ends, doc = r.starts[word], r.ends[word], r.doc[word]
    hashes = W.slice_hashes(folded(r.points), starts, ends)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [hashes[a:b] for a, b in zip(cut[:-1], cut[1:])]


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of each five words in a row; of all words if there are fewer."""
    n = max(1, len(words) - SHINGLE + 1) if len(words) else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = W.mixed(out + words[k : k + n] + np.uint64(k + 1))
    return out


def occurrences(x: np.ndarray) -> np.ndarray:
    """How often each element occurred before."""
    if len(x) < 2:
        return np.zeros(len(x), np.int64)
    order = np.argsort(x, kind="stable")
    y = x[order]
    first = np.concatenate([[True], y[1:] != y[:-1]])
    at = np.arange(len(x))
    out = np.empty(len(x), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


_SEEDS = W.mixed(np.arange(1, max(k[3] for k in KINDS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACES = np.multiply.accumulate(np.full(max(k[2] for k in KINDS), 0x9DDFEA08EB382D69, np.uint64))  # tells orders apart


def labels(x: np.ndarray) -> np.ndarray:
    """Hashes of shingles and how often each occurred before."""
    return W.mixed(x + occurrences(x).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def sketches(x: np.ndarray) -> list[np.ndarray]:
    """The keys of a shingle sequence, for each of KINDS; none where it has another length."""
    labelled, out = labels(x), []
    for kind, (least, most, taken, n) in enumerate(KINDS):
        if not least <= len(x) <= most:
            out.append(np.zeros(0, np.int64))
            continue
        step, keys = max(1, AT_ONCE // len(x)), []
        for seeds in np.split(_SEEDS[:n], range(step, n, step)):
            hashed = (labelled[None] ^ seeds[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
            hashed ^= hashed >> np.uint64(32)
            k = min(taken, len(x))
            at = np.sort(np.argpartition(hashed, k - 1, axis=1)[:, :k], axis=1) if taken > 1 else hashed.argmin(1)[:, None]
            keys.append(W.mixed((labelled[at] * _PLACES[:k]).sum(1, dtype=np.uint64) ^ seeds + np.uint64(kind)))
        out.append(np.concatenate(keys).view(np.int64))
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two word sequences if SIMILAR or more, else 0."""
    n, k = len(a), len(b)
    if not n or not k:
        return float(n == k)
    need = int(np.ceil(SIMILAR * (n + k) / (1 + SIMILAR) - 1e-9))  # matches that reach SIMILAR
    if min(n, k) < need:
        return 0.0
    head = _common(a, b)
    tail = _common(a[head:][::-1], b[head:][::-1])
    a, b = a[head : n - tail], b[head : k - tail]
    if head + tail + min(int(np.isin(a, b).sum()), int(np.isin(b, a).sum())) < need:
        return 0.0
    matched = head + tail + (_banded(a.tolist(), b.tolist(), n - need, k - need) if len(a) and len(b) else 0)
    return matched / (n + k - matched) if matched >= need else 0.0


def _common(a: np.ndarray, b: np.ndarray) -> int:
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    return int(differ[0]) if len(differ) else m


def _banded(a: list[int], b: list[int], skip_a: int, skip_b: int) -> int:
    """Longest common subsequence with at most skip_a elements of a and skip_b of b left out.

    A row of the table is one number: its bit for column j of the band is 0 where the length
    grows at j. Each element of a turns one row into the next; the band moves on by blocks.
    """
    row, low, high, done = 0, 0, 0, 0
    step = max(128, (skip_a + skip_b) // 2)
    for first in range(0, len(a), step):
        part = a[first : first + step]
        left, right = min(max(0, first - skip_a), high), min(len(b), first + len(part) + skip_b)
        if left > low:
            gone = row & ((1 << left - low) - 1)
            done += left - low - gone.bit_count()
            row >>= left - low
            low = left
        if right > high:
            row |= ((1 << right - high) - 1) << high - low
            high = right
        where, wanted = {}, set(part)
        for j, x in enumerate(b[low:high]):
            if x in wanted:
                where[x] = where.get(x, 0) | 1 << j
        full = (1 << high - low) - 1
        for x in part:
            if hit := where.get(x):
                hit &= row
                row = (row + hit | row - hit) & full
    return done + high - low - row.bit_count()


def odd(words: np.ndarray) -> np.ndarray:
    """One bit a place: whether an odd number of words falls there, each labelled with how often it occurred before.

    Texts that leave out d words when aligned differ in d bits at most.
    """
    places = (labels(words.astype(np.uint32).astype(np.uint64)) >> np.uint64(40)).astype(np.int64) % PARITY
    return np.packbits((np.bincount(places, minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


SKETCHED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("raw", pa.int64()), ("same", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.list_(pa.int64()))), ("odd", pa.list_(pa.int64())), ("words", pa.binary())])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        both = pa.StructArray.from_arrays([batch.column(0), batch.column(2)], ["doc_id", "raw"])
        for pairs, texts in blocks(pa.RecordBatch.from_arrays([both, batch.column(1)], ["id", "text"])):
            out = {f.name: [] for f in SKETCHED}
            for x, words in zip(pairs, word_ids(texts)):
                values = (row, x["doc_id"], x["raw"], hashlib.blake2b(words.tobytes(), digest_size=16).digest(), len(words), sketches(shingles(words)) if len(words) else [], odd(words), words.astype(np.uint32).tobytes())
                for name, value in zip(out, values):
                    out[name].append(value)
                row += 1
            yield pa.RecordBatch.from_pydict(out, schema=SKETCHED)


PAIRS = pa.schema([("row", pa.int64()), ("leader", pa.int64()), ("similarity", pa.float64())])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [aligned(np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)) for a, b in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], schema=PAIRS)


def _held(asked: DataFrame, words: DataFrame, path: str) -> DataFrame:
    """The pairs asked for (row, leader), verified; words: row, words. Both joins read one exchange of the words."""
    own, other = words.alias("own").hint("merge"), words.alias("other").hint("merge")
    pairs = asked.select(F.col("row").alias("a"), F.col("leader").alias("b"))
    both = pairs.join(own, F.col("a") == F.col("own.row")).join(other, F.col("b") == F.col("other.row"))
    return staged(both.select("a", "b", "own.words", F.col("other.words").alias("others")).mapInArrow(_verified, from_arrow_schema(PAIRS)), path)


def _near(n: str, m: str) -> Column:
    return F.expr(f"least({n}, {m}) >= {SIMILAR - 1e-9}D * greatest({n}, {m})")


def links(texts: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Similar pairs (row, leader, similarity) among texts (row, n, keys, odd; row, words), and classes (row, root) of rows with one.

    What is joined here grows with the corpus, so no side is broadcast (`merge`): the plan is the same at every size.
    """
    spark, path = texts.sparkSession, shared_dir(texts.sparkSession)
    each = _members(texts.withColumn("root", F.col("row")), FIRST)
    first = _led(each, _mixed(each, F.xxhash64("row")))
    tried = _held(first.where("root <> led").select("row", "leader").distinct(), words, f"{path}/first")
    classes = components(tried.where("similarity > 0"))
    rooted = staged(texts.join(classes.hint("merge"), "row", "left").withColumn("root", F.coalesce("root", "row")))
    each = _members(rooted)
    asked = staged(_led(each, _mixed(each, F.xxhash64("row", "key"))))
    pairs = asked
    for depth in range(1, SPLITS + 1):
        further = F.xxhash64("key", F.expr(f"keys[kind][(sketch + {depth}) % size(keys[kind])]"))
        asked = staged(asked.drop("leader", "m", "led").join(rooted.select("row", "keys").hint("merge"), "row").withColumn("key", further).drop("keys"))
        asked = staged(_led(asked, _mixed(asked, F.xxhash64("row", "key"))))
        pairs = pairs.unionByName(asked)
    pairs = pairs.where((F.col("root") != F.col("led")) & _near("n", "m")).select("row", "leader").distinct()
    new = _held(pairs.join(tried.select("row", "leader"), ["row", "leader"], "left_anti"), words, f"{path}/second")
    classes = _joined(classes, new)
    last = _held(_rest(staged(texts.join(classes.hint("merge"), "row", "left").withColumn("root", F.coalesce("root", "row")))), words, f"{path}/third")
    similar = spark.read.schema(new.schema).parquet(f"{path}/first", f"{path}/second", f"{path}/third").where("similarity > 0")
    return similar, _joined(classes, last)


def _joined(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Classes (row, root) joined where a similar pair links them."""
    new = found.where("similarity > 0").select("row", "leader")
    return classes if new.isEmpty() else components(classes.withColumnRenamed("root", "leader").unionByName(new))


def _rest(rooted: DataFrame) -> DataFrame:
    """(row, leader): all pairs of different classes that share a bucket and that neither length nor odd words rule out.

    A pair has a text outside its bucket's largest class, so those are held against all. A bucket of two was settled by its leader.
    """
    each = _members(rooted).select("key", "row", "root")
    mixed = each.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high and size > 2").select("key")
    inside = staged(each.join(staged(mixed).hint("merge"), "key").join(rooted.select("row", "n", "odd").hint("merge"), "row"))
    top = inside.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("top"))
    own = staged(inside.join(staged(top).hint("merge"), "key").where("root <> top"))
    other = inside.select("key", F.col("row").alias("leader"), F.col("root").alias("led"), F.col("n").alias("m"), F.col("odd").alias("others")).hint("merge")
    apart = " + ".join(f"bit_count(odd[{i}] ^ others[{i}])" for i in range(PARITY // 64))
    unlike = f"n + m - 2 * ceil({SIMILAR}D * (n + m) / {1 + SIMILAR}D - 1e-9D)"  # words that similar texts can leave out
    met = (own["key"] == other["key"]) & F.expr("root <> led and (led = top or row < leader)") & _near("n", "m") & F.expr(f"{apart} <= {unlike}")
    return own.join(other, met).select("row", "leader").distinct()


def _members(texts: DataFrame, sketches: int | None = None) -> DataFrame:
    """(row, n, root, kind, sketch, key): a row for each sketch of a text, of the first so many if that is said."""
    lists = texts.where("n > 0").select("row", "n", "root", F.posexplode("keys").alias("kind", "list")).where("size(list) > 0")
    return lists.select("row", "n", "root", "kind", F.posexplode(F.slice("list", 1, sketches) if sketches else "list").alias("sketch", "key"))


def _mixed(members: DataFrame, order: Column) -> DataFrame:
    """(key, leader, m, led): of buckets with several classes the text that is lowest in order, its length and class."""
    leads = F.min(F.struct(order.alias("order"), F.col("row").alias("leader"), F.col("n").alias("m"), F.col("root").alias("led"))).alias("lead")
    found = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), leads).where("low <> high")
    return staged(found.select("key", "lead.leader", "lead.m", "lead.led"))


def _led(members: DataFrame, mixed: DataFrame) -> DataFrame:
    """Members of mixed buckets, with the leader: a bucket of many texts is one that Spark can split here."""
    return members.join(mixed.hint("merge"), "key")


def components(edges: DataFrame) -> DataFrame:
    """(row, root): the lowest row of each connected component, for rows that have edges (row, leader).

    Alternating large and small stars: every row is linked to the lowest row it knows, until
    nothing changes. What is joined by row is written first, so that Spark can split hot rows.
    """
    now = staged(edges.select(F.greatest("row", "leader").alias("a"), F.least("row", "leader").alias("b")).where("a <> b").distinct())
    known = _summary(now)
    while known[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        large = staged(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        least = staged(large.groupBy("a").agg(F.min("b").alias("low")))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        now = staged(small.where("a <> b").distinct())
        before, known = known, _summary(now)
        if known == before:
            break
    return staged(now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("row"), "root"))


def _summary(edges: DataFrame) -> tuple:
    """The same for the same edges; each round that changes them lowers ends of edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright("b", 24))).first())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (lowest doc_id of its class), class_size, n_links (texts it was held against and found similar to, not all similar ones), kept (leads its class)."""
    return _classified(docs).drop("raw")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that lead a class: one of each group of near-duplicates."""
    return chosen(docs, _classified(docs).where("kept").select("doc_id", "raw"), once=True)


def _classified(docs: DataFrame) -> DataFrame:
    path = shared_dir(docs.sparkSession)
    sketched = staged(whole_texts(docs).withColumn("raw", F.expr(RAW)).mapInArrow(_sketched, from_arrow_schema(SKETCHED)), path)
    firsts = staged(sketched.groupBy("same").agg(F.min("row").alias("text"), F.count("*").alias("copies")))
    several = firsts.where("copies > 1").select("same", "text")
    member = staged(sketched.select("row", "doc_id", "raw", "same").join(several, "same", "left").select("row", "doc_id", "raw", F.coalesce("text", "row").alias("text")))
    texts = staged(sketched.select("row", "n", "keys", "odd").join(firsts.select(F.col("text").alias("row")).hint("merge"), "row", "left_semi"), f"{path}-keys")
    found, root = links(texts, sketched.select("row", "words"))
    for done in (path, f"{path}-keys"):
        removed(docs.sparkSession, done)
    degree = found.select("row").unionByName(found.select(F.col("leader").alias("row"))).groupBy(F.col("row").alias("text")).agg(F.count("*").alias("n_links"))
    linked = staged(root.withColumnRenamed("row", "text").join(degree, "text"))
    classed = staged(member.join(linked, "text", "left").select("row", "doc_id", "raw", F.coalesce("root", "text").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = staged(classed.groupBy("root").agg(first, F.count("*").alias("class_size")).select("root", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("leads"), "class_size"))
    return classed.join(classes, "root").select("doc_id", "raw", "class_id", "class_size", "n_links", (F.col("row") == F.col("leads")).alias("kept"))
