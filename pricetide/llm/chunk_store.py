"""Token ids in a content-addressed store.

Each text's ids, with an end id, are cut into chunks where a rolling hash of the last
WINDOW ids has MASK's bits clear, so that equal stretches of ids are cut alike wherever
they are. A chunk is known by its BLAKE2b digest and its ids are written once, by the
first document (in order of doc_id) that has it; a document's recipe lists the chunks it
is made of. The digests of a document are the leaves of a Merkle tree whose root is kept
with it; these roots, in order, are the leaves of another whose root is the file's own, in
the manifest. A reader holds rows, ids and root of each file against the manifest, puts the
ids together from recipes and chunks and compares the documents' roots.

Files (in a shared folder)
  packs     rows in ascending doc_id (those without one last): file, doc_id, row, start
            (ids of the documents before it in its file), n, recipe (CHUNK records), body (the
            ids of the chunks that it wrote), root
  manifest  a row for each file of packs: file, first (ids in the files before it), rows, ids, root

Ids are 16-bit if the vocabulary allows, else 32-bit. Files are ranges of (doc_id, row), one for
about FILE_IDS ids, dealt by Spark's range partitioning; the driver gets the number of ids alone. A
chunk that very many documents share is joined to its readers by digest, in joins that Spark can
split; only chunks with several readers travel when the files are read.

Null and empty texts are the end id alone. Rows with the same or no doc_id are kept apart.
Empty tables give no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import words as W
from .common import blocks, removed, shared_dir, staged, whole_texts
from .encoding import encoder

END, WINDOW, MASK, LONGEST = 2, 8, 0x1FF, 8192
FILE_IDS = 6_000_000
OWN, SHARED, ELSEWHERE = range(3)  # a chunk written here; here, for others too; by another place
CHUNK = np.dtype([("kind", "u1"), ("length", "<u4"), ("digest", "V16")])
LAST = 2**63 - 1


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary tree; a level's odd last node moves up as it is."""
    while len(leaves) > 1:
        leaves = [digest(b"\x01" + leaves[i] + leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


@lru_cache(1)
def _drawn(n: int) -> np.ndarray:
    return (W.mixed(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cuts(ids: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where chunks end, in ids of documents one after another; stops: where each document ends, which a chunk does too."""
    n = len(ids)
    ends = np.zeros(0, np.int64)
    if n > WINDOW:
        x = _drawn(1 << 16 if ids.dtype.itemsize == 2 or ids.max() < 1 << 16 else int(ids.max()) + 1)[ids]
        h, scale = np.zeros(n - WINDOW + 1, np.uint32), 1
        for j in range(WINDOW):
            h += x[WINDOW - 1 - j : n - j] * np.uint32(scale)
            scale = scale * 0x01000193 & 0xFFFFFFFF
        h ^= h >> np.uint32(15)
        ends = np.flatnonzero((h * np.uint32(0x2C1B3C6D) >> np.uint32(12)) & np.uint32(MASK) == 0) + WINDOW
        of = np.searchsorted(stops, ends)
        ends = ends[ends - np.append(0, stops)[of] >= WINDOW]  # the window is of one document
    ends = np.union1d(ends, stops)
    starts = np.concatenate([[0], ends[:-1]])
    if len(ends) and (ends - starts).max() > LONGEST:
        ends = np.unique(np.concatenate([ends, *(np.arange(a + LONGEST, b, LONGEST) for a, b in zip(starts, ends) if b - a > LONGEST)]))
    return ends


JOURNAL = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("digests", pa.list_(pa.binary()))])


def _encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        tokens = encoder(path)
        last = np.array([end], np.uint32)
        kind = "<u2" if tokens.library.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for doc_ids, texts in blocks(batch):
                parts = [x for ids in tokens.many(texts) for x in (ids, last)]
                stops = np.cumsum([len(x) for x in parts])[1::2]
                every = np.concatenate(parts).astype(kind)
                ends = cuts(every, stops)
                data, size = every.tobytes(), every.dtype.itemsize
                edges = [0, *(ends * size).tolist()]
                digests = [digest(data[a:b]) for a, b in zip(edges, edges[1:])]
                lengths = np.diff(ends, prepend=0).astype("<u4").tobytes()
                out = {f.name: [] for f in JOURNAL}
                at = chunk = 0
                for i, stop, upto in zip(doc_ids, stops.tolist(), (np.searchsorted(ends, stops) + 1).tolist()):
                    for name, value in zip(out, (row, i, stop - at, data[at * size : stop * size], lengths[chunk * 4 : upto * 4], digests[chunk:upto])):
                        out[name].append(value)
                    at, chunk, row = stop, upto, row + 1
                yield pa.RecordBatch.from_pydict(out, schema=JOURNAL)

    return whole_texts(docs).mapInArrow(run, from_arrow_schema(JOURNAL))


PACK = pa.schema([("file", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("recipe", pa.binary()), ("body", pa.binary()), ("root", pa.binary()), ("shares", pa.bool_()), ("borrows", pa.bool_())])


def _places(journal: DataFrame) -> DataFrame:
    """(row, marks): the chunks of a row that others read too (3 * place + SHARED) or that are written elsewhere (+ ELSEWHERE)."""
    refs = journal.select("row", F.coalesce("doc_id", F.lit(LAST)).alias("key"), F.posexplode("digests").alias("place", "digest"))
    several = refs.groupBy("digest").agg(F.min(F.struct("key", "row", "place")).alias("owner"), F.count("*").alias("readers")).where("readers > 1")
    known = refs.join(staged(several.select("digest", F.col("owner.row").alias("owner_row"), F.col("owner.place").alias("owner_place"))), "digest")
    mark = F.when((F.col("row") == F.col("owner_row")) & (F.col("place") == F.col("owner_place")), F.col("place") * 3 + SHARED).otherwise(F.col("place") * 3 + ELSEWHERE)
    return known.groupBy("row", "key").agg(F.collect_list(mark).alias("marks"))


def write(docs: DataFrame, path: str, folder: str, end: int = END) -> None:
    """The store of all documents, in `folder`."""
    spark = docs.sparkSession
    root = shared_dir(spark)
    journal = staged(_encoded(docs, path, end), root, "zstd")
    total = journal.agg(F.sum("n")).first()[0] or 0
    n = max(1, round(total / FILE_IDS))
    key = F.coalesce("doc_id", F.lit(LAST)).alias("key")
    marks = _places(journal).select("key", "row", F.lit(0).alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("lengths"), F.lit(None).cast("array<binary>").alias("digests"), "marks")
    parts = journal.select(key, "row", F.lit(1).alias("part"), "doc_id", "n", "ids", "lengths", "digests", F.lit(None).cast("array<int>").alias("marks")).unionByName(marks)
    dealt = parts.repartitionByRange(n, "key", "row").sortWithinPartitions("key", "row", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, start, held, held_row = TaskContext.get().partitionId(), 0, [], None
        for batch in batches:
            out = {f.name: [] for f in PACK}
            for r in batch.to_pylist():
                if not r["part"]:
                    held, held_row = r["marks"], r["row"]
                    continue
                marked = held if held_row == r["row"] else []
                recipe, body = _packed(r["ids"], r["n"], r["lengths"], r["digests"], marked)
                kinds = recipe["kind"]
                values = (file, r["doc_id"], r["row"], start, r["n"], recipe.tobytes(), body, merkle(r["digests"]), bool((kinds == SHARED).any()), bool((kinds == ELSEWHERE).any()))
                for name, value in zip(out, values):
                    out[name].append(value)
                start += r["n"]
            yield pa.RecordBatch.from_pydict(out, schema=PACK)

    packs = staged(dealt.mapInArrow(run, from_arrow_schema(PACK)), f"{folder}/packs", "zstd")
    removed(spark, root)
    _manifest(packs).write.parquet(f"{folder}/manifest")


MANIFEST = pa.schema([("file", pa.int32()), ("first", pa.int64()), ("rows", pa.int64()), ("ids", pa.int64()), ("root", pa.string())])


def _manifest(packs: DataFrame) -> DataFrame:
    """What the manifest says of each file of packs."""

    @F.pandas_udf("string")
    def root(roots: pd.Series) -> pd.Series:
        return pd.Series([merkle([bytes(x["root"]) for x in r]).hex() for r in roots])

    rows = packs.groupBy("file").agg(F.count("*").alias("rows"), F.sum("n").alias("ids"), F.array_sort(F.collect_list(F.struct("start", "row", "root"))).alias("roots"))
    files = staged(rows.select("file", "rows", "ids", root("roots").alias("root"))).withColumn("group", F.expr("file div 1000"))
    # ids before a file: those of the groups before its group, and of the files before it there
    groups = files.groupBy("group").agg(F.sum("ids").alias("_ids"))
    groups = groups.select("group", (F.sum("_ids").over(Window.orderBy("group")) - F.col("_ids")).alias("before"))
    inside = F.sum("ids").over(Window.partitionBy("group").orderBy("file")) - F.col("ids")
    return files.withColumn("inside", inside).join(groups, "group").select("file", (F.col("before") + F.col("inside")).alias("first"), "rows", "ids", "root")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest; raises if files of packs aren't those it lists: order, rows, ids and root of each."""
    packs = spark.read.schema(from_arrow_schema(PACK)).parquet(f"{folder}/packs")
    said = spark.read.schema(from_arrow_schema(MANIFEST)).parquet(f"{folder}/manifest")
    found = staged(_manifest(packs))
    wrong = found.exceptAll(said).select("file").union(said.exceptAll(found).select("file")).distinct().limit(10).collect()
    if wrong:
        raise ValueError(f"files {sorted(r['file'] for r in wrong)} of {folder}/packs aren't those of the manifest")
    return said


def _packed(ids: bytes, n: int, lengths: bytes, digests: list[bytes], marks: list[int]) -> tuple[np.ndarray, bytes]:
    size = len(ids) // n
    length = np.frombuffer(lengths, "<u4")
    recipe = np.zeros(len(length), CHUNK)
    recipe["length"] = length
    recipe["digest"] = np.frombuffer(b"".join(digests), "V16")
    for m in marks:
        recipe["kind"][m // 3] = m % 3
    if not (recipe["kind"] == ELSEWHERE).any():
        return recipe, ids
    ends = np.cumsum(length.astype(np.int64)) * size
    return recipe, b"".join(ids[e - c * size : e] for e, c, k in zip(ends.tolist(), length.tolist(), recipe["kind"].tolist()) if k != ELSEWHERE)


READ = pa.schema([("doc_id", pa.int64()), ("file", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _whole(r: dict, others: dict[int, bytes]) -> np.ndarray:
    """The ids of a row of packs; others: chunks that it doesn't have, by place. Raises if they aren't what was written."""
    recipe, body = np.frombuffer(r["recipe"], CHUNK), r["body"]
    own = int(recipe["length"][recipe["kind"] != ELSEWHERE].sum())
    size = len(body) // own if own else len(next(iter(others.values()))) // int(recipe["length"][next(iter(others))])
    at, parts, leaves = 0, [], []
    for place, (kind, length) in enumerate(zip(recipe["kind"].tolist(), recipe["length"].tolist())):
        if kind == ELSEWHERE:
            parts.append(others[place])
        else:
            parts.append(body[at : at + length * size])
            at += length * size
        leaves.append(digest(parts[-1]))
    if merkle(leaves) != r["root"]:
        raise ValueError(f"document {r['doc_id']}: its chunks aren't those that were written")
    return np.frombuffer(b"".join(parts), f"<u{size}")


def _summary(rows: list[tuple[dict, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"doc_id": [r["doc_id"] for r, _ in rows], "file": [r["file"] for r, _ in rows], "start": [r["start"] for r, _ in rows], "n_tokens": [len(x) for _, x in rows], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for _, x in rows]}, schema=READ
    )


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            yield _summary([(r, _whole(r, {})) for r in batch.slice(at, 500).to_pylist()])


CHUNKS = pa.schema([("digest", pa.binary()), ("chunk", pa.binary())])
WANTED = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("digest", pa.binary())])


def _lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"digest": [], "chunk": []}
        for r in batch.to_pylist():
            recipe = np.frombuffer(r["recipe"], CHUNK)
            recipe = recipe[recipe["kind"] != ELSEWHERE]
            ends = np.cumsum(recipe["length"].astype(np.int64))
            size = len(r["body"]) // int(ends[-1])
            for k in np.flatnonzero(recipe["kind"] == SHARED).tolist():
                b = int(ends[k]) * size
                out["digest"].append(recipe["digest"][k].tobytes())
                out["chunk"].append(r["body"][b - int(recipe["length"][k]) * size : b])
        yield pa.RecordBatch.from_pydict(out, schema=CHUNKS)


def _borrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"row": [], "place": [], "digest": []}
        for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            recipe = np.frombuffer(data, CHUNK)
            for place in np.flatnonzero(recipe["kind"] == ELSEWHERE).tolist():
                out["row"].append(row)
                out["place"].append(place)
                out["digest"].append(recipe["digest"][place].tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=WANTED)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by row: the chunks that it borrows, by place, then the row of packs itself."""
    others: dict[int, bytes] = {}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["place"] < LAST_PLACE:
                others[r["place"]] = r["body"]
            else:
                rows.append((r, _whole(r, others)))
                others = {}
        yield _summary(rows)


LAST_PLACE = 2**31 - 1


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone, once they agree with the manifest."""
    files = verify(spark, folder).select("file", "first")
    packs = spark.read.schema(from_arrow_schema(PACK)).parquet(f"{folder}/packs")
    schema = from_arrow_schema(READ)
    alone = packs.where("not borrows").mapInArrow(_alone, schema)
    lent = packs.where("shares").select("recipe", "body").mapInArrow(_lent, from_arrow_schema(CHUNKS))
    wanted = packs.where("borrows").select("row", "recipe").mapInArrow(_borrowed, from_arrow_schema(WANTED))
    chunks = wanted.join(lent, "digest").select("row", "place", F.col("chunk").alias("body"), *(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("file", "int"), ("start", "long"), ("recipe", "binary"), ("root", "binary"))))
    rows = packs.where("borrows").select("row", F.lit(LAST_PLACE).alias("place"), "body", "doc_id", "file", "start", "recipe", "root")
    found = alone.unionByName(rows.unionByName(chunks).repartition("row").sortWithinPartitions("row", "place").mapInArrow(_together, schema))
    return found.join(files, "file").select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def stored(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Writes the store of `docs` to a new shared folder and gives what reading it back finds; path: a tokenizers file that every executor can read."""
    folder = shared_dir(docs.sparkSession)
    write(docs, path, folder, end)
    return read(docs.sparkSession, folder)
