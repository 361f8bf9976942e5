"""What the operators of this subpackage share: inputs, staged tables, Arrow maps."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: Code points handled at once by the vectorised operators.
BLOCK_CHARS = 1_000_000
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(docs: DataFrame) -> None:
    """Bounds Arrow batches by bytes for the rest of the session: 10,000 long texts would fill a worker's memory."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def whole_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns asked for; others are left out, whatever their names."""
    small_batches(docs)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def free_name(name: str, columns: list[str]) -> str:
    """`name`, longer if a column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


#: What tells rows apart besides doc_id: a hash of the text as it stands.
RAW = "xxhash64(coalesce(text, ''))"


def chosen(docs: DataFrame, decided: DataFrame, once: bool) -> DataFrame:
    """The rows of `docs`, all columns, whose (doc_id, raw) is in `decided`; once: of rows alike in both, one."""
    own, raw, at = (free_name(x, docs.columns) for x in ("pt_id", "pt_raw", "pt_at"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    rows = docs.withColumns({own: key, raw: F.expr(RAW)})
    out = rows.join(decided.select(key.alias(own), F.col("raw").alias(raw)), [own, raw], "left_semi")
    if once:
        out = out.withColumn(at, F.row_number().over(Window.partitionBy(own, raw).orderBy(own))).where(F.col(at) == 1).drop(at)
    return out.drop(own, raw).select(*(f"`{c}`" for c in docs.columns))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below the folder set by setCheckpointDir. If neither is: an error on a cluster, a local folder where all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if known.isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pricetide-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get()
    return f"{root}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """`df` written to a shared folder and read again: no lineage, and it survives the loss of executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def by_document(docs: DataFrame, schema: pa.Schema, work: Callable[[list, list[str]], dict[str, list]], chars: int = BLOCK_CHARS) -> DataFrame:
    """`work` on blocks of (doc ids, whole texts) of about `chars` code points; it returns the columns of `schema`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in blocks(batch, chars):
                yield pa.RecordBatch.from_pydict(work(ids, texts), schema=schema)

    return whole_texts(docs).mapInArrow(run, from_arrow_schema(schema))


def blocks(batch: pa.RecordBatch, chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """The rows (first column: id, second: text) in blocks whose texts have about `chars` bytes together."""
    texts = batch.column(1)
    sizes = pc.binary_length(texts).to_pylist()
    at = list(itertools.accumulate((n or 0 for n in sizes), initial=0))
    start = 0
    for i in range(1, len(batch) + 1):
        if at[i] - at[start] >= chars or i == len(batch):
            yield batch.column(0).slice(start, i - start).to_pylist(), texts.slice(start, i - start).to_pylist()
            start = i
