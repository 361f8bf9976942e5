"""Language identification by a small byte convolutional network, trained here in numpy.

A text's UTF-8 bytes are cut into windows of `LENGTH` bytes (the last one padded);
filters of several widths run over each window, their highest answers feed a softmax,
and a text's language is the one with the highest mean log probability over all its
windows, weighted by how many bytes they have. `score` is the mean probability of it.

Training rows: labelled texts with crc32(doc_id) mod 5 <> 0, at most `SAMPLE` of them
(those with the lowest hash of doc_id, of equal ones those with the lowest hash of their
text) and `PER_TEXT` windows spread evenly over each; every class gets the same share of the steps. Only text goes in.

Null texts and texts without a letter are `und` with score 0. Without any labelled
text every other text is `und` as well. A null doc_id is not held out and not learned
from. Of equally likely languages the first by name is given. Empty tables give no rows. Columns
besides doc_id, text and lang are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, by_document, small_batches

LENGTH, EMBEDDED, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 8
SAMPLE, PER_TEXT, STEPS, BATCH = 4000, 4, 900, 96
HELD_OUT = "crc32(encode(cast(doc_id as string), 'utf-8')) % 5 = 0"
_SPAN = max(WIDTHS)


@dataclass
class Net:
    languages: list[str]
    bytes: np.ndarray  # 256 x EMBEDDED
    filters: np.ndarray  # _SPAN * EMBEDDED x filters; a narrow filter is 0 beyond its width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def seen(self, windows: np.ndarray) -> np.ndarray:
        """windows x LENGTH bytes as what each filter position sees: windows x positions x (_SPAN * EMBEDDED)."""
        x = self.bytes[windows]
        at = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), _SPAN * EMBEDDED, axis=1)[:, ::EMBEDDED]
        return np.ascontiguousarray(at)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(windows), 192):
            top = (self.seen(windows[i : i + 192]) @ self.filters).max(1)
            out.append(_softmax(np.maximum(top + self.bias, 0) @ self.out + self.out_bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 0) -> Net:
    """Adam on cross-entropy; the gradient goes through each filter's highest position only."""
    rng, n = np.random.default_rng(seed), FILTERS * len(WIDTHS)
    mask = np.zeros((_SPAN * EMBEDDED, n), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * EMBEDDED, k * FILTERS : (k + 1) * FILTERS] = 1
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Net(languages, draw(256, EMBEDDED, scale=0.5), draw(_SPAN * EMBEDDED, n, scale=0.3) * mask, np.zeros(n, np.float32), draw(n, len(languages), scale=0.3), np.zeros(len(languages), np.float32))
    net.bytes[0] = 0  # padding
    names = ("bytes", "filters", "bias", "out", "out_bias")
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    of = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        picked = np.concatenate([rng.choice(x, BATCH // len(of) + 1) for x in of])
        x, y = windows[picked], labels[picked]
        seen = net.seen(x)
        answers = seen @ net.filters
        where = answers.argmax(1)
        pooled = np.maximum(np.take_along_axis(answers, where[:, None], 1)[:, 0] + net.bias, 0)
        wrong = _softmax(pooled @ net.out + net.out_bias)
        wrong[np.arange(len(y)), y] -= 1
        wrong /= len(y)
        back = (wrong @ net.out.T) * (pooled > 0)
        best = seen[np.arange(len(x))[:, None], where]  # rows x filters x (_SPAN * EMBEDDED)
        grad = {"out": pooled.T @ wrong, "out_bias": wrong.sum(0), "bias": back.sum(0), "filters": np.einsum("bfk,bf->kf", best, back) * mask, "bytes": np.zeros_like(net.bytes)}
        to = (back[:, :, None] * net.filters.T[None]).reshape(len(x), n, _SPAN, EMBEDDED)
        at = x[np.arange(len(x))[:, None, None], where[:, :, None] + np.arange(_SPAN)]
        np.add.at(grad["bytes"], at, to)
        grad["bytes"][0] = 0
        rate = 0.01 * min(1, 2 * (1 - step / (steps + 1)))
        for k in names:
            first[k] += 0.1 * (grad[k] - first[k])
            second[k] += 0.001 * (grad[k] ** 2 - second[k])
            getattr(net, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return net


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text each belongs to, and how many bytes it has."""
    count = np.array([-(-len(t) // LENGTH) for t in texts], np.int64)
    whole = np.frombuffer(b"".join(t + bytes(-len(t) % LENGTH) for t in texts), np.uint8).reshape(-1, LENGTH)
    doc = np.repeat(np.arange(len(texts)), count)
    filled = np.full(len(doc), LENGTH, np.int64)
    filled[np.cumsum(count)[count > 0] - 1] = [(len(t) - 1) % LENGTH + 1 for t in texts if t]
    return whole, doc, filled


def learned(docs: DataFrame) -> Net | None:
    """The network of a table's labelled rows outside the held-out fifth."""
    rows = docs.select("doc_id", "text", "lang").where(f"lang is not null and text is not null and not ({HELD_OUT})")
    chars = f"greatest(char_length(text) - {LENGTH}, 0)"
    windows = F.expr(f"array_distinct(transform(sequence(0, {PER_TEXT - 1}), k -> substring(text, cast(k * {chars} div {PER_TEXT - 1} as int) + 1, {LENGTH})))")
    rows = rows.withColumn("_order", F.struct(F.xxhash64("doc_id").alias("a"), F.xxhash64("text", "lang").alias("b")))
    last = rows.select("_order").orderBy("_order").limit(SAMPLE).agg(F.max("_order").alias("x")).select("x.a", "x.b").first()
    if last["a"] is None:
        return None
    # more than SAMPLE only if the last ones are one row, repeated
    picked = rows.where(F.col("_order") <= F.struct(F.lit(last["a"]).alias("a"), F.lit(last["b"]).alias("b"))).limit(SAMPLE)
    sample = sorted(picked.select("doc_id", "lang", windows.alias("windows")).collect())
    languages = sorted({r["lang"] for r in sample})
    texts = [(w.encode("utf-8", "replace")[:LENGTH], languages.index(r["lang"])) for r in sample for w in r["windows"] if any(map(str.isalpha, w))]
    if not texts:
        return None
    languages = [languages[k] for k in sorted({y for _, y in texts})]
    number = {k: i for i, k in enumerate(sorted({y for _, y in texts}))}
    return train(cut([t for t, _ in texts])[0], np.array([number[y] for _, y in texts]), languages)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predictions(net: Net | None, texts: list[str]) -> list[tuple[str, float]]:
    letters = [bool(net) and any(map(str.isalpha, t)) for t in texts]
    out = [("und", 0.0)] * len(texts)
    some = [i for i, ok in enumerate(letters) if ok]
    if some:
        windows, doc, filled = cut([texts[i].encode("utf-8", "replace") for i in some])
        p = net.probabilities(windows)
        weight = filled[:, None].astype(np.float64)
        edges = np.flatnonzero(np.diff(doc, prepend=-1))
        total = np.add.reduceat(weight, edges)
        logs = np.add.reduceat(np.log(p + 1e-9) * weight, edges) / total
        mean = np.add.reduceat(p * weight, edges) / total
        best = logs.argmax(1)
        for k, i in enumerate(some):
            out[i] = net.languages[best[k]], float(min(1.0, mean[k, best[k]]))
    return out


def identify(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; the network is learned from `docs` unless given."""
    from zlib import crc32

    net = net or learned(docs)

    def work(ids, texts):
        found = predictions(net, texts)
        return {"doc_id": ids, "held_out": [i is not None and crc32(str(i).encode()) % 5 == 0 for i in ids], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    return by_document(docs, SCHEMA, work)


def filtered(docs: DataFrame, net: Net | None, certain: float) -> DataFrame:
    """The rows of `docs`, all columns, whose text has a letter and, if there is a network, a language of at least that score."""
    small_batches(docs)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = []
            for _, texts in blocks(pa.RecordBatch.from_arrays([batch.column(place)] * 2, ["id", "text"])):
                texts = [t or "" for t in texts]
                if net:
                    keep += (language != "und" and score >= certain for language, score in predictions(net, texts))
                else:
                    keep += (any(map(str.isalpha, t)) for t in texts)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
