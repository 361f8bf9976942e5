"""Token counts of a unigram vocabulary, scored once per shared prefix of a trie.

A text's pre-tokens are its words (what white space separates) with "▁" in front. The
distinct pre-tokens of a block of texts are inserted in a trie; walking it depth first
(they are sorted, so that only the path to the present node is held) each node gets its
forward score once: the best sum of piece scores over all ways to cut the prefix that
ends there, and the number of pieces of that way. What a word's last node holds is its
terminal count, remembered by the word for later blocks; a text's count is the sum over its words.

The pieces come from a sentencepiece file, never trained here. Its merge ranks stand in
for probabilities by Zipf's law: log p = -log(rank + 3) - log H. A character that is no
piece falls back to its UTF-8 bytes, each at UNKNOWN. Of equally good ways the one with
fewer pieces counts.

Null and empty texts have 0 words, 0 tokens and log likelihood 0. A doc_id may be null
or repeated. Empty tables give no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .common import by_document

BEGIN = "▁"
UNKNOWN = -25.0
LIMIT, LETTERS, LONG = 400_000, 5_000_000, 200


def piece_scores(path: str) -> dict[str, float]:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (i + 3) for i in range(len(pieces))))
    return {p: -math.log(i + 3) - total for i, p in enumerate(pieces)}


class Trie:
    """Forward scores along one path from the root; `counts` of sorted words reuses what neighbours share."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        #: How long the pieces are that end in these three characters.
        self.lengths: dict[str, list[int]] = {}
        for p in sorted(scores, key=len, reverse=True):
            if len(p) > 2 and len(p) not in (known := self.lengths.setdefault(p[-3:], [])):
                known.append(len(p))

    def counts(self, words: list[str]) -> list[tuple[int, float]]:
        """(pieces, score) of each word, in the order given."""
        get, lengths = self.scores.get, self.lengths.get
        score, pieces, last, out = [0.0], [0], "", {}
        for word in sorted(words):
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del score[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode("utf-8", "replace"))
                best, fewest = score[end - 1] + UNKNOWN * size, pieces[end - 1] + size
                for n in (*lengths(word[max(0, end - 3) : end], ()), 2, 1):
                    start = end - n
                    if start >= 0 and (s := get(word[start:end])) is not None:
                        s += score[start]
                        if s > best or s == best and pieces[start] + 1 < fewest:
                            best, fewest = s, pieces[start] + 1
                score.append(best)
                pieces.append(fewest)
            out[word] = pieces[-1], score[-1]
            last = word
        return [out[w] for w in words]


class Counter:
    def __init__(self, path: str):
        self.trie = Trie(piece_scores(path))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, tuple[int, float]] = {}
        self.letters = 0

    def _counts(self, words: list[str]) -> list[tuple[int, float]]:
        """(pieces, score) of each of some distinct words."""
        if len(self.known) + len(words) > LIMIT or self.letters > LETTERS:
            self._forget()
        known = self.known
        new = [w for w in words if w not in known]
        found = dict(zip(new, self.trie.counts([BEGIN + w for w in new])))
        short = {w: x for w, x in found.items() if len(w) <= LONG}
        out = [known[w] if w in known else found[w] for w in words]
        known.update(short)
        self.letters += sum(map(len, short))
        return out

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, tokens and log likelihood of each text."""
        r = W.runs(texts, spaces_only=True)
        keep = r.kinds == W.OTHER
        starts, ends, doc = r.starts[keep], r.ends[keep], r.doc[keep]
        where, kind = W.distinct(r.points, starts, ends)
        every = "\0".join(texts)
        found = self._counts([every[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())])
        pieces, score = np.array([n for n, _ in found], np.int64), np.array([s for _, s in found])
        n = len(texts)
        return np.bincount(doc, minlength=n), np.bincount(doc, pieces[kind], n).astype(np.int64), np.bincount(doc, score[kind], n)


@lru_cache(1)
def counter(path: str) -> Counter:
    return Counter(path)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("log_likelihood", pa.float64())])


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row a document; path: a sentencepiece file that every executor can read."""

    def work(ids, texts):
        words, tokens, score = counter(path).many(texts)
        return {"doc_id": ids, "n_words": words, "n_tokens": tokens, "log_likelihood": [round(s, 3) for s in score.tolist()]}

    return by_document(docs, SCHEMA, work)
