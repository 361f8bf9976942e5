"""Exact token ids for whole texts, without a memory of what was encoded before.

`Encoder.many(texts)` gives the ids that the ``tokenizers`` library gives for each
text with ``add_special_tokens=False``. Both vocabularies cut a text into pieces before
they merge, and no merge crosses a cut. tiktoken's routine, loaded with the ranks of the
same file, merges faster than the library and has no end-of-word mark, so for the
vocabulary of words a character that ends a piece is put after each one here, for many
texts at a time; the byte vocabulary's pieces are its own pattern. What the two may not
cut alike goes through the library as a whole: texts with a special token's name or the
mark itself, runs of white space longer than `RUN` and, for words, texts with an apostrophe
or letters that the normaliser may change.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import regex

from . import words as W

#: The character that ends a piece of the vocabulary of words, as text and as a number.
MARK, MARK_POINT = "\x01", 1
#: The name of a special token that no text has; with none at all the routine would look for one at each character.
NEVER = "\x01\x01never\x01\x01"
#: How the byte vocabulary cuts a text.
BYTE_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
RUN = 10_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _latin(text: str) -> bool:
    """Are all characters below U+0100?"""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_LONG_RUN = regex.compile(rf"\s{{{RUN}}}")


class Encoder:
    """One vocabulary file, loaded once in a process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spaces_kept = self.library.normalizer is None
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()] + [MARK]
        byte = {ord(c): b for b, c in _byte_letters().items()}
        end = b"" if self.spaces_kept else MARK.encode()
        ranks = {}
        vocab = self.library.get_vocab(with_added_tokens=False)
        for token, i in vocab.items():
            if token not in self.special:
                bare = token.removesuffix("</w>") if end else token
                ranks[bytes(byte[ord(c)] for c in bare) + end * (bare != token)] = i
        pieces = BYTE_PIECES if self.spaces_kept else f"[^{MARK}]*{MARK}"
        self.merge = tiktoken.Encoding("pieces", pat_str=pieces, mergeable_ranks=ranks, special_tokens={NEVER: max(vocab.values()) + 1000})._core_bpe.encode_to_tiktoken_buffer

    def _marked(self, texts: list[str]) -> list[str]:
        """The pieces of texts below U+0100, MARK after each, white space left out."""
        points = np.frombuffer("".join(t.lower() + "\n" for t in texts).encode("latin-1"), np.uint8)
        kinds = W.latin_classes()[points]
        keep = kinds != W.SPACE
        n = keep.astype(np.uint8)  # characters written for each: itself, and a mark if it ends a piece; each digit is one
        n[:-1] += keep[:-1] & ((kinds[1:] != kinds[:-1]) | (kinds[:-1] == W.DIGIT))
        ends = np.cumsum(n, dtype=np.int64)
        out = np.full(int(ends[-1]) if len(ends) else 0, MARK_POINT, np.uint8)
        out[ends[keep] - n[keep]] = points[keep]
        every = out.tobytes().decode("latin-1")
        cuts = [0, *ends[np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1].tolist()]
        return [every[a:b] for a, b in zip(cuts, cuts[1:])]

    def _odd(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return True
        if self.spaces_kept:
            return len(text) > RUN and _LONG_RUN.search(text) is not None
        return "'" in text or not _latin(text)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, uint32."""
        odd = [*map(self._odd, texts)]
        plain = [t for t, o in zip(texts, odd) if not o]
        ids = iter(plain if self.spaces_kept else self._marked(plain))
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if o else np.frombuffer(self.merge(next(ids), set()), np.uint32) for t, o in zip(texts, odd)]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)
