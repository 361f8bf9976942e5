"""Texts cut into runs of letters, digits, other characters and white space, many texts at a time in numpy."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

SPACE, LETTER, DIGIT, OTHER, BREAK = range(5)
BREAK_POINT = 0x110000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point; white space is what Unicode calls so, letters are L*, digits N*."""
    return np.append(_classes_below(sys.maxunicode + 1), np.uint8(BREAK))


@lru_cache(1)
def latin_classes() -> np.ndarray:
    """The classes below U+0100 alone."""
    return _classes_below(256)


def _classes_below(n: int) -> np.ndarray:
    every = "".join(map(chr, range(n)))
    out = np.full(n, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


@lru_cache(1)
def _spaces() -> np.ndarray:
    out = classes().copy()
    out[(out == LETTER) | (out == DIGIT)] = OTHER
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after another, BREAK_POINT after each; where each starts."""
    parts, starts, at = [], [], 0
    end = np.array([BREAK_POINT], np.uint32)
    for t in texts:
        x = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
        parts += (x, end)
        starts.append(at)
        at += len(x) + 1
    return np.concatenate(parts) if parts else end[:0], np.array(starts, np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), the same on every machine."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= _MIX
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Two primes and a base for each: a hash modulo 2^64 gives some pieces of a thousand letters one value, whatever its base.
_PRIMES = ((0x7FFFFFFF, 0x2545F491), (0x7FFFFFED, 0x1B873593))
#: So many powers are kept from one call to the next.
_KEPT = 1 << 21


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1) modulo prime, by doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out


@lru_cache(4)
def _known_powers(base: int, prime: int) -> np.ndarray:
    return _powers(base, prime, _KEPT)


def slice_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice points[start:end]; equal slices have equal hashes, wherever they are."""
    n = len(points) + 1
    spread = mixed(points.astype(np.uint64) + _STEP)
    halves = []
    for base, prime in _PRIMES:
        p, inverse = np.uint64(prime), pow(base, -1, prime)
        up, down = (_known_powers(x, prime)[:n] if n <= _KEPT else _powers(x, prime, n) for x in (base, inverse))
        total = np.zeros(n, np.uint64)
        np.cumsum(spread % p * up[:-1] % p, out=total[1:])
        halves.append((total[ends] - total[starts]) % p * down[starts] % p)
        spread >>= np.uint64(17)
    return mixed((halves[0] << np.uint64(32) | halves[1]) + (ends - starts).astype(np.uint64) * _STEP)


@lru_cache(2)
def _wrapping_powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


def quick_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Like `slice_hashes`, faster, and with known collisions (Thue-Morse words): only where slices are compared as well."""
    n = len(points) + 1
    bases = (0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    up, down = (_wrapping_powers(b, _KEPT) if n <= _KEPT else _wrapping_powers.__wrapped__(b, n) for b in bases)
    total = np.zeros(n, np.uint64)
    np.cumsum((points.astype(np.uint64) + _STEP) * _MIX * up[: n - 1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def distinct(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which slices are the first of their kind, and for each slice its kind. Slices are compared, not only their hashes."""
    _, first, kind = np.unique(quick_hashes(points, starts, ends), return_index=True, return_inverse=True)
    if not len(first):
        return first, kind
    n = ends - starts
    other = np.repeat(np.arange(len(starts)), n)
    like = starts[first][kind]
    same = n == (ends[first] - starts[first])[kind]
    at = np.flatnonzero(same[other])
    offset = ragged(np.zeros(len(starts), np.int64), n)[at]
    of = other[at]
    unlike = of[points[starts[of] + offset] != points[like[of] + offset]]
    same[unlike] = False
    odd = np.flatnonzero(~same)
    if len(odd):  # kinds of their own, told apart by what they are
        own: dict[bytes, int] = {}
        more = [own.setdefault(points[starts[i] : ends[i]].tobytes(), len(own)) for i in odd.tolist()]
        kind[odd] = np.array(more) + len(first)
        first = np.concatenate([first, odd[np.unique(more, return_index=True)[1]]])
    return first, kind


@dataclass
class Runs:
    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    kinds: np.ndarray
    doc: np.ndarray


def runs(texts: list[str], spaces_only: bool = False) -> Runs:
    """Maximal runs of one class, BREAKs left in (kind BREAK), `doc` the text each belongs to. spaces_only: all but white space is OTHER."""
    points, _ = code_points(texts)
    kinds = (_spaces() if spaces_only else classes())[points]
    if not len(points):
        none = np.zeros(0, np.int64)
        return Runs(points, none, none, kinds, none)
    cut = np.flatnonzero((kinds[1:] != kinds[:-1]) | (kinds[1:] == BREAK)) + 1
    starts = np.concatenate([[0], cut])
    ends = np.concatenate([cut, [len(points)]])
    of = kinds[starts]
    doc = np.cumsum(of == BREAK) - (of == BREAK)
    return Runs(points, starts, ends, of, doc)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start+1, ... of each stretch, one stretch after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
