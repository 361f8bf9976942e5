"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hexadecimal strings) are
reported by themselves. Weak parts are reported only where complementary parts meet
in one scope: an interval of `SCOPE` code points around a part. The parts of a text
are joined by interval (sorted starts and ends, one bisection each), never pair by pair.
Parts are matched in whole texts at their whole length; what overlaps a part is no complement of it.

Null and empty texts have no spans; a doc_id may be null or repeated, each row gets
its own result; spans with one start go by kind; an empty table gives no rows; columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_document
from .spans import Span, joined, sha256

KINDS = ("assign", "access", "hex")
#: Weak parts belong together if at most so many code points lie between them.
SCOPE = 160

ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Weak parts: a named account, a random-looking value of 40 characters, a network address.
WEAK_ACCESS = re.compile(r"""(?ai)\b(?:access_?key(?:_?id)?|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"(?:[a-z][a-z0-9+.-]{1,15})://[^\s\"'<>]+")
WEAK_HINTS = ("access", "client", "account", "user", "login")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each strong kind, by start, then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += (("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8)
    if "AKIA" in text:
        out += (("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16)
    out += (("hex", *m.span()) for m in HEX.finditer(text))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class _Parts:
    """Intervals of one role, to be asked for those near another; they may overlap or lie in one another."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts = sorted(s for s, _ in spans)
        self.ends = sorted(e for _, e in spans)

    def near(self, start: int, end: int) -> bool:
        """Is one within SCOPE of [start, end) without overlapping it?"""
        before, after = bisect_right(self.ends, start) - 1, bisect_left(self.starts, end)
        return before >= 0 and start - self.ends[before] <= SCOPE or after < len(self.starts) and self.starts[after] - end <= SCOPE


def _looks_random(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts whose complements co-occur: an access identifier and a secret find each other, an endpoint needs both."""
    low = text.lower()
    weak_access = [m.span() for m in WEAK_ACCESS.finditer(text)] if any(h in low for h in WEAK_HINTS) else []
    access = [(s, e) for k, s, e in base if k == "access"]
    if not access and not weak_access:
        return []  # a secret without an identifier isn't a multipart credential
    weak_secret = [m.span() for m in WEAK_SECRET.finditer(text) if _looks_random(m[0])]
    endpoints = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text else []
    secret = [(s, e) for k, s, e in base if k in ("assign", "hex")]
    strong_access, strong_secret = _Parts(access), _Parts(secret)
    all_access, all_secret, hosts = _Parts([*access, *weak_access]), _Parts([*secret, *weak_secret]), _Parts(endpoints)
    out: list[Span] = []
    for s, e in weak_access:
        if strong_secret.near(s, e) or (all_secret.near(s, e) and hosts.near(s, e)):
            out.append(("weak_access", s, e))
    for s, e in weak_secret:
        if strong_access.near(s, e) or (all_access.near(s, e) and hosts.near(s, e)):
            out.append(("weak_secret", s, e))
    for s, e in endpoints:
        if all_access.near(s, e) and all_secret.near(s, e):
            out.append(("endpoint", s, e))
    return sorted(set(out), key=lambda x: (x[1], x[0], x[2]))


SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_linked", pa.int64())])


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: counts by kind, a digest of the strong spans, all spans in order, and how many were linked."""

    def work(ids, texts):
        out = {f.name: [] for f in SCHEMA}
        for i, text in zip(ids, texts):
            base = base_spans(text)
            more = linked_spans(text, base)
            order = {k: n for n, k in enumerate((*KINDS, "weak_access", "weak_secret", "endpoint"))}
            row = (i, *(sum(s[0] == k for s in base) for k in KINDS), sha256(joined(base)), joined(sorted([*base, *more], key=lambda s: (s[1], order[s[0]], s[2]))), len(more))
            for name, value in zip(out, row):
                out[name].append(value)
        return out

    return by_document(docs, SCHEMA, work)
