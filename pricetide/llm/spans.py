"""Spans as strings: kind:start:end in code points, end exclusive, comma-joined."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
