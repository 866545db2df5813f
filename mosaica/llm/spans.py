"""What the span finders (personal data, secrets) share."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

Span = tuple[str, int, int]  # kind, start, end (exclusive), in code points


def joined(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    """``kind:start:end`` by start, then kind in the order of kinds, then end, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()
