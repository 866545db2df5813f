"""Text to tokens, with one regular expression."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal


class SyntaxProblem(ValueError):
    """The text is not a query."""


@dataclass(frozen=True)
class Token:
    kind: str  # ident, quoted, param, int, float, decimal, duration, string, datetime, uuid, bytes, op, end
    text: str
    value: object
    start: int
    end: int


# Milliseconds by duration unit.
UNITS = {"y": 31_536_000_000, "w": 604_800_000, "d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1_000, "ms": 1, "us": 0, "ns": 0}

_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|//[^\n]*|\#[^\n]*|/\*.*?\*/)
  | (?P<prefixed>[sdubr](?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'))
  | (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
  | (?P<duration>\d+(?:ms|us|ns|[ywdhms])(?:\d+(?:ms|us|ns|[ywdhms]))*(?![A-Za-z_0-9]))
  | (?P<decimal>\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?dec\b)
  | (?P<float>\d[\d_]*\.\d+(?:[eE][+-]?\d+)?f?|\d[\d_]*[eE][+-]?\d+f?|\d[\d_]*f\b)
  | (?P<int>\d[\d_]*)
  | (?P<param>\$[A-Za-z_]\w*)
  | (?P<quoted>`[^`]+`)
  | (?P<ident>[^\W\d]\w*(?:::[^\W\d]\w*)*)
  | (?P<op><->|\.\.=|>\.\.|->|<-(?=\s*[?A-Za-z_*`])|=>|\.\.|@@|!=|==|\*=|\?=|\?\?|\?:|\*\*|<=|>=|&&|\|\||[-+*/%=<>!?.,:;(){}\[\]|&@])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|.)", re.DOTALL)


def _unescaped(s: str) -> str:
    plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}
    return _ESCAPE.sub(lambda m: chr(int(m[1].strip("u{}"), 16)) if len(m[1]) > 1 else plain.get(m[1], m[1]), s)


def duration_ms(text: str) -> int:
    return sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)(ms|us|ns|[ywdhms])", text))


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at]!r} at {at}")
        kind, s = m.lastgroup, m[0]
        value: object = s
        if kind == "prefixed":
            kind, value = {"s": "string", "d": "datetime", "u": "uuid", "b": "bytes", "r": "record"}[s[0]], _unescaped(s[2:-1])
        elif kind == "string":
            value = _unescaped(s[1:-1])
        elif kind == "int":
            value = int(s.replace("_", ""))
        elif kind == "float":
            value = float(s.replace("_", "").rstrip("f"))
        elif kind == "decimal":
            value = Decimal(s.replace("_", "")[:-3])
        elif kind == "duration":
            value = duration_ms(s)
        elif kind in ("param", "quoted"):
            value = s[1:] if kind == "param" else s[1:-1]
        if kind != "skip":
            out.append(Token(kind, s, value, at, m.end()))
        at = m.end()
    out.append(Token("end", "", None, at, at))
    return out
