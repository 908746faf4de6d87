"""Parsers from comment bodies to raw pairs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SPACES = b" \t\n\r\f\v"
_SPACE = re.compile(rb"[ \t\n\r\f\v]")
_VALUE = re.compile(rb"[ \t\n\r\f\v]*'((?:\\['\\]|[^'])*+)'", re.DOTALL)
_ESCAPE = re.compile(rb"\\(['\\])")
_PERCENT = re.compile(rb"%([0-9A-Fa-f]{2})")


@dataclass
class Pairs:
    pairs: list[tuple[bytes, bytes]] = field(default_factory=list)
    malformed: int = 0


def decode(raw: bytes, url: bool = True) -> bytes:
    """Backslash escapes, then + and %XX; a bad % stays as it is."""
    raw = _ESCAPE.sub(rb"\1", raw)
    return _PERCENT.sub(lambda m: bytes([int(m[1], 16)]), raw.replace(b"+", b" ")) if url else raw


def sqlcommenter(text: bytes, url: bool = True) -> Pairs:
    out, at, n = Pairs(), 0, len(text)

    def after(i: int) -> int:
        comma = text.find(b",", i)
        return n if comma < 0 else comma + 1

    while at < n:
        stop = text.find(b",", at)
        stop = n if stop < 0 else stop
        if not text[at:stop].strip(SPACES):
            at = stop + 1
            continue
        equals = text.find(b"=", at)
        if equals < 0 or equals > stop:
            out.malformed += 1
            at = stop + 1
            continue
        key = text[at:equals].strip(SPACES)
        m = _VALUE.match(text, equals + 1)
        if not m:
            # without a closing quote, go on after the comma that follows the opening one
            out.malformed += 1
            opening = text.find(b"'", equals)
            unquoted = text[equals + 1 : opening].strip(SPACES) if opening >= 0 else b"x"
            at = after(equals + 1) if unquoted else after(opening + 1)
            continue
        end = m.end()
        comma = after(end)
        tail = text[end : comma - 1 if comma <= n and text[comma - 1 : comma] == b"," else n]
        if tail.strip(SPACES) or not key or _SPACE.search(key):
            out.malformed += 1
        else:
            out.pairs.append((decode(key, url), decode(m[1], url)))
        at = comma
    return out


def marginalia(text: bytes, kv: bytes = b":", pair: bytes = b",") -> Pairs:
    out = Pairs()
    for segment in text.split(pair):
        if not segment.strip(SPACES):
            continue
        key, sep, value = segment.partition(kv)
        key = key.strip(SPACES)
        if not sep or not key or _SPACE.search(key):
            out.malformed += 1
        else:
            out.pairs.append((key, value.strip(SPACES)))
    return out


def regex(text: bytes, pattern: re.Pattern, keys: tuple[str, ...]) -> Pairs:
    """All matches; the first value of a key comes first.  Unmatched groups give nothing."""
    out = Pairs()
    for m in pattern.finditer(text.decode("utf-8", "surrogateescape")):
        for i, key in enumerate(keys, 1):
            if m[i] is not None:
                out.pairs.append((key.encode(), m[i].encode("utf-8", "surrogateescape")))
    return out
