"""Exact comment lexer for SQL text, on bytes.

One alternation finds the next construct that matters; literals are skipped by
patterns of their own.  The result is a list of tokens: block comments, line
comments, semicolons, and runs of anything else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_COMMENTS = 16
SPACES = b" \t\n\r\f\v"

_NEXT = re.compile(rb"[A-Za-z_\x80-\xff][A-Za-z0-9_$\x80-\xff]*|/\*|--|'|\"|\$|;|[^\sA-Za-z_\x80-\xff/\-'\"$;]+|[/\-]")
_TAG = re.compile(rb"\$(?:[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)?\$")
_LINE = re.compile(rb"--[^\n\r]*")
_EDGE = re.compile(rb"/\*|\*/")
_PLAIN = re.compile(rb"(?:[^']|'')*+'")
_ESCAPED = re.compile(rb"(?:[^'\\]|''|\\.)*+'", re.DOTALL)
_BITS = re.compile(rb"[^']*+'")
_NAME = re.compile(rb'(?:[^"]|"")*+"')
_MORE = re.compile(rb"(?:[ \t\f\v]|--[^\n\r]*)*+[\n\r](?:[ \t\n\r\f\v]|--[^\n\r]*[\n\r])*'")


@dataclass
class Tokens:
    """(kind, start, end): b block, l line, ; semicolon, t any other text."""

    items: list[tuple[str, int, int]] = field(default_factory=list)
    unterminated: bool = False


def block_end(s: bytes, at: int, end: int) -> int:
    """End of the block comment that starts at *at*, nesting included; -1 if none."""
    depth, i = 1, at + 2
    while m := _EDGE.search(s, i, end):
        depth += 1 if m[0] == b"/*" else -1
        i = m.end()
        if not depth:
            return i
    return -1


def _literal(s: bytes, at: int, end: int, body: re.Pattern, more: bool) -> int:
    """End of the string whose body starts at *at*, with its continuations."""
    while True:
        m = body.match(s, at, end)
        if not m:
            return -1
        at = m.end()
        again = _MORE.match(s, at, end) if more else None
        if not again:
            return at
        at = again.end()


def tokens(s: bytes, start: int, end: int, scs: bool = True) -> Tokens:
    out = Tokens()
    add, i = out.items.append, start
    while m := _NEXT.search(s, i, end):
        a, i, t = m.start(), m.end(), m[0]
        c = t[:1]
        if t == b"/*":
            i = block_end(s, a, end)
            if i < 0:
                break
            add(("b", a, i))
            continue
        if t == b"--":
            i = _LINE.match(s, a, end).end()
            add(("l", a, i))
            continue
        if t == b";":
            add((";", a, i))
            continue
        if t == b"'":
            i = _literal(s, i, end, _PLAIN if scs else _ESCAPED, True)
        elif t == b'"':
            i = _literal(s, i, end, _NAME, False)
        elif t == b"$":
            if d := _TAG.match(s, a, end):
                close = s.find(d[0], d.end(), end)
                i = close + len(d[0]) if close >= 0 else -1
            elif n := re.compile(rb"\$[0-9]+").match(s, a, end):
                i = n.end()
        elif len(t) == 1 and c in b"eEbBxXnN" and s[i : i + 1] == b"'" and i < end:
            body = _ESCAPED if c in b"eE" else _BITS if c in b"bBxX" else _PLAIN if scs else _ESCAPED
            i = _literal(s, i + 1, end, body, True)
        elif t in (b"u", b"U") and s[i : i + 2] in (b"&'", b'&"') and i + 1 < end:
            i = _literal(s, i + 2, end, _PLAIN if s[i + 1 : i + 2] == b"'" else _NAME, s[i + 1 : i + 2] == b"'")
        if i < 0:
            break
        add(("t", a, i))
    out.unterminated = i < 0
    if i < 0:  # the rest is swallowed
        add(("t", a, end))
    return out


@dataclass
class Scan:
    spans: list[tuple[int, int]] = field(default_factory=list)
    truncated: bool = False
    heuristic: bool = False


def scan_any(s: bytes, start: int, end: int, scs: bool, budget: int) -> Scan:
    """Every comment, up to 16 and *budget* bytes; none is cut."""
    out, used = Scan(), 0
    for kind, a, b in tokens(s, start, end, scs).items:
        if kind not in "bl":
            continue
        if len(out.spans) == MAX_COMMENTS or used + b - a > budget:
            out.truncated = True
            break
        used += b - a
        out.spans.append((a, b))
    return out


def _trailing(s: bytes, items: list[tuple[str, int, int]], loose: bool = False) -> Scan:
    """The trailing run of block comments (B11); *loose*: semicolons part them."""
    out, i = Scan(), len(items) - 1
    while i >= 0 and items[i][0] == ";":
        i -= 1
    while i >= 0 and (items[i][0] == "b" or loose and items[i][0] == ";"):
        if items[i][0] == "b":
            out.spans.append(items[i][1:])
        i -= 1
    out.spans.reverse()
    out.truncated = len(out.spans) > MAX_COMMENTS
    out.spans = out.spans[-MAX_COMMENTS:]
    return out


def _leading(items: list[tuple[str, int, int]], limit: int) -> Scan:
    """The leading run of comments, each ending by *limit*."""
    out, begun = Scan(), False
    for kind, a, b in items:
        if kind == ";" and not begun:
            continue
        if kind not in "bl" or b > limit:
            break
        begun = True
        if len(out.spans) == MAX_COMMENTS:
            out.truncated = True
            break
        out.spans.append((a, b))
    return out


def _tail(s: bytes, start: int, end: int, window: int) -> Scan:
    """Trailing comments of a long statement, from its last bytes alone."""
    out, low = Scan(heuristic=True), end - window
    at = end
    while at > low and s[at - 1 : at] in b"; \t\n\r\f\v":
        at -= 1
    found: list[tuple[int, int]] = []
    while len(found) <= MAX_COMMENTS and s[at - 2 : at] == b"*/" and at - 2 > low:
        depth, i = 1, at - 2
        while depth and i - 2 >= low:
            pair = s[i - 2 : i]
            if pair in (b"*/", b"/*"):
                depth += 1 if pair == b"*/" else -1
                i -= 2
            else:
                i -= 1
        if depth or block_end(s, i, at) != at or (i > start and s[i - 1 : i] == b"*"):
            break
        found.append((i, at))
        at = i
        while at > low and s[at - 1 : at] in SPACES and at > start:
            at -= 1
    found.reverse()
    good = False
    for k, (a, b) in enumerate(found):
        begin = found[k - 1][1] if k else low
        gap = s[begin:a]
        line = max(gap.rfind(b"\n"), gap.rfind(b"\r"))
        clean = b"--" not in gap[line + 1 :]
        good = good or (clean and (not k or line >= 0))
        if good:
            out.spans.append((a, b))
    out.truncated = len(out.spans) > MAX_COMMENTS
    out.spans = out.spans[-MAX_COMMENTS:]
    return out


def scan_statement(s: bytes, start: int, end: int, position: str, window: int, scs: bool = True) -> Scan:
    """Comments of a statement for an extractor's position."""
    if position == "any":
        return scan_any(s, start, end, scs, window)
    if position == "prepend":
        return _leading(tokens(s, start, min(end, start + window + 1), scs).items, start + window if end - start > window else end)
    if end - start > window:
        return _tail(s, start, end, window)
    return _trailing(s, tokens(s, start, end, scs).items)


def only_trivia(s: bytes, start: int, end: int) -> bool:
    got = tokens(s, start, end)
    return not got.unterminated and all(k != "t" for k, _, _ in got.items)


def scan_footer(s: bytes, stmt_end: int, position: str, window: int, scs: bool = True) -> Scan:
    """Comments after the last statement."""
    if len(s) - stmt_end > window or not only_trivia(s, stmt_end, len(s)):
        return Scan()
    items = tokens(s, stmt_end, len(s), scs).items
    if position == "append":
        return _trailing(s, items, loose=True)
    spans = [x[1:] for x in items if x[0] in "bl"]
    return Scan(spans[:MAX_COMMENTS], len(spans) > MAX_COMMENTS)


def stmt_range(s: bytes, location: int, length: int) -> tuple[int, int]:
    """Byte range of a statement."""
    if location < 0:
        return 0, len(s)
    return location, location + length if length > 0 else len(s)


def owned_start(s: bytes, since: int, stmt_start: int, limit: int, scs: bool = True) -> int:
    """Start of the text that a statement owns, back to the previous ;."""
    if since >= stmt_start or stmt_start - since > limit:
        return stmt_start
    got = tokens(s, since, stmt_start, scs)
    if got.unterminated:
        return stmt_start
    last = max((k for k, x in enumerate(got.items) if x[0] == ";"), default=-1)
    if any(x[0] == "t" for x in got.items[last + 1 :]) or (since > 0 and last < 0):
        return stmt_start
    return got.items[last][2] if last >= 0 else 0


def body(s: bytes, a: int, b: int) -> bytes:
    """A comment's text without its delimiters."""
    return s[a + 2 : b - 2] if s[a : a + 2] == b"/*" else s[a + 2 : b]
