"""The tag pipeline on one statement, exact (C6-C10, D-1 to D-9, D-11 to D-13)."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

from . import dsl, lexer, pairs
from .dsl import Extractor

MAX_KEY, MAX_EXEMPLAR = 63, 256
_pattern = lru_cache(maxsize=256)(dsl.compile_pattern)


@dataclass
class Result:
    tags: dict[str, str | None] = field(default_factory=dict)
    exemplars: dict[str, str] = field(default_factory=dict)
    candidates: list[tuple[str, str]] = field(default_factory=list)
    footer: bool = False
    heuristic: bool = False
    counts: dict[str, int] = field(default_factory=dict)
    stmt_start: int = 0
    stmt_end: int = 0

    def add(self, what: str, n: int = 1) -> None:
        if n:
            self.counts[what] = self.counts.get(what, 0) + n


def clip(value: bytes, n: int) -> bytes:
    """At most *n* bytes, cut at a character boundary (D-7)."""
    if len(value) <= n:
        return value
    while n and value[n] & 0xC0 == 0x80:
        n -= 1
    return value[:n]


def replace_all(value: str, rule: dsl.Rule, limit: int) -> str:
    """Every match replaced; output stops at *limit* bytes (D-6b)."""
    template, out, at, size = rule.template(), [], 0, 0
    for m in _pattern(rule.pattern).finditer(value):
        made = value[at : m.start()] + "".join(x if isinstance(x, str) else m[x] or "" for x in template)
        out.append(made)
        size += len(made.encode())
        at = m.end()
        if size >= limit:
            return clip("".join(out).encode(), limit).decode()
    return clip(("".join(out) + value[at:]).encode(), limit).decode() if out else value


def escape(raw: bytes) -> str:
    """Text of bytes that aren't UTF-8: \\xHH, and a doubled backslash (D-11)."""
    return "".join(chr(b) if 32 <= b < 127 and b != 92 else "\\\\" if b == 92 else f"\\x{b:02x}" for b in raw)


def tagset_size(tags: dict[str, str | None]) -> int:
    return sum(len(k.encode()) + 1 + (2 if v is None else len(v.encode()) + 1) for k, v in tags.items())


def to_json(tags: dict[str, str | None]) -> str:
    """Canonical text of a tag set: keys in byte order, null for a capped value (D-12)."""
    return json.dumps(dict(sorted(tags.items(), key=lambda t: t[0].encode())), ensure_ascii=False, separators=(",", ":"))


class Pipeline:
    """Compiled settings."""

    def __init__(self, settings) -> None:
        self.s = settings
        p = settings.parsed
        self.comment = [e for e in p["extractors"] if not e.appname]
        self.appname = [e for e in p["extractors"] if e.appname]
        self.star = p["tags"] == ("*",)
        self.allow = {k: i for i, k in enumerate(p["tags"])}
        self.deny = frozenset(p["exclude"])
        self.rules: dict[str, list[dsl.Rule]] = {}
        for r in p["normalize"]:
            self.rules.setdefault(r.key, []).append(r)
        self.exemplar_keys = frozenset(p["exemplars"])
        self.exemplar_max = min(MAX_EXEMPLAR, settings.exemplar_value_bytes)
        self.override_rename: dict[str, str] = {}
        for e in self.comment:
            if e.name == "sqlcommenter":
                for old, new in e.rename.items():
                    self.override_rename.setdefault(old, new)

    def _pair(self, out: Result, key: bytes, value: bytes, keys, rename: dict[str, str], seen: set[str], found: list) -> None:
        """Steps 2 to 7 of one pair; a tag that stays goes to *found*."""
        try:
            k, v = key.decode(), value.decode()
        except UnicodeDecodeError:
            out.add("invalid_tags")
            return
        if not k or "\0" in k or "\0" in v:
            out.add("invalid_tags")
            return
        if keys and k not in keys:
            return
        k = rename.get(k, k)
        if k in self.exemplar_keys and k not in out.exemplars:
            if len(v.encode()) <= self.exemplar_max:
                out.exemplars[k] = v
            else:
                out.add("exemplar_values_dropped")
        if self.star:
            if k in self.deny:
                return
            if len(k.encode()) > MAX_KEY:
                out.add("invalid_tags")
                return
        elif k not in self.allow:
            return
        if k in seen:  # the first occurrence decides
            return
        seen.add(k)
        if k in self.rules:
            new = v
            for rule in self.rules[k]:
                try:
                    new = replace_all(new, rule, max(len(new.encode()), self.s.max_tag_value_len))
                except (re.error, RecursionError):
                    out.add("normalize_failures")
                    return
            out.add("normalized_tags", int(new != v))
            v = new
        found.append((k, clip(v.encode(), self.s.max_tag_value_len).decode()))

    def _parse(self, e: Extractor, text: bytes) -> pairs.Pairs:
        if e.name == "sqlcommenter":
            return pairs.sqlcommenter(text, e.url_decode)
        if e.name == "marginalia":
            return pairs.marginalia(text, e.kv_sep, e.pair_sep)
        return pairs.regex(text, _pattern(e.pattern), e.keys)

    def _chain(self, out: Result, extractors: list[Extractor], bodies) -> list[tuple[str, str]]:
        """The first extractor that produces wins; later ones only merge."""
        found: list[tuple[str, str]] = []
        seen: set[str] = set()
        produced = False
        for e in extractors:
            if produced and not e.merge:
                continue
            for text in bodies(e):
                got = self._parse(e, text)
                if got.pairs:
                    out.add("invalid_tags", got.malformed)
                before = len(found)
                for k, v in got.pairs:
                    self._pair(out, k, v, e.keys if e.name != "regex" else (), e.rename, seen, found)
                produced = produced or len(found) > before
        return found

    def extract(self, query: bytes, location: int = -1, length: int = 0, scs: bool = True, appname: bytes | None = None, override: bytes | None = None, cap=None, since: int = 0) -> Result:
        out = Result()
        start, end = lexer.stmt_range(query, location, length)
        start = lexer.owned_start(query, since, start, self.s.scan_window, scs)
        out.stmt_start, out.stmt_end = start, end
        found: list[tuple[str, str]] = []
        if override:
            seen: set[str] = set()
            for k, v in pairs.sqlcommenter(override).pairs:
                self._pair(out, k, v, (), self.override_rename, seen, found)
        own: list[tuple[str, str]] = []
        if b"/*" in query or b"--" in query:
            scans: dict = {}

            def bodies(e: Extractor, footer: bool = False):
                key = (footer, e.position)
                if key not in scans:
                    scan = lexer.scan_footer(query, end, e.position, self.s.scan_window, scs) if footer else lexer.scan_statement(query, start, end, e.position, self.s.scan_window, scs)
                    scans[key] = [lexer.body(query, a, b) for a, b in scan.spans]
                    if scan.heuristic:
                        out.heuristic = True
                        out.add("heuristic_scans")
                return scans[key]

            own = self._chain(out, self.comment, bodies)
            if not own and end < len(query):
                own = self._chain(out, self.comment, lambda e: bodies(e, True))
                out.footer = bool(own)
        found += own
        if appname and self.appname:
            found += self._chain(out, self.appname, lambda e: [appname])
        out.candidates = self.first(found)
        self.place(out, cap)
        return out

    @staticmethod
    def first(found: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """The first value of each key."""
        seen: dict[str, str] = {}
        for k, v in found:
            seen.setdefault(k, v)
        return list(seen.items())

    def place(self, out: Result, cap=None) -> None:
        """Caps and the greedy fill by priority (D-8, D-9).

        *cap*(key, value, admit) tells whether a value may be kept; only tags
        that fit are admitted, and a value over its cap is kept as null.
        """
        order = sorted(out.candidates, key=lambda t: t[0].encode() if self.star else self.allow[t[0]])
        used, tags = 0, {}
        for k, v in order:
            key = len(k.encode()) + 1
            whole = key + len(v.encode()) + 1
            room = self.s.max_tagset_bytes - used
            if len(tags) >= self.s.max_tags:
                out.add("dropped_tags")
                continue
            value: str | None = v
            if cap and not cap(k, v, whole <= room):
                value, whole = None, key + 2
            if whole > room:
                out.add("dropped_tags")
                continue
            if value is None:
                out.add("capped_tags")
                out.add("cap_table_full", int(getattr(cap, "was_full", False)))
            tags[k] = value
            used += whole
        out.tags = dict(sorted(tags.items(), key=lambda t: t[0].encode()))

    def diagnostics(self, r: Result) -> dict:
        """The debug function's result (D-13)."""
        c = r.counts.get
        return {
            "tags": r.tags, "ntags": len(r.tags), "tagset_bytes": tagset_size(r.tags), "footer": r.footer, "heuristic": r.heuristic, "oom": False,
            "stmt_start": r.stmt_start, "stmt_end": r.stmt_end, "invalid_tags": c("invalid_tags", 0), "dropped_tags": c("dropped_tags", 0),
            "heuristic_scans": c("heuristic_scans", 0), "normalized_tags": c("normalized_tags", 0), "normalize_failures": c("normalize_failures", 0),
            "regex_compile_failures": 0, "capped_tags": c("capped_tags", 0),
        }
