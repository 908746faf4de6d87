"""Parsers of list settings: extractors, tag lists, normalize rules, caps."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_EXTRACTORS, MAX_KEY, MAX_LIST, MAX_PATTERN, MAX_RULES, MAX_SEP = 16, 63, 1024, 1024, 32, 8
SPACE = " \t\n\r\f\v"
FORMATS = ("sqlcommenter", "marginalia", "regex")


@dataclass(frozen=True)
class Extractor:
    name: str  # sqlcommenter, marginalia or regex
    position: str = "append"
    merge: bool = False
    keys: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)
    url_decode: bool = True
    kv_sep: bytes = b":"
    pair_sep: bytes = b","
    pattern: str = ""
    appname: bool = False


@dataclass(frozen=True)
class Rule:
    key: str
    pattern: str
    replacement: str  # as written, for the reader

    def template(self) -> list[int | str]:
        """Literal text and group numbers (0 is the whole match)."""
        out: list[int | str] = []
        for m in re.finditer(r"\\([1-9&\\])|([^\\]+)|(\\.?)", self.replacement, re.DOTALL):
            if m[3] is not None:
                raise ValueError(f"unknown escape in replacement {self.replacement!r}")
            out.append(m[2] if m[2] is not None else "\\" if m[1] == "\\" else 0 if m[1] == "&" else int(m[1]))
        return out


def check_key(key: str) -> str:
    if not key or len(key.encode()) > MAX_KEY or any(c in SPACE for c in key):
        raise ValueError(f"invalid key {key!r}: keys have 1 to {MAX_KEY} bytes and no white space")
    return key


#: PostgreSQL escapes that differ here or are unknown.
_FOREIGN = re.compile(r"\\[mMyYcBZ]|\(\?[bceiklmnpqstwx]+\)|\[\[[.=]")


#: Escapes and bracket expressions, in which no character is an operator.
_QUOTED = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", re.DOTALL)


def compile_pattern(pattern: str, what: str = "pattern") -> re.Pattern:
    """A pattern of the common subset: no back-references, no constructs that
    only one dialect knows.  Of alternatives the longest match counts, not the
    first; beside non-greedy quantifiers they are rejected.  Which of several
    equally long matches fills the groups is left open."""
    if not 1 <= len(pattern.encode()) <= MAX_PATTERN:
        raise ValueError(f"{what} must have 1 to {MAX_PATTERN} bytes")
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern) or "(?P=" in pattern:
        raise ValueError(f"{what} uses a back-reference")
    flags = re.ASCII
    if m := re.match(r"\(\?([ins]+)\)", pattern):
        pattern = pattern[m.end() :]
        flags |= re.IGNORECASE if "i" in m[1] else 0
        flags |= re.MULTILINE if "n" in m[1] else 0
    elif _FOREIGN.search(pattern):
        raise ValueError(f"{what} uses a construct outside the common regex subset")
    pattern = re.sub(r"\[\[:(\w+):\]\]", lambda m: {"alpha": "[A-Za-z]", "digit": "[0-9]", "alnum": "[A-Za-z0-9]", "space": r"\s", "upper": "[A-Z]", "lower": "[a-z]"}.get(m[1], m[0]), pattern)
    if not flags & re.MULTILINE:  # a dot matches newlines and $ only the very end
        pattern, flags = re.sub(r"(?<!\\)\$(?=$|\))", r"\\Z", pattern), flags | re.DOTALL
    try:
        made = re.compile(pattern, flags)
    except re.error as e:
        raise ValueError(f"invalid {what}: {e}") from None
    bare = _QUOTED.sub("", pattern)
    if "|" not in bare:
        return made
    if re.search(r"[*+?}]\?", bare):
        raise ValueError(f"{what} has alternatives beside non-greedy quantifiers")
    import regex

    return regex.compile(pattern, int(flags) | regex.POSIX)


_TOKEN = re.compile(rf"[{SPACE}]*(?:('(?:[^']|'')*')|([,()=])|([^{SPACE},()='\"]+)|(.))", re.DOTALL)


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, depth = [], 0, 0
    text = text.rstrip(SPACE)
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None or m[4] is not None:
            raise ValueError(f"unexpected character at {text[at:]!r}")
        if m[1]:
            out.append(("q", m[1][1:-1].replace("''", "'")))
        elif m[2]:
            depth += (m[2] == "(") - (m[2] == ")")
            out.append(("p", m[2]))
        else:
            out.append(("w", m[3]))
        at = m.end()
        # an unquoted value may hold = (only the first one parts key and value)
        if out[-1] == ("p", "=") and (v := re.compile(rf"[{SPACE}]*([^{SPACE},()'\"]+)").match(text, at)):
            out.append(("w", v[1]))
            at = v.end()
    return out


def parse_extractors(text: str, max_tags: int = 8) -> tuple[Extractor, ...]:
    tokens, at, out = _tokens(text), 0, []

    def take(kind: str, value: str | None = None) -> str | None:
        nonlocal at
        if at < len(tokens) and tokens[at][0] in kind and value in (None, tokens[at][1]):
            at += 1
            return tokens[at - 1][1]
        return None

    while tokens:
        name = (take("w") or "").lower()
        if name not in (*FORMATS, "appname"):
            raise ValueError(f"unknown extractor {name!r}")
        params: dict[str, str] = {}
        if take("p", "("):
            while True:
                key = take("w")
                if key is None or not take("p", "="):
                    raise ValueError(f"parameter expected in {name}")
                value = take("wq")
                if not value:
                    raise ValueError(f"parameter {key} of {name} has no value")
                if key.lower() in params:
                    raise ValueError(f"parameter {key} occurs twice")
                params[key.lower()] = value
                if take("p", ")"):
                    break
                if not take("p", ","):
                    raise ValueError(f"malformed parameters of {name}")
        out.append(_extractor(name, params, max_tags))
        if at == len(tokens):
            break
        if not take("p", ","):
            raise ValueError("extractors are separated by commas")
        if at == len(tokens):
            raise ValueError("an extractor is missing after the last comma")
    if len(out) > MAX_EXTRACTORS:
        raise ValueError(f"more than {MAX_EXTRACTORS} extractors")
    return tuple(out)


def _extractor(name: str, params: dict[str, str], max_tags: int) -> Extractor:
    appname = name == "appname"
    if appname:
        name = params.pop("format", "").lower()
        if name not in FORMATS:
            raise ValueError("appname needs a format: sqlcommenter, marginalia or regex")
    allowed = {"keys", "merge", "rename"} | ({"position"} if not appname else set())
    allowed |= {"sqlcommenter": {"url_decode"}, "marginalia": {"kv_sep", "pair_sep"}, "regex": {"pattern"}}[name]
    for p in params:
        if p not in allowed:
            raise ValueError(f"{name} does not accept {p}")

    def choice(key: str, default: str, *values: str) -> str:
        got = params.get(key, default).lower()
        if got not in values:
            raise ValueError(f"{key} must be one of {', '.join(values)}")
        return got

    keys = tuple(check_key(k.strip(SPACE)) for k in params["keys"].split("|")) if "keys" in params else ()
    rename: dict[str, str] = {}
    for part in params["rename"].split("|") if "rename" in params else ():
        old, sep, new = part.partition(":")
        old, new = old.strip(SPACE), new.strip(SPACE)
        if not sep or old in rename:
            raise ValueError(f"malformed rename {part!r}")
        rename[check_key(old)] = check_key(new)
    kv, pair = params.get("kv_sep", ":").encode(), params.get("pair_sep", ",").encode()
    if not 1 <= len(kv) <= MAX_SEP or not 1 <= len(pair) <= MAX_SEP or pair in kv:
        raise ValueError("separators have 1 to 8 bytes, and kv_sep must not contain pair_sep")
    if name == "regex":
        if "pattern" not in params or not keys:
            raise ValueError("regex needs pattern and keys")
        groups = compile_pattern(params["pattern"]).groups
        if groups != len(keys) or groups > max_tags:
            raise ValueError(f"{groups} capture groups, {len(keys)} keys, max_tags {max_tags}")
    return Extractor(
        name, choice("position", "any" if name == "regex" else "append", "append", "prepend", "any"), choice("merge", "off", "on", "off") == "on",
        keys, rename, choice("url_decode", "on", "on", "off") == "on", kv, pair, params.get("pattern", ""), appname,
    )


def parse_tag_list(text: str, star: bool = False, limit: int = MAX_LIST) -> tuple[str, ...]:
    """Keys in order, without repeats; ``*`` only alone and where *star*."""
    out: dict[str, None] = {}
    for part in text.split(",") if text.strip(SPACE) else ():
        key = part.strip(SPACE)
        if key.startswith("'") and key.endswith("'") and len(key) > 1:
            key = key[1:-1].replace("''", "'")
        if key == "*" and star:
            if text.strip(SPACE) != part.strip(SPACE):
                raise ValueError("* must stand alone")
            return ("*",)
        if "*" in key:
            raise ValueError("* is not a key")
        out[check_key(key)] = None
    if len(out) > limit:
        raise ValueError(f"more than {limit} keys")
    return tuple(out)


_RULE = re.compile(rf"[{SPACE}]*('(?:[^']|'')+'|[^{SPACE},:'\"]+)[{SPACE}]*:[{SPACE}]*'((?:[^']|'')*)'[{SPACE}]*=>[{SPACE}]*'((?:[^']|'')*)'[{SPACE}]*(,|$)", re.DOTALL)


def parse_normalize(text: str) -> tuple[Rule, ...]:
    out, at = [], 0
    while text.strip(SPACE):
        m = _RULE.match(text, at)
        if not m:
            raise ValueError(f"malformed normalize rule at {text[at:]!r}")
        key = m[1][1:-1].replace("''", "'") if m[1].startswith("'") else m[1]
        rule = Rule(check_key(key), m[2].replace("''", "'"), m[3].replace("''", "'"))
        if len(rule.replacement.encode()) > MAX_PATTERN:
            raise ValueError("replacement is too long")
        groups = compile_pattern(rule.pattern).groups
        if any(isinstance(x, int) and x > groups for x in rule.template()):
            raise ValueError("replacement refers to a missing group")
        out.append(rule)
        at = m.end()
        if not m[4]:
            break
        if not text[at:].strip(SPACE):
            raise ValueError("a rule is missing after the last comma")
    if len(out) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return tuple(out)


def parse_caps(text: str) -> dict[str, int]:
    """``key:N`` pairs; the last colon parts key and number."""
    out: dict[str, int] = {}
    for part in text.split(",") if text.strip(SPACE) else ():
        key, sep, n = part.strip(SPACE).rpartition(":")
        key, n = key.strip(SPACE), n.strip(SPACE)
        if not sep or not n.isdigit() or int(n) > 1_000_000 or key in out:
            raise ValueError(f"malformed cap {part!r}")
        out[check_key(key)] = int(n)
    if len(out) > MAX_LIST:
        raise ValueError(f"more than {MAX_LIST} caps")
    return out


def parse_override(text: str) -> list[tuple[bytes, bytes]]:
    """Pairs of a session override, strict: any malformed segment raises."""
    from .pairs import sqlcommenter

    got = sqlcommenter(text.encode())
    if got.malformed or any(b"\0" in k or b"\0" in v for k, v in got.pairs):
        raise ValueError(f"malformed override {text!r}")
    return got.pairs
