"""Plain forms of the operators, which tests hold them against."""

import hashlib
import math
import re
from collections import Counter

from tagmeter.llm.decontaminate import NGRAM, words_of
from tagmeter.llm.lines import SHINGLE
from tagmeter.llm.secrets import ASSIGN, KINDS, MIN_ACCESS, MIN_ASSIGN, MIN_HEX
from tagmeter.llm.suffix import LENGTH


def jaccard(docs: list[tuple], n: int = 5, percent: int = 75) -> list[tuple]:
    """Plain form: (doc_id, n_shingles, component_id)."""
    sets = []
    for _, text in docs:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), math.inf), doc)
    return [(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(docs)]


def lines(docs: list[tuple], percent: int = 75) -> dict:
    """Plain form: line numbers that go, by doc_id (ids unique).
    It splits and folds lines on its own."""
    seen = []
    for doc, text in sorted(docs):
        for k, raw in enumerate((text or "").split("\n")):
            line = re.sub(r"[ \t\v\f\r]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), raw)).strip(" ")
            if line:
                seen.append((doc, k, line))
    sets = {line: {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)} for _, _, line in seen}
    distinct = list(sets)
    root = {x: x for x in distinct}

    def find(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    kept: set[str] = set()
    out: dict = {}
    for doc, k, line in seen:
        if find(line) in kept:
            out.setdefault(doc, []).append(k)
        kept.add(find(line))
    return out


def passages(docs: list[tuple]) -> dict:
    """Plain form of the spans: {doc_id: [(start, end)]}."""
    where: dict[tuple, set] = {}
    words = {doc: [w for w in (text or "").encode().lower().split()] for doc, text in docs}
    for doc, w in words.items():
        for i in range(len(w) - LENGTH + 1):
            where.setdefault(tuple(w[i : i + LENGTH]), set()).add(doc)
    out = {}
    for doc, w in words.items():
        hit = sorted({i + j for i in range(len(w) - LENGTH + 1) if len(where[tuple(w[i : i + LENGTH])]) > 1 for j in range(LENGTH)})
        runs: list[list[int]] = []
        for p in hit:
            if runs and runs[-1][1] == p:
                runs[-1][1] = p + 1
            else:
                runs.append([p, p + 1])
        if runs:
            out[doc] = [tuple(r) for r in runs]
    return out


def decontaminate(docs: list[tuple], items: list[tuple], n: int = NGRAM) -> list[tuple]:
    """Plain form of the digest."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = words_of((text or "").encode())
        m = min(n, len(w))
        for i in range(len(w) - m + 1) if w else ():
            windows.setdefault(tuple(w[i : i + m]), set()).update([] if item is None else [str(item)])
    out = []
    for doc, text in docs:
        w, hit, who = words_of((text or "").encode()), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if (got := windows.get(tuple(w[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    who |= got
        out.append((doc, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), len(who) >= 2))
    return out


def secret_spans(text: str | None) -> list[tuple[int, str, int]]:
    """Base spans by plain patterns on code points."""
    t, out = text or "", []
    for m in re.finditer(ASSIGN.pattern.decode(), t, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= MIN_ASSIGN:
            out.append((m.start(), "assign", m.end()))
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= MIN_HEX]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def code_length(model_samples: list[bytes], text: bytes, order: int = 3) -> float:
    """Code length by dictionaries, one byte at a time."""
    counts: dict[bytes, dict[int, int]] = {}
    run = b"   " + b"   ".join(model_samples)
    for i in range(3, len(run)):
        for k in range(order + 1):
            seen = counts.setdefault(run[i - k : i], {})
            seen[run[i]] = seen.get(run[i], 0) + 1
    total, padded = 0.0, b"   " + text
    for i in range(3, len(padded)):
        bits, b = 0.0, padded[i]
        for k in range(order, -1, -1):
            seen = counts.get(padded[i - k : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if b in seen:
                bits -= math.log2(seen[b] / whole)
                break
            bits -= math.log2(len(seen) / whole)
        else:
            bits += 8
        total += bits
    return total


def repeated_words(words: list) -> int:
    """Plain form of repeated_words."""
    count = Counter(zip(words, words[1:], words[2:], strict=False))
    return len({i + j for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if count[g] > 1 for j in range(3)})
