"""Each operator on small fixtures, against brute force and in odd cases."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagmeter.llm import common, decontaminate, html, incidence, jaccard, language, lines, linking, mixing, quality, secrets, suffix, urls

from . import brute
from .conftest import LONG, clashing

SF = "/root/testdata/sf0.001"


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- shared parts ----
def test_window_hashes():
    h = common.word_hashes([b"a", b"b", b"c", b"d", b"b", b"a", b"c", b"d", b"a", b"b", b"c", b"d"])
    for n in (1, 2, 3, 5, 7, 8, 12):
        got = common.window_hashes(h, n)
        assert len(got) == len(h) - n + 1
        for i, j in itertools.combinations(range(len(got)), 2):
            assert (got[i] == got[j]) == (h[i : i + n] == h[j : j + n]).all()
    assert len(common.window_hashes(h, 13)) == 0


def test_scratch_keeps_what_is_read(spark):
    with common.scratch() as s:
        gone, kept = common.table(spark.range(3).toDF("x"), "gone"), s.keep(common.table(spark.range(4).toDF("x"), "kept"))
    assert kept.count() == 4
    with pytest.raises(Exception, match="(?i)not exist|no such|FILE_NOT_EXIST|PATH_NOT_FOUND|UNABLE"):
        spark.read.parquet(gone.kept_at).count()


def test_shared_keys_count_rows(spark):
    """Keys in two rows or more, in any pieces, with and without marks."""
    rng = random.Random(3)
    sets = {i: sorted({rng.randrange(60) for _ in range(rng.randrange(12))}) for i in range(80)}
    df = spark.createDataFrame([(i, ",".join(map(str, v))) for i, v in sets.items()], "id int, text string").repartition(7)

    def rows(piece):
        k, p = [], []
        for i, t in zip(piece.column("id").to_pylist(), piece.column("text").to_pylist(), strict=True):
            for x in t.split(",") if t else ():
                k.append(int(x) << 54)
                p.append(i)
        if not k:
            return None
        p = np.array(p, np.int64)
        return incidence.Rows(np.array(k, np.uint64), p, p, (bytes(str(sorted(set(p.tolist()))), "ascii"), b""))

    def then(got):
        return {"key": (got.key >> np.uint64(54)).astype(np.int64), "place": got.place.astype(np.int64), "count": got.count.astype(np.int64), "lead": got.lead}

    got = incidence.shared_keys(df, rows, then, "key long, place long, count long, lead boolean", 5).collect()
    have = {}
    for i, v in sets.items():
        for x in v:
            have.setdefault(x, set()).add(i)
    want = {(x, i, len(w)) for x, w in have.items() if len(w) > 1 for i in w}
    assert {(r["key"], r["place"], r["count"]) for r in got} == want and len(got) == len(want)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)] + [(i, i + 1) for i in range(20, 60)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r["id"][0]: r.component[0] for r in linking.components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {i: 20 for i in range(20, 61)}


@pytest.mark.parametrize("large,heavy,block,sparse", [(2, 10**6, 8, 2), (4, 10**6, 7, 16), (1000, 10**6, 1000, 16), (16, 20, 40, 3), (16, 0, 1000, 1000)])
def test_link_is_exact_for_its_buckets(spark, monkeypatch, large, heavy, block, sparse):
    """Near copies of a few bases, far enough apart that leaders often fail."""
    for name, value in (("LARGE", large), ("HEAVY", heavy), ("BLOCK", block), ("SPARSE", sparse), ("TOLD", 3 if heavy < 100 else 32)):
        monkeypatch.setattr(linking, name, value)
    rng = random.Random(large + block)
    sets = []
    for base in range(4):
        common_part = list(range(base * 100, base * 100 + 40))
        for _ in range(25):
            s = {x for x in common_part if rng.random() > 0.1} | {10_000 + rng.randrange(100_000) for _ in range(rng.randrange(4))}
            sets.append(np.array(sorted(s), np.uint64))
    name = lambda i: bytes([7] * 8 + [i] + [0] * 7)  # noqa: E731 (equal first halves)
    count = Counter(int(t) for s in sets for t in s)
    packed = []
    for i, s in enumerate(sets):
        got = linking.pack(s, linking.id_rows(name(i) * len(s)), np.full(len(s), len(s)), np.array([count[int(t)] for t in s]), 3)
        packed += zip(got["part"], got["key"], got["id"], got["n"], strict=True)
    buckets = spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in packed + packed[:9]], linking.PACKED)
    stored = spark.createDataFrame([(name(i), s.tobytes()) for i, s in enumerate(sets)], "id binary, set binary")
    found = {r["id"][8]: r.component[8] for r in linking.link(common.table(buckets, "b"), 3, stored, 75).collect()}
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        o = len(np.intersect1d(sets[i], sets[j]))
        if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    assert {i: found.get(i, i) for i in range(len(sets))} == {i: find(i) for i in range(len(sets))}


# ---- 1 ----
def test_quality(spark, odd):
    got = {r.doc_id: r for r in quality.apply_policy(quality.ledger(clashing(odd))).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[8].word_chars == 8
    assert got[4].n_repeat_words == got[4].n_words == 20_000
    for seed in range(20):
        w = [random.Random(seed + i * 31).choice("ab") for i in range(30)]
        assert quality.repeated_words([x.encode() for x in w]) == brute.repeated_words(w)
    assert quality.ledger(odd.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 16)], "doc_id long, fail_bits long")
    table = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(rows, "v2").collect()}
    assert table["few_words"] == (2, 1) and table["repeated_words"] == (1, 0) and table["symbols"] == (1, 1)


def test_quality_learns_toxic_terms(spark, docs):
    """Recall per language on documents that learning never saw."""
    d, l = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1")
    seen, bit = {}, quality.bits((quality.LEARNED, "toxic_words"))
    for fold in range(4):
        mine = F.expr("pmod(xxhash64(doc_id), 4)") == fold
        rest = d.join(l.where(mine), "doc_id")
        rows = quality.apply_policy(quality.ledger(rest, learned=quality.learn(d, l.where(~mine))), "v3")
        for r in rows.join(rest.select("doc_id", "lang", "toxic"), "doc_id").collect():
            seen.setdefault((r.lang, r.toxic), []).append(bool(r.fail_bits & bit))
            assert not (r.kept and r.fail_bits & bit)
    for lang in ("de", "en", "es", "fr"):
        assert np.mean(seen[lang, 1]) >= 0.75 and np.mean(seen[lang, 0]) <= 0.05
    none = quality.learn(d.limit(0), l)
    assert none.weights == {} and quality.ledger(docs((1, "a b")), learned=none).first().fail_bits & quality.bits((quality.LEARNED,)) == 0
    assert quality.learn(docs((None, None), (1, "x")), l.limit(0)).weights == {}
    rows = [(i, "vile word" if i < 4 else "fine word") for i in range(84)]
    told = spark.createDataFrame([(i, int(i < 4)) for i, _ in rows] + [(5, None), (None, 1), (0, 0), (900, 1)], "doc_id long, toxic int")
    got = quality.learn(clashing(docs(*rows, (0, "vile word"), (None, "vile"), (5, None))), told)
    # 4 of 4 toxic documents hold it and none of 80 clean ones
    assert got.weights == {"vile": round(1000 * math.log(160))} and got.least == got.weights["vile"]
    assert quality.learn(docs(*rows), told, max_docs=0).weights == {}


# ---- 2 ----
def fill(sizes, weights, share=1.5, repeat=2):
    """Targets by repeated resharing, in plain Python."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(repeat * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] > repeat * sizes[s]}
        if not over:
            return {s: repeat * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


def test_mixing(spark, docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), "en", rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(400)] + [(500, "w " * 900, "en", "z")]
    df = docs(*rows)
    got = mixing.plan(clashing(df).repartition(5)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, source = fill(sizes, mixing.WEIGHTS), {r[0]: r[3] for r in rows}
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum(p.words for p in r.passes)
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert {s: round(t) for s, t in want.items()} == {s: t for s, t in taken.items()} or all(abs(taken[s] - t) <= 1 for s, t in want.items())
    again = mixing.plan(df.orderBy(F.col("doc_id").desc())).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_mixing_positions(spark, docs):
    """A source that falls over time comes early, one that rises late, and
    positions follow the inverted integral of the schedule."""
    df = docs(*[(i, "w " * 10, "en", s) for i, s in enumerate(["a", "b", "c"] * 300)])
    planned = mixing.plan(df, keep=("source",))
    at, when, total = {}, {}, 0
    for r in mixing.sequence(planned).collect():
        at.setdefault(r.source, []).append(r.time)
        when.setdefault(r.source, []).append((r.time, r.words))
        # positions count the words of the stream
        assert r.position == pytest.approx(total + r.words / 2, abs=60)
        total += r.words
    assert at["a"] == sorted(at["a"]) and np.mean(at["a"]) < np.mean(at["b"]) < np.mean(at["c"])
    half = {s: np.mean(np.array(p) < 0.5) for s, p in at.items()}
    assert half["a"] == pytest.approx(0.625, abs=0.01) and half["b"] == pytest.approx(0.5, abs=0.01) and half["c"] == pytest.approx(0.375, abs=0.01)
    assert all(0 <= x <= 1 for p in at.values() for x in p)
    # in each tenth of the time a source gives what its schedule integrates to
    for i, s in enumerate("abc"):
        knots, words = mixing.SCHEDULES[i], sum(w for _, w in when[s])
        weight = lambda x, k=knots: np.interp(x, [t for t, _ in k], [f for _, f in k])
        whole = np.mean(weight(np.arange(0.0005, 1, 0.001)))
        for tenth in range(10):
            want = words * np.mean(weight(np.arange(tenth / 10 + 0.0005, tenth / 10 + 0.1, 0.001))) / 10 / whole
            got = sum(w for t, w in when[s] if tenth / 10 <= t < (tenth + 1) / 10)
            assert got == pytest.approx(want, abs=25)


def test_mixing_odd(odd):
    got = {r.doc_id: r for r in mixing.plan(odd).collect()}
    assert got[1]["size"] == 0 and got[1].taken == 0 and len(mixing.plan(odd).collect()) == odd.count()
    assert mixing.plan(odd.limit(0)).count() == 0 and mixing.plan(odd.where("doc_id < 3")).collect()[0].taken == 0


# ---- 3 ----
def test_decontaminate(spark, odd):
    d, b = read(spark, "documents"), read(spark, "benchmark")
    items = [tuple(r) for r in b.select("item_id", "text").collect()]
    want = sorted(brute.decontaminate(pairs_of(d), items))
    assert sorted(map(tuple, decontaminate.digest(clashing(d), b).collect())) == want
    small = decontaminate.scan(d, b, block_windows=50)
    assert sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"])) for r in small.collect()) == sorted(w[:4] for w in want)
    own = spark.createDataFrame([("a", "one"), ("b", "ONE."), ("b", None), (None, "one"), ("c", ""), ("d", "lorem ipsum dolor")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.digest(odd, own).collect()}
    assert got[5].n_items == 2 and got[5].contaminated and got[1].n_words == got[1].n_items == 0
    assert got[4].n_hit == 12_000 and got[4].n_items == 1 and got[1].items_sha256 == hashlib.sha256(b"").hexdigest()
    none = own.limit(0)
    assert decontaminate.digest(odd, none).where("n_hit > 0").count() == 0 and decontaminate.digest(odd.limit(0), own).count() == 0


@pytest.mark.parametrize("block", [500_000, 2])
def test_decontaminate_cuts(spark, docs, block):
    own = spark.createDataFrame([("x", "a1 b2 c3 d4 e5 f6 g7 h8 i9"), ("y", "q q q q")], "item_id string, text string")
    df = docs((1, "Start A1, b2; c3 d4 e5 f6 g7 h8 end"), (2, "a1 b2 c3 d4 e5 f6 g7 h8 Q q q q"), (3, "clean text"), (4, None))
    got = {r.doc_id: r for r in decontaminate.clean(clashing(df), own, block_windows=block).collect()}
    assert set(got) == {1, 3, 4} and got[1].text.split() == ["Start", "end"] and got[1].n_chars == len(got[1].text) and got[3].text == "clean text" and got[4].text is None


# ---- 4 ----
def test_secrets(spark, docs, odd):
    d = read(spark, "documents")
    for r in secrets.candidates(d).collect():
        pass
    got = {r.doc_id: r.base for r in secrets.scan(clashing(d)).collect()}
    for doc, text in pairs_of(d):
        assert got[doc] == ",".join(f"{k}:{a}:{b}" for a, k, b in brute.secret_spans(text))
    token, key = "Zq9XvTtR2LmWk81sPbYc", "password = hunter2secret"
    df = docs((1, f"é {key} und {token}", "en", "a"), (2, key, "en", "b"), (3, "passwd: abc token=abcdef AKIA" + "Z" * 16, "en", "a"), (4, "f" * 24 + " " + "0" * 23, "en", "a"))
    r = {x.doc_id: x for x in secrets.scan(df).collect()}
    assert r[1].spans == "assign:2:26,owned:31:51" and (r[1].n_live, r[1].n_example) == (1, 1) and r[2].n_example == 1
    assert (r[3].n_assign, r[3].n_access, r[3].n_hex) == (1, 1, 0) and (r[4].n_hex, r[4].base) == (1, "hex:0:24")
    both = docs(*[(i, f"x {token}", "en", s) for i, s in enumerate("ab")])
    assert all(x.spans == "" and x.n_example == 1 for x in secrets.scan(both).collect())
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(odd.limit(0)).count() == 0


def test_secret_owners_by_brute_force(spark, docs):
    """Owned spans and the counts of live and copied candidates, with values
    that repeat in a document, in documents of one owner and across owners."""
    rng = random.Random(8)
    token = lambda: "".join(rng.choice("abcXYZ0189_") for _ in range(22)) + "aA1"
    pool = [token() for _ in range(12)] + [f"password={token()}" for _ in range(6)] + ["AKIA" + "Q7" * 9, "0123456789abcdef" * 2]
    rows = [(i, " é ".join(rng.choice(pool[: 12 if i % 3 else 20]) for _ in range(rng.randrange(6))), "en", rng.choice(["a", "b", None]) if i % 2 else "c") for i in range(80)]
    want, owners = {}, {}
    for doc, text, _, owner in rows:
        base = brute.secret_spans(text)
        found = [(a, k, b, re.sub(r"^.*=", "", text[a:b]) if k == "assign" else text[a:b]) for a, k, b in base]
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text, re.ASCII):
            t = m[0]
            if re.search("[0-9]", t) and t != t.lower() and t != t.upper() and not any(x < m.end() and m.start() < y for x, _, y in base):
                found.append((m.start(), "owned", m.end(), t))
        want[doc] = found
        for x in found:
            owners.setdefault(x[3], set()).add(owner)
    for r in secrets.scan(docs(*rows)).collect():
        live = [x for x in want[r.doc_id] if len(owners[x[3]]) == 1]
        shown = sorted(x[:3] for x in want[r.doc_id] if x[1] != "owned" or x in live)
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, k, b in shown)
        assert (r.n_live, r.n_example) == (len(live), len(want[r.doc_id]) - len(live))


def test_secrets_by_brute_force():
    rng = random.Random(5)
    parts = ["password", "PASSWD", "api_key", "apikey", "token", "ſecret", "=", ":", " ", '"', "'", "abc", "abcdef1", "AKIA", "ABCDEFGH12345678", "0123456789abcdef01234567", "é", "\n", "="]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        base, _ = secrets.find(t.encode())
        at = secrets.code_points(t.encode(), [x for s in base for x in (s[0], s[2])])
        assert [(at[a], secrets.KINDS[k], at[b]) for a, k, b in base] == brute.secret_spans(t), t


# ---- 5 ----
@pytest.mark.parametrize("hot", [suffix.HOT, 0, 5])
def test_suffix(spark, docs, odd, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    d = read(spark, "documents")
    rows = suffix.repeated(clashing(d)).collect()
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in rows} == brute.passages(pairs_of(d))
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared, short = [word() for _ in range(60)], [word() for _ in range(49)]
    df = docs(*[(i, " ".join([*(word() for _ in range(rng.randrange(80))), *(shared if i % 2 else short), *(word() for _ in range(rng.randrange(80)))])) for i in range(20)])
    got = {r.doc_id: r for r in suffix.repeated(df).collect()}
    assert set(got) == {i for i in range(20) if i % 2} and all(sum(s.end - s.start for s in r.spans) == 60 for r in got.values())
    assert sum(not r.removed for r in got.values()) == 1  # one document keeps the passage
    clean = {r.doc_id: r.text for r in suffix.dedup(df).collect()}
    assert sum(shared[30] in t for t in clean.values()) == 1 and sum(short[30] in t for t in clean.values()) == 10
    assert {r.doc_id for r in suffix.repeated(odd).collect()} == set() and suffix.repeated(odd.limit(0)).count() == 0


def test_suffix_orders():
    """Common lengths and intervals of sorted word lists, by brute force."""
    rng = random.Random(9)
    lists = [[rng.choice(["a", "ab", "b", "é"]) for _ in range(rng.randrange(7))] for _ in range(60)]
    joined = [" ".join(x).encode() for x in lists]
    agree = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    assert all(suffix.common_words(joined[i], joined[j]) == agree(x, y) for i, x in enumerate(lists) for j, y in enumerate(lists))
    order, common_ = suffix._sorted(joined)
    for least in range(1, 7):
        where = suffix._intervals(order, common_, least)
        for i, j in itertools.combinations(range(len(lists)), 2):
            assert (where[i] == where[j]) == (agree(lists[i], lists[j]) >= least)


def test_suffix_repeated_rows(spark, monkeypatch):
    """Repeated rows, passages inside one document, few suffixes in a block,
    and a second run."""
    monkeypatch.setattr(suffix, "BLOCK_SUFFIXES", 20)
    d = read(spark, "documents").where("doc_id < 60")
    twice = d.unionByName(d.where("doc_id % 7 = 0")).unionByName(d.where("doc_id = 3").selectExpr("doc_id + 1000 as doc_id", "concat(text, ' ', text) as text", "lang", "source", "n_chars"))
    rows = suffix.repeated(twice.repartition(5)).collect()
    pairs = pairs_of(twice)
    want = brute.passages([(k, t) for k, (_, t) in enumerate(pairs)])
    assert sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in rows) == sorted((pairs[k][0], v) for k, v in want.items())
    again = suffix.repeated(twice).select("doc_id", "spans", "removed").collect()
    assert sorted(map(str, again)) == sorted(map(str, suffix.repeated(twice).select("doc_id", "spans", "removed").collect()))


# ---- 6 ----
@pytest.mark.parametrize("dense", [language.DENSE, 0])
def test_language_codes_are_exact(monkeypatch, dense):
    monkeypatch.setattr(language, "DENSE", dense)
    samples = {"aa": [b"abracadabra abra " * 30, b"banana"], "bb": [b"mississippi miss " * 30, b"xyz"]}
    m = language.Model(samples)
    for text in (b"abra", b"miss banana \xff!", b"", b"z" * 50, b"aa bb cc mississippi abra"):
        assert m.bits([b"pad", text])[1] == pytest.approx([brute.code_length(samples[k], text) for k in m.langs], rel=1e-5)


def test_language_windows(monkeypatch):
    """Texts longer than a window cost the same bits, in bounded memory."""
    samples = {"aa": [b"abracadabra abra " * 30, b"banana"], "bb": [b"mississippi miss " * 30, b"xyz"]}
    m = language.Model(samples)
    long = b"miss banana \xff abra " * 200_000
    tracemalloc.start()
    whole = m.bits([long, b"", b"abra"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * len(long)
    monkeypatch.setattr(language, "WINDOW", 7)
    for text in (b"abra", b"", b"miss ban", b"miss banana \xff!" * 4):
        assert m.bits([b"pad", text, b"z" * 15])[1] == pytest.approx([brute.code_length(samples[k], text) for k in m.langs], rel=1e-5)
    assert m.bits([long[: len(long) // 1000]])[0] * 1000 == pytest.approx(whole[0], rel=1e-3) and not whole[1].any()


def test_language_workers_get_few_rows(spark, docs, monkeypatch):
    """The texts of a split don't reach a worker at once, and the rows that
    stay don't pass through it."""
    told, rows = spark.conf.get(common._BATCH), []
    seen = lambda df, *_: rows.append(df.sparkSession.conf.get(common._BATCH)) or table(df, *_)
    table = common.table
    monkeypatch.setattr(common, "table", seen)
    d = read(spark, "documents").limit(200)
    kept = language.keep_known(d, language.train(d))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert rows == [str(language.JUDGED_ROWS)] and "MapInArrow" not in plan and spark.conf.get(common._BATCH) == told


def test_workers_give_memory_back(docs, monkeypatch):
    """At the end of a task, also of one that isn't read to its end."""
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1), raising=False)

    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    run = common.map_pieces(Frame(), lambda p: {"n": [len(p)]}, "n long")
    batch = pa.RecordBatch.from_pydict({"text": ["a", "b"]})
    assert [x.to_pydict() for x in run(iter([batch]))] == [{"n": [2]}] and calls == [1]
    part = run(iter([batch, batch]))
    next(part)
    part.close()
    assert calls == [1, 1]


def test_language_ties_and_long_rows(docs):
    """Ties go to the first language; a language whose one text is far beyond
    the bound is learned from its beginning."""
    df = docs(*[(i, "same words here", lang) for i, lang in ((0, "zz"), (1, "aa"), (2, "zz"), (3, "aa"), (6, "zz"), (7, "aa")) if not language.held_out(i)], (400, "unique letters " * 40_000, "long"), (401, None, "none"))
    assert not language.held_out(400)
    m = language.train(df, train_bytes=1000)
    assert m.langs == ["aa", "long", "zz"] and m.predict([b"same words"])[0] == ["aa"] and m.predict([b"unique letters"])[0] == ["long"]


def test_unknown_languages_go(spark, docs):
    m = language.train(read(spark, "documents", "/root/testdata/sf0.1"))
    finnish = "Olipa kerran kaukaisessa metsässä pieni mökki, jossa asui vanha nainen kissansa kanssa ja keitti joka aamu puuroa. " * 3
    df = docs((1, finnish), (2, "short words"), (3, "xq zvw kjq " * 40))
    assert [r.doc_id for r in language.keep_known(df, m).collect()] == [2]


def test_language(spark, docs, odd):
    d = read(spark, "documents", "/root/testdata/sf0.01")
    rows = d.select("doc_id", "lang").join(language.identify(clashing(d), language.train(d)), "doc_id").collect()
    held = [r for r in rows if language.held_out(r.doc_id)]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in language.identify(odd, language.train(d)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and got[1].score == 0 and got[8].lang_pred != "und"
    nothing = language.train(odd.where("lang is null"))
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}
    kept = language.keep_known(odd, language.train(d))
    assert kept.columns == odd.columns and {1, 2, 3, 7}.isdisjoint(r.doc_id for r in kept.collect())
    assert language.keep_known(clashing(d), language.train(d)).count() >= 0.99 * d.count()
    assert language.identify(odd.limit(0), nothing).count() == 0


def test_language_learns_only_from_its_folds(docs):
    ids = [i for i in range(200) if language.held_out(i)]
    df = docs(*[(i, "secret words", "xx") for i in ids[:5]], *[(i, "other words", "yy") for i in range(50) if not language.held_out(i)])
    assert language.train(df).langs == ["yy"]


# ---- 7 ----
def test_jaccard(spark, docs, odd):
    d = read(spark, "documents")
    got = jaccard.linked(clashing(d)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(brute.jaccard(pairs_of(d)))
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000, "a b"), (2001, "A b"), (2002, "a b c"), (2003, None), (2004, ""), (2005, "x"), (2006, LONG), (2007, LONG.upper())]
    df = docs(*rows)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked(df).collect())
    assert got == sorted(brute.jaccard(pairs_of(df)))
    kept = jaccard.keep_first(clashing(df))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, n, c in got if n} | {2003, 2004}) and kept.columns[:5] == df.columns
    assert jaccard.linked(odd).count() == odd.count() and jaccard.linked(odd.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in jaccard.keep_first(odd).collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]


# ---- 8 ----
def test_urls(spark):
    names = ["http://a.Example.ORG/es/x?y", "https://example.org/en/12", "http://x.org", "http://x.org/", "http://fr.com/fr/", "http://de.com/de/1#z", "ftp://spam-farm.example.net/q", "http://ok.example.net/q", None, "no scheme", "http://", "a://b://c/d", "http://notexample.org/es/"]
    df = spark.createDataFrame(list(enumerate(names)), "page_id int, url string")
    want = [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("x.org", "", None, "allow"), ("x.org", "/", "org/", "allow"), ("fr.com", "/fr/", "com/fr/", "allow"),
        ("de.com", "/de/1", "com/de/", "block"), ("spam-farm.example.net", "/q", None, "block"), ("ok.example.net", "/q", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("notexample.org", "/es/", "org/", "allow"),
    ]
    for bits in (urls.MAX_BITS, 1):
        got = urls.judge(clashing(df), max_bits=bits).orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in got] == want
    assert urls.judge(df.limit(0)).count() == 0
    assert sorted(r.verdict for r in urls.judge(df.unionByName(df)).collect()) == sorted([w[3] for w in want] * 2)
    long = spark.createDataFrame([(1, "http://h.example/" + "a/" * 1_000_000), (2, "http://" + "h." * 500 + "net")], "page_id int, url string")
    assert [len(r.path) for r in urls.judge(long).orderBy("page_id").collect()] == [2_000_001, 0]


@pytest.mark.parametrize("bits", [urls.MAX_BITS, 4000])
def test_a_list_of_hosts(spark, bits):
    """An entry holds for its host and all subdomains, in one shard or many."""
    names = [f"{s}h{i}.example{i % 3}.net" for i in range(1500) for s in ("", "www.")]
    df = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(names)], "page_id int, url string")
    entries = [f"h{i}.example{i % 3}.net" for i in range(0, 1500, 4)] + ["www.H1.example1.net", "unseen.net", "", None, "h0.example0.net", "xample2.net"]
    listed = spark.createDataFrame([(e,) for e in entries], "host string")
    got = {r.page_id: r.verdict for r in urls.judge(df, listed, max_bits=bits).collect()}
    low = {e.lower() for e in entries if e}
    assert got == {i: "block" if any(h == e or h.endswith("." + e) for e in low if len(e) > 3) else "allow" for i, h in enumerate(names)}


def test_cascade_is_exact(spark):
    keys = [(f"host{i}.example", i % 7 == 0) for i in range(5000)]
    universe = spark.createDataFrame(keys, "key string, listed boolean").repartition(4)
    c = urls.build(universe, bits_per_key=3)  # few bits, so that several levels are needed
    assert len(c.levels) > 3 and c.members([k for k, _ in keys]).tolist() == [x for _, x in keys]


# ---- 9 ----
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=x>Home</a> Site name and slogan</header>
<nav><ul><li><a>menu</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, please accept them all now.</div><script>var t="</p>";</script>
<article><h1>The &amp; title</h1><p><b>First   par&#39;s
text.<br>More<p>Short.</p><aside>side</aside><form>Sign <input> up</form><div class="ad">Buy</div><ul><li>one</li><li>two</li></ul></article>
<section id="comments"><p>reader says something long enough to count as text in a window of lines</p></section><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    assert html.extract(PAGE) == "The & title\nFirst par's text. More\nShort.\none\ntwo"
    assert html.extract(None) == html.extract("") == html.extract("<p></p>") == ""
    plain = "<div><a>a</a><a>b</a></div><p>" + "word " * 30 + "</p><p>tail</p><div class=footer>" + "foot " * 40 + "</div>"
    assert html.extract(plain) == ("word " * 30).strip() + "\ntail"
    assert html.extract("<article>a &lt;b&gt; <i>c</i>d <!-- x --> e</article") == "a <b> cd e"
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", "<article>" + "x" * 500_000 + "</article>")], "page_id int, url string, html string")
    got = {r.page_id: r for r in html.extract_text(clashing(df)).collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[3].n_chars == 500_000 and html.extract_text(df.limit(0)).count() == 0
    pages = read(spark, "pages")
    assert html.extract_text(pages).where("n_chars = 0").count() == 0


def test_html_after_the_first_surge():
    """In a page without marked content, short lines after weightless ones."""
    long, advert, link = "<p>" + "word " * 30 + "</p>", "<div class=ad>" + "Buy this now. " * 9 + "</div>", "<p><a href=x>share</a></p>"
    page = "<p>menu</p>" + advert * 3 + long + advert * 3 + "<h2>Part</h2>" + link * 4 + "<p>The end.</p>" + advert * 3
    assert html.extract(page) == ("word " * 30).strip() + "\nPart\nThe end."


def test_html_without_end_tags():
    body = "<body><article><p>One.</p><p>Two.</p></article></body></html>"
    for head in ("<head><title>T</title><meta charset=utf-8>", "<head id=header><title>T</title><style>p{}</style><script>1</script>", "<HEAD/><title>T</title>"):
        assert html.extract("<html>" + head + body) == "One.\nTwo."
    for tag in ("svg-icon", "select-box", "template-part x=1", "object-view"):
        assert html.extract(f"<article><p>One.</p><{tag}></{tag.split()[0]}><p>Two.</p></article>") == "One.\nTwo."
    for tag in ("svg", "select", "noscript", "iframe src=x", "template", "textarea", "object", "math"):
        assert html.extract(f"<article><p>One.</p><{tag}><p>Two.</p></article>") == "One.\nTwo."
        if tag in ("svg", "math"):  # their text belongs to the sentence around
            continue
        assert html.extract(f"<article><p>One.</p><{tag}>no text</{tag.split()[0]} ><p>Two.</p></article>") == "One.\nTwo."
    assert html.extract("<article><p>One.</p><script>var x = '<p>no</p>';") == html.extract("<article><p>One.</p><style>p{}<p>no</p>") == "One."
    assert html.extract("<article>" + "<select>x " * 50_000 + "</article>") == ("x " * 50_000).strip()


# ---- 10 ----
def test_lines(spark, docs, odd):
    d = read(spark, "documents").where("doc_id < 150")
    got = {r.doc_id: [] for r in d.collect()}
    for r in lines.repeats(clashing(d)).collect():
        got[r.doc_id].append(r.line)
    assert {k: sorted(v) for k, v in got.items() if v} == brute.lines(pairs_of(d))
    df = docs((1, "The quick brown fox jumps over the lazy dog\nshort\nthe quick  brown fox JUMPS over the lazy dog"), (2, "short\nThe quick brown fox jumped over the lazy dog!\nsomething else entirely, and long"), (3, "the quick brown fox jumps over the lazy dog"), (4, None))
    out = {r.doc_id: r for r in lines.dedup(clashing(df)).collect()}
    assert out[1].text == "The quick brown fox jumps over the lazy dog\nshort" and out[1].n_chars == len(out[1].text) and 3 not in out and out[4].text is None
    assert lines.repeats(odd).count() == 0 and lines.dedup(odd).count() == odd.count() and lines.dedup(odd.limit(0)).count() == 0


def test_short_lines(spark, docs):
    """Exact copies go at any length, near ones from SHINGLE code points on."""
    df = docs((1, "Is\nSee chapter ten\n\n}\nêtre là, ici\nabcdefgh"), (2, "is \nSee chapter ten.\n\nit\n}\nabcdefg"), (3, "}\n IS\nÊtre là\nêtre  là, ici\nabcdefgi\nabcdefg"))
    got = {r.doc_id: r for r in lines.judged(clashing(df))[0].collect()}
    assert [got[i].n_lines for i in (1, 2, 3)] == [5, 5, 6]
    gone = {r.doc_id: r.gone for r in lines.by_document(lines.repeats(clashing(df))).collect()}
    assert gone == {2: [0, 1, 4], 3: [0, 1, 3, 5]} == brute.lines(pairs_of(df))
    assert {r.doc_id: r.text for r in lines.dedup(df).collect()} == {1: df.first().text, 2: "\nit\nabcdefg", 3: "Être là\nabcdefgi"}


@pytest.mark.parametrize("n", [20, 30, 45, 120, 400])
def test_line_signatures_recall(n):
    """Pairs a little above the similarity share a band nearly always."""
    rng = random.Random(n)
    met = total = 0
    tries = 0
    while total < 150 and tries < 20_000:
        tries += 1
        x = "".join(rng.choice("abcdefghé ") for _ in range(n))
        y = list(x)
        for _ in range(rng.randrange(1, 2 + n // 40)):
            y[rng.randrange(n) if n > 45 else rng.choice([0, 1, 2, n - 1])] = rng.choice("zЖ")
        x, y = x.strip(), "".join(y).strip()
        a, b = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (x, y))
        if not 0.75 <= len(a & b) / len(a | b) <= (0.78 if n > 100 else 0.9):
            continue
        value, row = lines.signatures(*lines.shingles([x.encode(), y.encode()]))
        total += 1
        met += bool(set(value[row == 0].ravel().tolist()) & set(value[row == 1].ravel().tolist()))
    assert total > 50 and met / total > 0.98


def test_shingles_do_not_depend_on_the_lines_around():
    lines_ = ["plain words here", "café crème brûlée", "смешанный text и café", "日本語のテキストです", "short", "x" * 30]
    alone = [lines.shingles_of([t.encode()])[0].tolist() if len(t) >= 8 else [] for t in lines_]
    together, size = lines.shingles_of([t.encode() for t in lines_ if len(t) >= 8])
    assert together.tolist() == sum(alone, []) and size.tolist() == [len(a) for a in alone if a]
    codes = {t[i : i + 8]: h for t, a in zip(lines_, alone, strict=True) for i, h in enumerate(a)}
    assert len(set(codes.values())) == len(codes)


@pytest.mark.parametrize("rows", [0, 10**9])
def test_small_sides_do_not_change_results(spark, monkeypatch, rows):
    """Operators 7 and 10 with every side broadcast, and with none."""
    for m in (common, linking):
        monkeypatch.setattr(m, "SMALL_ROWS", rows)
    d = read(spark, "documents").where("doc_id < 120")
    assert sorted(tuple(r) for r in jaccard.linked(d).select("doc_id", "n_shingles", "component_id").collect()) == sorted(brute.jaccard(pairs_of(d)))
    gone = {r.doc_id: r.gone for r in lines.by_document(lines.repeats(d)).collect()}
    assert gone == brute.lines(pairs_of(d))
