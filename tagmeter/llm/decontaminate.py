"""Operator 3, benchmark decontamination.

The benchmark's n-grams of normalised words go out as a broadcast hash set;
each worker slides over the words of whole training texts, looks windows up
by a 64-bit hash and verifies every hit word by word.  Then spans or whole
documents are removed.

A broadcast holds at most ``block_windows`` windows.  A larger benchmark is
scanned in blocks, one pass over the documents for each, and the hits of the
passes are merged by document, so the result is the same at any size.

Defined cases: a null or wordless text has no words, no hits and no items; a
benchmark row without words is ignored; one without an item_id hits words, but
is no item; rows that share an item_id are one item; repeated document rows are each judged.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pieces, mix64, table, texts

NGRAM = 8
#: Windows in a broadcast: about 200 bytes each in a worker.
BLOCK_WINDOWS = 500_000

#: A-Z to lower case; ASCII that is neither a letter nor a digit to a space.
FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """A hash set of word windows, each with the items that hold it."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int) -> None:
        self.ids: dict[bytes, int] = {}
        self.by_text: dict[bytes, tuple[str, ...]] = {}
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, words in items:
            m = min(n, len(words))
            for i in range(len(words) - m + 1):
                found.setdefault(tuple(words[i : i + m]), set()).update([] if item is None else [item])
        for window, who in found.items():
            for w in window:
                self.ids.setdefault(w, len(self.ids))
            self.by_text[b" ".join(window)] = tuple(sorted(who))
        self.hashes = {}
        for m in {len(w) for w in found}:
            codes = np.array([[self.ids[x] for x in w] for w in found if len(w) == m], np.int64)
            self.hashes[m] = np.unique(self._hash(codes))
        self.sieve = {m: self._sieve(h) for m, h in self.hashes.items()}

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[:, j].astype(np.uint64) + np.uint64(1)
        return mix64(out)

    @staticmethod
    def _sieve(hashes: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 20, bool)
        bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
        return bits

    def hits(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(start, end, items) of every window that occurs in *words*."""
        if not self.by_text:
            return []
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known, out = codes >= 0, []
        for m, hashes in self.hashes.items():
            if len(words) < m:
                continue
            total = np.concatenate(([0], np.cumsum(known)))
            at = np.flatnonzero(total[m:] - total[:-m] == m)
            if not len(at):
                continue
            h = self._hash(codes[at[:, None] + np.arange(m)])
            maybe = self.sieve[m][(h >> np.uint64(44)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in at[hashes[where] == h].tolist():
                who = self.by_text.get(b" ".join(words[i : i + m]))
                if who is not None:
                    out.append((i, i + m, who))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, n: int, limit: int):
    """The items, in blocks of at most *limit* windows.

    Rows come partition by partition, so the driver holds a block and a
    partition of the benchmark, never all of a large one.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    block: list[tuple[str | None, list[bytes]]] = []
    held = 0
    for row in rows.toLocalIterator():
        words = words_of(row.text.encode())
        # an item of more windows comes in parts that share n - 1 words
        for begin in range(0, max(1, len(words) - n + 1) if words else 0, limit):
            part = words[begin : begin + limit + n - 1]
            many = max(1, len(part) - n + 1)
            if block and held + many > limit:
                yield block
                block, held = [], 0
            block.append((row.item, part))
            held += many
    yield block


SPANS = "array<struct<start:int,end:int>>"


def _scan(docs: DataFrame, items: list[tuple[str | None, list[bytes]]], n: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Windows(items, n))

    def make(piece: pa.RecordBatch) -> dict:
        windows, count, spans, who = shared.value, [], [], []
        for text in texts(piece):
            words = words_of(text)
            found = windows.hits(words)
            count.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in merged([x[:2] for x in found])])
            who.append(sorted({i for x in found for i in x[2]}))
        return {"doc_id": piece.column("doc_id"), "text_hash": piece.column("text_hash"), "n_words": count, "spans": spans, "items": who}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_pieces(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), make, f"doc_id {kind}, text_hash long, n_words long, spans {SPANS}, items array<string>")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document row: doc_id, text_hash (xxhash64 of the text), n_words,
    spans (hit words, in word positions, end exclusive, merged) and items
    (ids of the items hit, sorted)."""
    return _scan_blocks(docs, _blocks(benchmark, n, block_windows), n)


def _scan_blocks(docs: DataFrame, blocks, n: int) -> DataFrame:
    first = next(blocks)
    block = next(blocks, None)
    if block is None:
        return _scan(docs, first, n)
    # Repeated rows of the same id and text have the same hits, so a key of
    # both joins the passes; only the sparse hits are kept and shuffled.  Each
    # pass is written, so one block is held at a time.
    hits = None
    for own in chain([first, block], blocks):
        part = table(_scan(docs, own, n).where("size(spans) > 0").select("doc_id", "text_hash", "spans", "items").distinct(), "hits")
        hits = part if hits is None else hits.unionByName(part)
    whole = _scan(docs, [], n)
    hits = hits.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("__tm_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    back = whole.select("doc_id", "text_hash", "n_words").alias("l").join(hits.alias("r"), F.expr("l.doc_id <=> r.doc_id and l.text_hash = r.text_hash"), "left")
    step = "case when size(acc) > 0 and s.start <= element_at(acc, -1).end then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))) else concat(acc, array(s)) end"
    joined = f"aggregate(array_sort(coalesce(__tm_spans, cast(array() as {SPANS}))), cast(array() as {SPANS}), (acc, s) -> {step})"
    return back.selectExpr("l.doc_id as doc_id", "l.text_hash as text_hash", "n_words", f"{joined} as spans", "coalesce(_items, cast(array() as array<string>)) as items")


def clean(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, n: int = NGRAM, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """*docs* without the documents that hit *min_items* items or more; from
    the others the hit spans are cut, and n_chars, if there, follows the text.
    Columns stay as they are, extra ones included."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns

    def rebuilt(piece: pa.RecordBatch, keep: list[bool], new: list[str | None]) -> dict:
        mask = pa.array(keep, pa.bool_())
        out = {f: piece.column(f).filter(mask) for f in names}
        out["text"] = [t for t, k in zip(new, keep, strict=True) if k]
        if "n_chars" in names:
            old = out["n_chars"].to_pylist()
            out["n_chars"] = [o if t is None else len(t) for o, t in zip(old, out["text"], strict=True)]
        return out

    blocks = _blocks(benchmark, n, block_windows)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(Windows(first, n))

        def one_pass(piece: pa.RecordBatch) -> dict:
            windows, keep, new = shared.value, [], piece.column("text").to_pylist()
            for i, text in enumerate(texts(piece)):
                found = windows.hits(words_of(text))
                keep.append(len({x for f in found for x in f[2]}) < min_items)
                if found and keep[-1]:
                    new[i] = cut(new[i], merged([f[:2] for f in found]))
            return rebuilt(piece, keep, new)

        return map_pieces(docs, one_pass, schema)

    hits = _scan_blocks(docs, chain([first, second], blocks), n).where("size(spans) > 0")
    hits = hits.select(F.col("doc_id").alias("__tm_hit"), F.col("text_hash").alias("__tm_hit_text"), F.col("spans").alias("__tm_spans"), F.size("items").alias("__tm_many")).dropDuplicates(["__tm_hit", "__tm_hit_text"])
    joined = docs.join(hits, F.expr("doc_id <=> __tm_hit and xxhash64(text) = __tm_hit_text"), "left").select(*names, "__tm_spans", F.expr("coalesce(__tm_many, 0)").alias("__tm_many"))

    def apply(piece: pa.RecordBatch) -> dict:
        new, many = piece.column("text").to_pylist(), piece.column("__tm_many").to_pylist()
        spans = piece.column("__tm_spans").to_pylist()
        keep = [m < min_items for m in many]
        new = [cut(t, [(s["start"], s["end"]) for s in x]) if x and k else t for t, x, k in zip(new, spans, keep, strict=True)]
        return rebuilt(piece, keep, new)

    return map_pieces(joined, apply, schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """*text* without the words of *spans*; what parts the words stays once."""
    at = [m.span() for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join(out) + text[last:]


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = scan(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bi AS (SELECT item, w, least(8, len(w)) AS m, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM bi),
lens AS (SELECT DISTINCT m FROM win),
di AS (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m),
hit AS (SELECT rid, i, di.m, item FROM (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM di) di JOIN win ON win.m = di.m AND win.g = di.g),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rid),
who AS (SELECT rid, count(DISTINCT item) AS n_items, coalesce(array_to_string(list_sort(list(DISTINCT item) FILTER (item IS NOT NULL)), ','), '') AS items FROM hit GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN who USING (rid)
"""

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {"op3_decontaminate": SQL}
