"""Operator 10, fuzzy line deduplication by MinHash.

Lines are compared in lower case (A-Z) with white space folded.  A line's set
is its character shingles; its signature is banded, and a band's value is a
key that lines share.  Only keys that two distinct lines have come back from
``incidence``; ``linking`` verifies candidates by exact Jaccard similarity and
merges links by distributed union-find.  Of each component, counting exact
copies, the line at the smallest (doc_id, text hash, line number) stays.

Signatures: the shingle hashes are dealt into ``BINS`` bins, each bin's least
hash is a component, and empty bins borrow from filled ones, each by its own
random sequence (one permutation hashing).  Lines of fewer than ``SHORT`` distinct shingles get a
signature by as many independent permutations instead; lines around the limit
get both kinds, so that any pair within reach of the similarity has a kind in
common.

With ROWS = 4 and BANDS = 16 a pair of similarity 0.75 shares a band with
probability 0.9977, one of 0.85 with 0.99999.

Each line sends one more key, its own hash, so that pieces learn which of
their lines others repeat; only lines that repeat or have candidates leave
their piece.

Defined cases: blank lines are left alone; lines that fold to fewer than
``SHINGLE`` code points have no shingle and repeat only as exact copies, which
count at any length; a null text has no lines; rows equal in id
and text are one document and stay alike; an empty table gives an empty
result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pieces, mix64, scratch, small, table, texts, window_hashes
from .incidence import Rows, Shared, fingerprints, key_blocks, marks, name_of, row_pieces, shared_keys
from .linking import PACKED, as_ids, ask, asked_sets, found_in, id_rows, link, pack

SHINGLE, PERCENT = 8, 75
ROWS, BANDS = 4, 16
#: Share of its words below which what is left of a document is a torn copy.
MIN_SHARE = 0.25
BINS = ROWS * BANDS
#: Shingles below which a line is short.
SHORT = 24

_SEEDS = mix64(np.arange(1, BINS + 1, dtype=np.uint64)) | np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_OWN = np.uint64(0xD6E8FEB86659FD93)
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32))


#: White space but for the line feed to a space.
_SPACE = bytes(32 if c in b"\t\v\f\r" else c for c in range(256))


def lines_of(text: bytes, least: int = 1) -> list[tuple[int, bytes]]:
    """(number, folded line) of the lines of *least* code points or more; by
    default all but blank ones."""
    low = text.lower().translate(_SPACE)
    lines = low.split(b"\n")
    if b"  " in low or b" \n" in low or b"\n " in low or low[:1] == b" " or low[-1:] == b" ":
        lines = [b" ".join(x.split()) for x in lines]
    return [(i, x) for i, x in enumerate(lines) if len(x) >= least and (least == 1 or x.isascii() or len(x.decode()) >= least)]


def id_of(line: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(line)


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of lines one after the other, where each line's begin,
    and how many it has.  Between lines stand places without a shingle.

    Eight code points below 256 are one number; a shingle with others is
    hashed from its code points."""
    text = b"\n".join(lines).decode()
    narrow = text.encode("latin-1", "replace")
    chars = np.frombuffer(narrow, np.uint8)
    ends = np.flatnonzero(chars == 10)
    begin = np.concatenate([[0], ends + 1])
    size = np.concatenate([ends, [len(chars)]]) - begin - SHINGLE + 1
    h = mix64(np.ndarray((max(0, len(chars) - SHINGLE + 1),), "<u8", narrow, 0, (1,)))
    if len(text.encode("latin-1", "ignore")) < len(text):
        wide = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        held = np.convolve(wide > 255, np.ones(SHINGLE, int), "valid") > 0
        h[held] = window_hashes(wide.astype(np.uint64), SHINGLE)[held]
    h[(begin + size)[:-1, None] + np.arange(SHINGLE)] = _NONE
    return h, begin, size


def _filled(least: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Empty bins take the value of a filled one, each by a sequence of its own."""
    out = least.copy()
    line, place = np.nonzero(empty)
    key = mix64(place.astype(np.uint64) + np.uint64(1))
    turn = 0
    while len(line):
        turn += 1
        other = (mix64(key + np.uint64(turn)) % np.uint64(BINS)).astype(np.int64)
        found = ~empty[line, other]
        out[line[found], place[found]] = least[line[found], other[found]] + key[found]
        line, place, key = line[~found], place[~found], key[~found]
    return out


def signatures(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band values of lines and the line of each row: (rows x BANDS, rows)."""
    n = len(size)
    slot = np.repeat(np.arange(n) * BINS, np.append(np.diff(begin), size[-1]))
    slot += ((h >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64)
    least = np.full(n * BINS, _NONE)
    np.minimum.at(least, slot, h)
    least = least.reshape(-1, BINS)
    empty = least == _NONE
    # a line that fills many bins has far more than SHORT distinct shingles;
    # the others may repeat themselves and are counted
    distinct = size.copy()
    for i in np.flatnonzero((size >= SHORT) & (BINS - empty.sum(1) < 2 * SHORT)).tolist():
        distinct[i] = len(np.unique(h[begin[i] : begin[i] + size[i]]))
    out, rows = [], []
    long = np.flatnonzero(distinct >= SHORT)
    if len(long):
        out.append(_filled(least[long], empty[long]))
        rows.append(long)
    few = np.flatnonzero(distinct * PERCENT < SHORT * 100)
    if len(few):
        first = np.concatenate([[0], np.cumsum(size[few])[:-1]])
        g = h[np.arange(int(size[few].sum())) + np.repeat(begin[few] - first, size[few])]
        least = np.empty((len(few), BINS), np.uint64)
        for k in range(BINS):
            x = g * _SEEDS[k]
            least[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), first)
        out.append(~least)
        rows.append(few)
    s = np.concatenate(out).reshape(-1, BANDS, ROWS)
    value = np.zeros(s.shape[:2], np.uint64)
    for r in range(ROWS):
        value = value * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r]
    return mix64(value + _BAND), np.concatenate(rows)


def pieces_of(docs: DataFrame) -> DataFrame:
    """The lines of each piece of text: the distinct ones (ids, and the lines
    themselves) and its rows (doc_id, text_hash, and how many lines each has,
    with their numbers and which of the distinct ones they are)."""

    def make(piece: pa.RecordBatch) -> dict:
        known: dict[bytes, int] = {}
        many, which, number = [], [], []
        for text in texts(piece):
            found = lines_of(text)
            many.append(len(found))
            for k, line in found:
                number.append(k)
                which.append(known.setdefault(line, len(known)))
        ids = b"".join(map(id_of, known))
        sizes = np.array([fingerprints(ids)[1] if known else 0, *map(len, known)], np.int64).tobytes()
        out = {"name": name_of((ids, sizes)), "ids": ids, "sizes": sizes, "distinct": b"\n".join(known), "which": np.array(which, np.int32).tobytes(), "number": np.array(number, np.int32).tobytes()}
        return {c: [v] for c, v in out.items()} | {c: [piece.column(c).to_pylist()] for c in ("doc_id", "text_hash")} | {"many": [many]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_pieces(rows, make, f"name binary, ids binary, sizes binary, distinct binary, which binary, number binary, doc_id array<{kind}>, text_hash array<long>, many array<int>")


def _rows(piece: pa.RecordBatch) -> Rows | None:
    ids, sizes = piece.column("ids")[0].as_py(), piece.column("sizes")[0].as_py()
    if not ids:
        return None
    lines = piece.column("distinct")[0].as_py().split(b"\n")
    # code points tell which lines have a shingle
    long = np.flatnonzero([len(x) >= SHINGLE and (x.isascii() or len(x.decode()) >= SHINGLE) for x in lines])
    keys, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    size = np.cumsum([len(lines[i]) for i in long])
    for part in np.split(long, np.flatnonzero(np.diff(size >> 20)) + 1) if len(long) else ():  # shingles of about a megabyte at once
        value, row = signatures(*shingles([lines[i] for i in part.tolist()]))
        keys.append(value.ravel())
        places.append(np.repeat(part[row], BANDS))
    where = np.concatenate(places)
    mark, head = marks(ids, int(np.frombuffer(sizes, np.int64)[0])), (ids, sizes)
    # a line's own key counts pieces, so its mark is the piece's too
    own = mix64(mark ^ np.frombuffer(name_of(head)[:8], np.uint64)) >> np.uint64(1)
    every = np.arange(len(own))
    return Rows(np.concatenate([*keys, _own_keys(ids)]), np.concatenate([mark[where], own]), np.concatenate([where, every]), head)


def _own_keys(ids: bytes) -> np.ndarray:
    """The keys that stand for the lines themselves."""
    return mix64(id_rows(ids)[:, 0] ^ _OWN)


def _candidates(parts: int):
    def run(got: Shared) -> dict:
        if not len(got.key):
            return {c: [] for c in ("part", "key", "id", "n")}
        sizes, ids = np.frombuffer(got.head[1], np.int64), id_rows(got.head[0])
        own = _own_keys(got.head[0])
        order = np.argsort(own)
        at = np.minimum(np.searchsorted(own[order], got.key), len(own) - 1)
        same = own[order[at]] == got.key
        repeated = order[at[same]]
        key, count, place = got.key[~same], got.count[~same], got.place[~same]
        mark = marks(got.head[0], int(sizes[0]))
        order = np.argsort(mark)
        which = order[np.searchsorted(mark[order], place)]
        made, name = pack(key, ids[which], sizes[1:][which], count, parts), name_of(got.head)
        told = [ask(name, ids[np.unique(which)])] if len(which) else []
        told.append(ask(name, ids[np.unique(np.concatenate([which, repeated]))], -3))
        return {c: sum((t[c] for t in told), made[c]) for c in made}

    return run


def _lines(row: dict, wanted: np.ndarray) -> list[bytes]:
    lines = row["distinct"].split(b"\n")
    return [lines[i] for i in wanted.tolist()]


def shingles_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of lines one after the other, and how many each has."""
    if not lines:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, begin, size = shingles(lines)
    return h[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)], size


def occurrences(pieces: DataFrame, buckets: DataFrame) -> DataFrame:
    """doc_id, text_hash, line (its number) and id of the lines that may
    repeat: those that a piece itself or, as *buckets* tell, others have again
    or have a candidate for."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                which, number = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in ("which", "number"))
                ids = id_rows(batch.column("ids")[i].as_py())
                matters = np.bincount(which, minlength=len(ids)) > 1
                if told := batch.column("__told")[i].as_py():
                    matters |= found_in(ids, id_rows(told))
                at = np.flatnonzero(matters[which])
                doc = np.repeat(np.arange(len(batch.column("many")[i])), batch.column("many")[i].values.to_numpy())[at]
                made = [*(batch.column(c)[i].values.take(pa.array(doc)) for c in ("doc_id", "text_hash")), pa.array(number[at]), as_ids(ids[which[at]])]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "text_hash", "line", "id"])

    kind = pieces.schema["doc_id"].dataType.elementType.simpleString()
    told = buckets.where("part = -3").select(F.col("key").alias("__name"), F.col("id").alias("__told")).dropDuplicates(["__name"])
    rows = pieces.select("name", "ids", "which", "number", "doc_id", "text_hash", "many")
    rows = rows.join(told, rows["name"] == told["__name"], "left").drop("name", "__name")
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, line int, id binary")


def repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash and line of the lines that go."""
    return judged(docs, percent)[1]


def judged(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, gone): doc_id, text_hash and n_lines (compared) of each row, and
    doc_id, text_hash and line of the lines that go."""
    spark = docs.sparkSession
    with scratch() as s:
        pieces = table(pieces_of(docs), "lines", packed=True)
        rows = pieces.select(F.explode(F.arrays_zip("doc_id", "text_hash", "many")).alias("x")).select("x.doc_id", "x.text_hash", F.col("x.many").cast("long").alias("n_lines"))
        rows = s.keep(table(rows, "rows"))
        many = pieces.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // 16
        parts = key_blocks(spark, many * (BANDS + 1))
        buckets = table(shared_keys(pieces.select("ids", "sizes", "distinct"), _rows, _candidates(parts), PACKED, parts, distinct=True, cut=row_pieces), "bands", blobs=True)
        found = link(buckets, parts, asked_sets(buckets, pieces, ["distinct"], _lines), percent, shingles_of)
        placed = occurrences(pieces, buckets)
        if found is None:
            placed = placed.withColumn("g", F.col("id"))
        else:
            found = small(found.select(F.col("id").alias("__id"), "component"), "linked")
            placed = placed.join(found, placed["id"] == F.col("__id"), "left").withColumn("g", F.coalesce("component", "id"))
        placed = table(placed.select("g", F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line"), "placed", blobs=True)
        at = F.struct("none", "doc_id", "text_hash", "line")
        first = placed.groupBy("g").agg(F.min(at).alias("first"), F.count("*").alias("many")).where("many > 1")
        again = placed.join(small(first.select("g", "first"), "firsts"), "g")
        gone = s.keep(table(again.where(~at.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "line").distinct(), "gone"))
    return rows, gone


def by_document(gone: DataFrame) -> DataFrame:
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("line")).alias("gone"))


def dedup(docs: DataFrame, percent: int = PERCENT, min_share: float = MIN_SHARE) -> DataFrame:
    """*docs* without repeated lines.  A document that loses lines and keeps
    no word, or less than *min_share* of its words, is a torn copy of others
    and goes; n_chars, if there, follows the text."""
    names = docs.columns
    gone = by_document(repeats(docs, percent)).select(F.col("doc_id").alias("__tm_d"), F.col("text_hash").alias("__tm_t"), F.col("gone").alias("__tm_gone"))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__tm_d")) & (F.xxhash64("text") == F.col("__tm_t")), "left").select(*names, "__tm_gone")

    def make(piece: pa.RecordBatch) -> dict:
        old, keep = piece.column("text").to_pylist(), []
        new = list(old)
        for i, drop in enumerate(piece.column("__tm_gone").to_pylist()):
            if drop:
                out = set(drop)
                new[i] = "\n".join(x for k, x in enumerate(new[i].split("\n")) if k not in out)
            keep.append(not drop or len(new[i].encode().split()) >= max(1, min_share * len(old[i].encode().split())))
        mask = pa.array(keep, pa.bool_())
        made = {c: piece.column(c).filter(mask) for c in names}
        made["text"] = [t for t, k in zip(new, keep, strict=True) if k]
        if "n_chars" in names:
            made["n_chars"] = [o if t is None else len(t) for o, t in zip(made["n_chars"].to_pylist(), made["text"], strict=True)]
        return made

    return map_pieces(joined, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op10_lines(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (compared), n_gone and gone (their numbers from 0)."""
    rows, gone = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = by_document(gone).select(F.col("doc_id").alias("__tm_d"), F.col("text_hash").alias("__tm_t"), "gone")
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__tm_d")) & (F.col("text_hash") == F.col("__tm_t")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_gone"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("gone"))


QUERIES = {"op10_lines": op10_lines}
ORACLES: dict[str, str] = {}
