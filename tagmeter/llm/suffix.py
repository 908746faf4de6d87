"""Operator 5, repeated passages by sparse suffix arrays.

A suffix of a document is retained where a minimiser of its words stands: of
the GRAM-word prefixes in each window of LENGTH words the one with the least
hash.  The choice depends on content alone, so two passages of LENGTH equal
words retain the same suffixes.  A count of prefix hashes first drops suffixes
whose prefix no other row has; it loses none.

The others meet in blocks by prefix, as words: up to LENGTH to the right, and
up to LENGTH - GRAM to the left in reverse.  A block sorts its suffixes by
their words and compares neighbours, which gives common lengths, and sorts
what stands left of them in the same way.  Suffixes whose right sides agree
for LENGTH - o words stand in one interval of the one order, those whose left
sides agree for o words in one of the other; where two suffixes of different
documents share both, the match extends o words to the left and the rest to
the right.  That is tested for each o, so every window of LENGTH words around a
retained suffix that two documents have is found, by its words and not by a
hash.  A word is repeated if it lies in such a window; spans are maximal runs
of repeated words.

Of the documents that share a window, one leads (that of the first piece by
name, and in it the first place); the words of windows that it doesn't lead
are what deduplication removes.

A piece sends equal suffixes with equal surroundings once.  A prefix that more
than ``HOT`` rows have would still fill a block with surroundings, so its
windows are counted one by one, each known by 128 bits and sent once by a
piece; what both ways find is merged.

Defined cases: words are split at ASCII white space and compared in lower case
(A-Z); a null text or one of fewer than LENGTH words has no spans; a passage
repeated inside one document only isn't counted; equal rows repeat each other
wholly; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import map_pieces, mix64, pieces, scratch, table, texts, window_hashes, word_hashes
from .incidence import Rows, Shared, key_blocks, shared_keys

#: Words of a passage; words of a suffix's sorted prefix.
LENGTH, GRAM = 50, 25
#: Retained suffixes of a block, about; rows beyond which a prefix is hot.
BLOCK_SUFFIXES, HOT = 50_000, 512
_HOT = 1 << 30


def minimisers(h: np.ndarray) -> np.ndarray:
    """For each window of LENGTH words the place of its minimiser; *h*: hashes
    of the GRAM-word prefixes of a document's suffixes."""
    width = LENGTH - GRAM + 1
    if len(h) < width:
        return np.empty(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(h, width).argmin(1) + np.arange(len(h) - width + 1)


def _documents(piece: pa.RecordBatch):
    """(index, start in the piece, hashes of GRAM words) of each document that
    is long enough, and the words of all documents."""
    lists = [t.lower().split() for t in texts(piece)]
    flat = word_hashes([w for x in lists for w in x])
    start = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    each = [(i, int(start[i]), window_hashes(flat[start[i] : start[i + 1]], GRAM)) for i in range(len(lists)) if len(lists[i]) >= LENGTH]
    return each, start


def _suffixes(piece: pa.RecordBatch) -> Rows | None:
    each, start = _documents(piece)
    keys, places, rows = [], [], []
    for i, at, h in each:
        m = np.unique(minimisers(h))
        keys.append(h[m])
        places.append(m + at)
        rows.append(np.full(len(m), i))
    if not keys:
        return None
    head = (np.array(piece.column("text_hash").to_pylist(), np.int64).tobytes(), start.tobytes())
    return Rows(np.concatenate(keys), np.concatenate(places), np.concatenate(rows), head)


def _marks(got: Shared) -> dict:
    """The retained places of each document, from its start; those of hot
    prefixes with a bit set."""
    names, start = np.frombuffer(got.head[0], np.int64), np.frombuffer(got.head[1], np.int64)
    place, first = np.unique(got.place, return_index=True)
    place, hot = place.astype(np.int64), got.count[first] > HOT
    doc = np.searchsorted(start, place, "right") - 1
    cuts = np.flatnonzero(np.diff(doc)) + 1
    parts = np.split(np.where(hot, _HOT, 0) + place - start[doc], cuts) if len(place) else []
    own = doc[np.concatenate([[0], cuts])].tolist() if len(place) else []
    return {"hash": [int(names[i]) for i in own], "marks": [p.astype(np.int32).tobytes() for p in parts]}


def _hot_windows(piece: pa.RecordBatch) -> Rows | None:
    """The windows around suffixes of hot prefixes, known by the hashes of the
    grams at their ends, which cover them."""
    each, start = _documents(piece)
    marks = piece.column("marks").to_pylist()
    keys, places, rows = [], [], []
    for i, at, h in each:
        mark = np.frombuffer(marks[i], np.int32)
        hot = mark[mark >= _HOT] - _HOT
        w = np.unique((hot[:, None] - np.arange(LENGTH - GRAM + 1)).ravel())
        w = w[(w >= 0) & (w + LENGTH - GRAM < len(h))]
        keys.append(mix64(h[w] + mix64(h[w + LENGTH - GRAM])))
        places.append(w + at)
        rows.append(np.full(len(w), i))
    if not sum(map(len, keys)):
        return None
    head = pickle.dumps([piece.column(c).to_pylist() for c in ("row", "doc_id", "text_hash")], protocol=4)
    return Rows(np.concatenate(keys), np.concatenate(places), np.concatenate(rows), (head, start.tobytes()))


def _hot_spans(got: Shared) -> dict:
    (row, ids, hashes), start = pickle.loads(got.head[0]), np.frombuffer(got.head[1], np.int64)
    order = np.lexsort((got.place, got.key))
    key, place, lead = got.key[order], got.place[order].astype(np.int64), got.lead[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    again = ~(first & lead)
    doc = np.searchsorted(start, place, "right") - 1
    sizes = np.diff(start).tolist()
    one = np.ones(len(doc), np.uint32)
    spans, removed = _runs(doc, place - start[doc], one, sizes), _runs(doc, place - start[doc], again.astype(np.uint32), sizes)
    found = sorted(spans)
    return {"row": [row[i] for i in found], "doc_id": [ids[i] for i in found], "text_hash": [hashes[i] for i in found], "n_words": [sizes[i] for i in found], "spans": [spans[i] for i in found], "removed": [removed.get(i, []) for i in found]}


_TYPES = (pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
_NAMES = ["block", "piece", "kind", "a", "b", "c"]
_RECORD = np.dtype([("number", "<u4"), ("doc", "<u4"), ("place", "<u8")])
_SEVERAL = 0xFFFFFFFF


def _contexts(piece: pa.RecordBatch, many: int) -> pa.RecordBatch | None:
    """The retained suffixes of a piece with what stands around them, and a
    header with their places."""
    import xxhash

    marks = piece.column("marks").to_pylist()
    known: dict[tuple[bytes, bytes], int] = {}
    block, doc_of, first, record, docs, places, sizes = [], [], [], [], [], [], []
    begin = 0
    for i, text in enumerate(texts(piece)):
        words = text.lower().split()
        sizes.append(len(words))
        at = np.frombuffer(marks[i], np.int32)
        at = at[at < _HOT]
        h = window_hashes(word_hashes(words), GRAM)[at] if len(words) >= LENGTH else []
        for p, g in zip(at.tolist(), (h % np.uint64(many)).tolist() if len(h) else (), strict=False):
            key = b" ".join(words[p : p + LENGTH]), b" ".join(words[max(0, p - LENGTH + GRAM) : p][::-1])
            k = known.setdefault(key, len(known))
            if k == len(block):
                block.append(g)
                doc_of.append(i)
                first.append(begin + p)
            elif doc_of[k] != i:
                doc_of[k] = _SEVERAL
            record.append(k)
            docs.append(i)
            places.append(p)
        begin += len(words)
    if not known:
        return None
    head = pickle.dumps(([piece.column(c).to_pylist() for c in ("row", "doc_id", "text_hash")], sizes), protocol=4)
    where = np.array([record, docs, places], np.int64).tobytes()
    name = xxhash.xxh3_128_digest(head)
    out = [(many + int.from_bytes(name[:4], "little") % many, name, 0, head, where, b"")]
    right, left = [k[0] for k in known], [k[1] for k in known]
    block = np.array(block)
    order = np.argsort(block, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        rows = np.empty(len(at), _RECORD)
        rows["number"], rows["doc"], rows["place"] = at, np.array(doc_of)[at], np.array(first)[at]
        out.append((int(block[at[0]]), name, 1, b"\n".join([right[k] for k in at.tolist()]), b"\n".join([left[k] for k in at.tolist()]), rows.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)


def common_words(a: bytes, b: bytes) -> int:
    """How many words two lists, joined by spaces, have in common from the start."""
    if a == b:
        return a.count(b" ") + 1 if a else 0
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common prefix in bytes
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    ends = (low == len(a) or a[low : low + 1] == b" ") and (low == len(b) or b[low : low + 1] == b" ")
    return a.count(b" ", 0, low) + (1 if ends and low else 0)


def _sorted(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and what each has in common with the one before it."""
    order = sorted(range(len(words)), key=words.__getitem__)
    return np.array(order, np.int64), np.array([0, *(common_words(words[i], words[j]) for i, j in zip(order, order[1:], strict=False))], np.int64)


def _intervals(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """The interval of each suffix in which all agree for *least* words."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < least)
    return out


def _match(rows: pa.Table) -> pa.Table:
    """For each suffix of a block, for which extensions to the left its window
    stands in another document, and for which of these it leads; as bits."""
    names, kind, a, b, c = (rows.column(i).to_pylist() for i in range(1, 6))
    out = [(names[i], 0, a[i], b[i], c[i]) for i, k in enumerate(kind) if k == 0]
    sent = [i for i, k in enumerate(kind) if k == 1]
    if sent:
        rank = {x: r for r, x in enumerate(sorted({names[i] for i in sent}))}
        record = np.concatenate([np.frombuffer(c[i], _RECORD) for i in sent])
        owner = np.repeat([rank[names[i]] for i in sent], [len(c[i]) // _RECORD.itemsize for i in sent])
        right, left = ([x for i in sent for x in side[i].split(b"\n")] for side in (a, b))
        to_right, to_left = _sorted(right), _sorted(left)
        wide = [np.array([x.count(b" ") + bool(x) for x in side], np.int64) for side in (right, left)]
        n = len(record)
        doc = (owner.astype(np.uint64) << np.uint64(32)) + record["doc"]
        place = (owner.astype(np.uint64) << np.uint64(40)) + record["place"]
        several = record["doc"] == _SEVERAL
        found, leads = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        for o in range(LENGTH - GRAM + 1):
            group = _intervals(*to_right, LENGTH - o) * (n + 1) + (_intervals(*to_left, o) if o else 0)
            order = np.argsort(group)
            begin = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
            each = np.cumsum(np.concatenate([[True], np.diff(group[order]) != 0])) - 1
            shared = np.minimum.reduceat(doc[order], begin) != np.maximum.reduceat(doc[order], begin)
            shared |= np.logical_or.reduceat(several[order], begin)
            # what a text's end cuts off may be too short for the window
            whole = (wide[0][order] >= LENGTH - o) & (wide[1][order] >= o)
            bit = np.where(shared[each] & whole, np.uint32(1 << o), np.uint32(0))
            first = np.minimum.reduceat(place[order], begin)[each] == place[order]
            found[order] |= bit
            leads[order] |= np.where(first, bit, np.uint32(0))
        hit = found > 0
        at = 0
        for i in sent:
            k = len(c[i]) // _RECORD.itemsize
            own = slice(at, at + k)
            at += k
            if hit[own].any():
                h = hit[own]
                out.append((names[i], 1, record["number"][own][h].tobytes(), found[own][h].tobytes(), leads[own][h].tobytes()))
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.table([pa.array(x, t) for x, t in zip(columns, _TYPES[1:], strict=True)], names=_NAMES[1:])


def _runs(doc: np.ndarray, place: np.ndarray, bits: np.ndarray, sizes: list[int]) -> dict[int, list[dict]]:
    """Maximal runs of words, by document, that the windows cover which *bits*
    tell around suffixes at *place*."""
    begin = np.cumsum([0, *(n + 1 for n in sizes)])  # a gap after each document
    step = np.zeros(int(begin[-1]) + 1, np.int32)
    for o in range(LENGTH - GRAM + 1):
        at = (begin[doc] + place - o)[(bits >> np.uint32(o)) & np.uint32(1) == 1]
        np.add.at(step, at, 1)
        np.add.at(step, at + LENGTH, -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(step[:-1]) > 0).astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: dict[int, list[dict]] = {}
    for i, a, b in zip((np.searchsorted(begin, start, "right") - 1).tolist(), start.tolist(), end.tolist(), strict=True):
        out.setdefault(i, []).append({"start": a - int(begin[i]), "end": b - int(begin[i])})
    return out


def _spans(rows: pa.Table) -> dict:
    out: dict = {c: [] for c in ("row", "doc_id", "text_hash", "n_words", "spans", "removed")}
    kind, a, b, c = (rows.column(i).to_pylist() for i in range(1, 5))
    heads = [i for i, k in enumerate(kind) if k == 0]
    told = [i for i, k in enumerate(kind) if k == 1]
    if not heads or not told:
        return out
    (row, ids, hashes), sizes = pickle.loads(a[heads[0]])
    record, doc, place = np.frombuffer(b[heads[0]], np.int64).reshape(3, -1)
    number = np.concatenate([np.frombuffer(a[i], np.uint32) for i in told]).astype(np.int64)
    found, leads = np.zeros((2, int(record.max()) + 1), np.uint32)
    found[number] = np.concatenate([np.frombuffer(b[i], np.uint32) for i in told])
    leads[number] = np.concatenate([np.frombuffer(c[i], np.uint32) for i in told])
    # the first place of a leading record leads
    first = np.zeros(len(record), bool)
    first[np.unique(record, return_index=True)[1]] = True
    keep = found[record] > 0
    record, doc, place, first = record[keep], doc[keep], place[keep], first[keep]
    again = found[record] & ~np.where(first, leads[record], np.uint32(0))
    spans, removed = _runs(doc, place, found[record], sizes), _runs(doc, place, again, sizes)
    for i in sorted(spans):
        for name, value in (("row", row[i]), ("doc_id", ids[i]), ("text_hash", hashes[i]), ("n_words", sizes[i]), ("spans", spans[i]), ("removed", removed.get(i, []))):
            out[name].append(value)
    return out


SPANS = "array<struct<start:int,end:int>>"


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, spans and removed (runs of words) of each
    document that shares a passage with another."""
    spark = docs.sparkSession
    rows = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    # about two words in GRAM carry a minimiser; a word has five bytes or so
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    marks = shared_keys(rows.select("text", "text_hash"), _suffixes, _marks, "hash long, marks binary", key_blocks(spark, size // 60))
    with scratch() as s:
        marks = table(marks.dropDuplicates(["hash"]), "suffixes")
        retained = marks.agg(F.coalesce(F.sum(F.octet_length("marks")), F.lit(0))).first()[0] // 4
        many = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), retained // BLOCK_SUFFIXES)
        left = rows.join(marks, rows["text_hash"] == marks["hash"]).select("doc_id", "text", "text_hash", "marks", F.monotonically_increasing_id().alias("row"))
        left = table(left, "retained")  # a stable order, so pieces keep their names

        def send(batches):
            for piece in pieces(batches):
                got = _contexts(piece, many)
                if got is not None:
                    yield got

        def back(group: pa.Table) -> pa.Table:
            made = _spans(group)
            return pa.table([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

        kind = docs.schema["doc_id"].dataType.simpleString()
        schema = f"row long, doc_id {kind}, text_hash long, n_words long, spans {SPANS}, removed {SPANS}"
        arrow = to_arrow_schema(_parse_datatype_string(schema))
        matched = left.mapInArrow(send, "block int, piece binary, kind int, a binary, b binary, c binary").groupBy("block").applyInArrow(_match, "piece binary, kind int, a binary, b binary, c binary")
        found = matched.groupBy("piece").applyInArrow(back, schema)
        hot = shared_keys(left.select("row", "doc_id", "text", "text_hash", "marks"), _hot_windows, _hot_spans, schema, key_blocks(spark, retained * (LENGTH - GRAM + 1) // 2))
        found = found.unionByName(hot).groupBy("row").agg(
            *(F.first(c).alias(c) for c in ("doc_id", "text_hash", "n_words")), *(F.expr(_joined(c)).alias(c) for c in ("spans", "removed"))
        ).drop("row")
        return s.keep(table(found, "passages"))


def _joined(column: str) -> str:
    """SQL of the union of lists of spans."""
    last = "element_at(acc, -1)"
    step = f"case when size(acc) > 0 and s.start <= {last}.end then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', {last}.start, 'end', greatest({last}.end, s.end)))) else concat(acc, array(s)) end"
    return f"aggregate(array_sort(flatten(collect_list({column}))), cast(array() as {SPANS}), (acc, s) -> {step})"


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """*text* without the words of *spans*."""
    at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join(out) + text[last:]


def dedup(docs: DataFrame) -> DataFrame:
    """*docs* with each shared passage left in one document only."""
    names = docs.columns
    found = repeated(docs).where("size(removed) > 0").select(F.col("doc_id").alias("__tm_d"), F.col("text_hash").alias("__tm_t"), F.col("removed").alias("__tm_removed"))
    # equal rows differ in what they lead, so one of them takes each result
    found = found.groupBy("__tm_d", "__tm_t").agg(F.max_by("__tm_removed", F.size("__tm_removed")).alias("__tm_removed"))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__tm_d")) & (F.xxhash64("text") == F.col("__tm_t")), "left").select(*names, "__tm_removed")

    def make(piece: pa.RecordBatch) -> dict:
        new = [cut(t, [(s["start"], s["end"]) for s in r]) if r else t for t, r in zip(piece.column("text").to_pylist(), piece.column("__tm_removed").to_pylist(), strict=True)]
        out = {c: piece.column(c) for c in names} | {"text": new}
        if "n_chars" in names:
            out["n_chars"] = [o if t is None else len(t) for o, t in zip(piece.column("n_chars").to_pylist(), new, strict=True)]
        return out

    return map_pieces(joined, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op5_suffix(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_repeated, n_removed and spans (start:end in words)
    of every document that shares a passage of 50 words or more."""
    found = repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = "aggregate({}, 0L, (a, s) -> a + s.end - s.start)"
    return found.select(
        "doc_id", "n_words", F.expr(words.format("spans")).alias("n_repeated"), F.expr(words.format("removed")).alias("n_removed"),
        F.expr("array_join(transform(spans, s -> concat(s.start, ':', s.end)), ',')").alias("spans"),
    )


QUERIES = {"op5_suffix": op5_suffix}
ORACLES: dict[str, str] = {}
