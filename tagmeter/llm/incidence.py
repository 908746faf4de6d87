"""Counting keys over a corpus in blocks, and telling each row which it shares.

A sparse incidence of rows (documents or lines) by 64-bit keys is cut into
blocks: by the piece of input that a worker holds, and by the key.  Each
worker sorts the keys of its piece, so keys that several of its rows have go
out once with a weight.  A key block sorts what all pieces sent, compares
neighbours, adds up weights and returns the keys that two rows or more have.
Back at the piece, its header says which rows have them.

Keys travel as packed arrays, 8 bytes and 8 for the place; a key that a third
of all rows have costs one entry for each piece.  No task needs more than a
key block or a piece.  Where rows are known by fingerprints, these have 64 bits:
two different rows that share a key seem one with a chance of 2^-64.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64, pieces

#: Keys of a key block, about.
BLOCK_KEYS = 2_000_000

_ANY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A count's highest bit says that the piece leads.
_LEAD = np.uint32(1 << 31)
_PAIR = np.dtype([("t", "<u8"), ("l", "<u8")])
_SENT = "bucket int, piece binary, kind int, a binary, b binary, c binary"
_TYPES = (pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
_NAMES = ["bucket", "piece", "kind", "a", "b", "c"]


@dataclass
class Rows:
    """A piece's part of the incidence: an entry for each key, place and row.

    A place tells the piece where a key stands.  Where rows of different
    pieces may be the same thing, it is instead a fingerprint of the row, and
    keys are counted by distinct places (``fingerprints``).  ``head`` is what
    the piece will need to know later; ``name_of`` it names the piece, so that
    a repeated task sends the same.
    """

    key: np.ndarray
    place: np.ndarray
    row: np.ndarray
    head: tuple[bytes, bytes]


@dataclass
class Shared:
    """What comes back: shared keys with their places and row counts, whether
    this piece is the first that has the key (of all pieces, by name), and the
    places of keys below ``top`` that no other row has."""

    head: tuple[bytes, bytes]
    key: np.ndarray
    place: np.ndarray
    count: np.ndarray
    lead: np.ndarray
    lone: np.ndarray
    copies: int  # pieces of equal content


def name_of(head: tuple[bytes, bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(head[0] + b"\0" + head[1])


def key_blocks(spark, keys: int) -> int:
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), keys // BLOCK_KEYS, 1)


def _send(rows: Rows, many: int) -> pa.RecordBatch:
    order = np.argsort(rows.key)
    key = rows.key[order]
    # only equal keys need an order among themselves
    tie = np.concatenate([[False], key[1:] == key[:-1]])[: len(key)]
    tie[:-1] |= tie[1:]
    at = np.flatnonzero(tie)
    if len(at):
        own = order[at]
        order[at] = own[np.lexsort((rows.place[own], rows.row[own], rows.key[own]))]
    place, row = rows.place[order].astype(np.uint64), rows.row[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key)))
    fresh = new.copy()
    fresh[1:] |= row[1:] != row[:-1]
    owners = np.add.reduceat(fresh, first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
    single = times == 1
    several = ~np.repeat(single, times)
    pairs = np.empty(int(several.sum()), _PAIR)
    pairs["t"], pairs["l"] = key[several], place[several]
    a, b = rows.head
    name = name_of(rows.head)
    out = [(many + int.from_bytes(name[:4], "little") % many, name, 0, a, b, pairs.tobytes())]
    gram, who = key[first], np.where(single, place[first], _ANY)
    column = ((gram >> np.uint64(11)) % np.uint64(many)).astype(np.int32)
    order = np.argsort(column, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(column[order])) + 1) if len(order) else ():
        w = who[at]
        out.append((int(column[at[0]]), name, 1, gram[at].tobytes(), w.tobytes(), owners[at][w == _ANY].astype(np.uint32).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)


def marks(ids: bytes, salt: int) -> np.ndarray:
    """Eight bytes for each 16-byte id."""
    half = np.frombuffer(ids, np.uint64).reshape(-1, 2)
    return np.minimum(mix64(half[:, 0] + mix64(half[:, 1] + np.uint64(salt))), _ANY - np.uint64(1))


def fingerprints(ids: bytes) -> tuple[np.ndarray, int]:
    """Marks that tell this piece's ids apart, and their salt.  It is 0 but
    for pieces in which two ids would meet, so equal ids of different pieces
    have equal marks; where they don't, a key only seems to be shared."""
    for salt in range(1000):
        got = marks(ids, salt)
        if len(np.unique(got)) == len(got):
            return got, salt
    raise ValueError("a piece repeats an id")


def _count(top: int, distinct: bool):
    """Column counts of a key block; headers pass."""

    def run(block: pa.Table) -> pa.Table:
        names, kind, a, b, c = (block.column(i).to_pylist() for i in range(1, 6))
        out = [(names[i], 0, a[i], b[i], c[i]) for i, k in enumerate(kind) if k == 0]
        rows = [i for i, k in enumerate(kind) if k == 1]
        if rows:
            gram = np.concatenate([np.frombuffer(a[i], np.uint64) for i in rows])
            who = np.concatenate([np.frombuffer(b[i], np.uint64) for i in rows])
            weight = np.ones(len(gram), np.int64)
            weight[who == _ANY] = np.concatenate([np.frombuffer(c[i], np.uint32) for i in rows])
            order = np.argsort(gram)
            new = np.concatenate([[True], np.diff(gram[order]) != 0])
            if distinct:  # equal places of a key count once
                tie = ~new
                tie[:-1] |= ~new[1:]
                at = order[np.flatnonzero(tie)]
                at = at[np.lexsort((who[at], gram[at]))]
                same = (gram[at[1:]] == gram[at[:-1]]) & (who[at[1:]] == who[at[:-1]]) & (who[at[1:]] != _ANY)
                weight[at[1:][same]] = 0
            begin, group = np.flatnonzero(new), np.cumsum(new) - 1
            total = np.empty(len(gram), np.int64)
            total[order] = np.add.reduceat(weight[order], begin)[group]
            by_name = {x: r for r, x in enumerate(sorted({names[i] for i in rows}))}
            rank = np.repeat(np.array([by_name[names[i]] for i in rows]), [len(a[i]) // 8 for i in rows])
            lead = np.empty(len(gram), bool)
            lead[order] = np.minimum.reduceat(rank[order], begin)[group] == rank[order]
            at = 0
            for i in rows:
                k = len(a[i]) // 8
                g, w, d = gram[at : at + k], who[at : at + k], np.minimum(total[at : at + k], 0x7FFFFFFF).astype(np.uint32)
                shared = d > 1
                d |= np.where(lead[at : at + k], _LEAD, np.uint32(0))
                at += k
                if shared.any():
                    out.append((names[i], 1, g[shared].tobytes(), w[shared].tobytes(), d[shared].tobytes()))
                if top:
                    lone = w[~shared & (g < np.uint64(top)) & (w != _ANY)]
                    if len(lone):
                        out.append((names[i], 2, lone.tobytes(), b"", b""))
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.table([pa.array(x, t) for x, t in zip(columns, _TYPES[1:], strict=True)], names=_NAMES[1:])

    return run


def row_pieces(batches):
    """Each row is a piece."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _gather(block: pa.Table) -> Shared | None:
    kind, a, b, c = (block.column(i).to_pylist() for i in range(1, 5))
    heads = [i for i, k in enumerate(kind) if k == 0]
    if not heads:
        return None

    def joined(values: list[bytes], of: int, kind_: int, dtype) -> np.ndarray:
        return np.concatenate([np.frombuffer(values[i], dtype) for i in range(len(kind)) if kind[i] == of] or [np.empty(0, dtype)])

    pairs = np.frombuffer(c[heads[0]], _PAIR)
    key, place, count = joined(a, 1, 0, np.uint64), joined(b, 1, 0, np.uint64), joined(c, 1, 0, np.uint32)
    several = place == _ANY
    if len(pairs) and several.any():
        g, d = key[several], count[several]
        order = np.argsort(g)
        g, d = g[order], d[order]
        at = np.minimum(np.searchsorted(g, pairs["t"]), len(g) - 1)
        own = g[at] == pairs["t"]  # the others were in one row only
        key, place, count = np.concatenate([key[~several], pairs["t"][own]]), np.concatenate([place[~several], pairs["l"][own]]), np.concatenate([count[~several], d[at[own]]])
    else:
        key, place, count = key[~several], place[~several], count[~several]
    if len(heads) > 1:  # pieces of equal content sent everything once each
        order = np.lexsort((key, place))
        key, place, count = key[order], place[order], count[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])])[: len(key)]
        key, place, count = key[new], place[new], count[new]
    return Shared((a[heads[0]], b[heads[0]]), key, place, count & ~_LEAD, count >= _LEAD, joined(a, 2, 0, np.uint64), len(heads))


def shared_keys(
    df: DataFrame, rows: Callable[[pa.RecordBatch], Rows | None], then: Callable[[Shared], dict], schema: str, many: int, top: int = 0, distinct: bool = False, cut: Callable = pieces
) -> DataFrame:
    """Count the keys of *rows*, which a piece of *df* gives, and let *then*
    make columns of *schema* from what comes back to each piece.  *many*: key
    blocks; *top*: keys below it that no other row has are told too;
    *distinct*: rows count by distinct places; *cut*: makes pieces of batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def send(batches):
        for piece in cut(batches):
            got = rows(piece)
            if got is not None:
                yield _send(got, many)

    def back(block: pa.Table) -> pa.Table:
        got = _gather(block)
        made = then(got) if got else {f.name: [] for f in arrow}
        return pa.table([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    counted = df.mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(_count(top, distinct), "piece binary, kind int, a binary, b binary, c binary")
    return counted.groupBy("piece").applyInArrow(back, schema)
