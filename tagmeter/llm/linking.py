"""Linking sets that are similar, from candidate buckets to components.

Input are buckets: any two ids that may link share a key.  Entries (key, id,
size) come packed in blocks of keys, so that a task handles a block as arrays.
Pairs are never listed whole:

1. In each block every bucket proposes a leader, the id with most company
   there; each id joins the cluster of the leader that most of its buckets
   propose.  Clusters fill row blocks of bounded bytes; one that is larger is
   cut, and its leader stands in every cut.
2. In a row block the sparse product of the incidence of ids by elements with
   itself accumulates the overlaps of all pairs of a cluster; pairs whose sizes
   differ too much are left out.  Links come back as a star for each component,
   and one contraction names the components found so far.
3. What is left are pairs that share a bucket but neither a component nor a row
   block.  In buckets of up to ``LARGE`` ids their shared keys are counted, a
   block of keys after the other; pairs below the count that their sizes
   demand are dropped, and the others verified.
4. Ids of larger buckets are cut into blocks by size, and for each two blocks
   that share such a bucket and sizes within reach, the product gives all
   overlaps at once.
5. Links are merged by distributed union-find.

So every pair of a bucket is verified, below a bound, or already in one
component, and components are exact for the buckets.

A key that more than ``HEAVY`` rows have doesn't stay in one task: its ids are
dealt to sub-buckets with leaders of their own, and these leaders join the
cluster of one of them.  Where a row block has many ids of one component under the
key, what is left of it is told by that row block and not by ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, mix64, scratch, table

#: Ids of a bucket whose pairs are counted one by one; rows beyond which a key
#: is heavy.
LARGE, HEAVY = 16, 1024
#: A row block holds this many units; an id has one for each UNIT elements,
#: and one for itself.
BLOCK, UNIT = 3000, 512
#: Ids of a heavy key, a row block and a component from which on they are told as one.
TOLD = 32
#: Ids of a cluster up to which its overlaps are added pair by pair.
SPARSE = 16

PACKED = "part int, key binary, id binary, n binary"
_VOTES = "part int, src int, id binary, lead binary, votes binary, n binary"

Expand = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


# ---- packed entries ----
def pack(key: np.ndarray, ids: np.ndarray, n: np.ndarray, count: np.ndarray, parts: int) -> dict:
    """Columns of PACKED: *key*, *ids* (rows of two uint64), *n* (the size of
    the id's set, or a bound of it) and how many rows have the key.  Entries of
    heavy keys have parts from *parts* on; a key is two numbers, its own or its
    sub-bucket's and its own."""
    heavy = count > HEAVY
    # an id of a heavy key goes to one of its sub-buckets
    sub = ids[:, 0] % (count.astype(np.uint64) // np.uint64(max(1, HEAVY)) + np.uint64(1))
    own = np.where(heavy, mix64(key + mix64(sub + np.uint64(1))), key)
    part = ((mix64(own) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64) + np.where(heavy, parts, 0)
    key = np.stack([own, key], axis=1)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    groups = np.split(order, cuts) if len(order) else []
    return {
        "part": [int(part[g[0]]) for g in groups], "key": [key[g].tobytes() for g in groups],
        "id": [ids[g].tobytes() for g in groups], "n": [n[g].astype(np.int64).tobytes() for g in groups],
    }


def id_rows(ids: bytes) -> np.ndarray:
    """16-byte ids as rows of two uint64."""
    return np.frombuffer(ids, np.uint64).reshape(-1, 2)


def ask(name: bytes, ids: np.ndarray, part: int = -2) -> dict:
    """A row of PACKED that asks a piece for the sets of *ids*."""
    return {"part": [part], "key": [name], "id": [ids.tobytes()], "n": [b""]}


def asked_sets(buckets: DataFrame, pieces: DataFrame, columns: list[str], sets: Callable[[dict, np.ndarray], list[bytes]]) -> DataFrame:
    """(id, set) of the ids that rows of ``ask`` name, each from one of the
    pieces that have it.  *pieces* has ``name`` and ``ids``; *sets* gives the
    sets of a piece's rows from its *columns*.  Narrow rows choose the piece;
    its columns are shuffled once, or not at all where at most SMALL_ROWS ids,
    of 16 bytes, are asked for and go out as a broadcast."""

    def listed(batches):
        for batch in batches:
            for name, ids in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([as_ids(id_rows(ids)), pa.array([name] * (len(ids) // 16), pa.binary())], ["id", "name"])

    asks = buckets.where("part = -2").select("key", "id").mapInArrow(listed, "id binary, name binary")
    asks = table(asks.groupBy("id").agg(F.min("name").alias("name")), "asked")
    few = asks.count() <= SMALL_ROWS
    asks = asks.groupBy("name").agg(F.collect_list("id").alias("__asked"))
    # pieces of equal content have one name
    one = pieces.select("name", F.monotonically_increasing_id().alias("__row"))
    one = one.groupBy("name").agg(F.min("__row").alias("__first"))
    asks = asks.join(one, "name").select(F.col("name").alias("__name"), "__first", "__asked")
    asks = F.broadcast(asks) if few else asks
    rows = pieces.select("name", "ids", *columns, F.monotonically_increasing_id().alias("__row"))
    rows = rows.join(asks, (rows["name"] == asks["__name"]) & (rows["__row"] == asks["__first"])).select("ids", *columns, "__asked")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                both, which = _numbered(np.concatenate([id_rows(row["ids"]), id_rows(b"".join(row["__asked"]))]))
                have = len(row["ids"]) // 16
                at = np.full(len(both), -1, np.int64)
                at[which[:have]] = np.arange(have)
                wanted = at[which[have:]]
                yield pa.RecordBatch.from_arrays([pa.array(row["__asked"], pa.binary()), pa.array(sets(row, wanted), pa.binary())], ["id", "set"])

    return rows.mapInArrow(run, "id binary, set binary")


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, the number of each row's id)."""
    high, first, inverse = np.unique(ids[:, 0], return_index=True, return_inverse=True)
    if (ids[first, 1][inverse] != ids[:, 1]).any():  # two ids with an equal half
        order = np.lexsort((ids[:, 1], ids[:, 0]))
        s = ids[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]).any(1)])
        inverse = np.empty(len(ids), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return s[new], inverse
    return ids[first], inverse


def found_in(ids: np.ndarray, these: np.ndarray) -> np.ndarray:
    """Which of *ids* are among *these*."""
    both, which = _numbered(np.concatenate([ids, these]))
    hit = np.zeros(len(both), bool)
    hit[which[len(ids) :]] = True
    return hit[which[: len(ids)]]


def as_ids(ids: np.ndarray) -> pa.Array:
    """Rows of two uint64 as binary."""
    offsets = np.arange(len(ids) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


class _Entries:
    """A block's entries without repeats, sorted by key, of the keys that two
    ids or more have; ``whole`` is the key that a sub-bucket belongs to."""

    def __init__(self, rows: pa.Table) -> None:
        pair = _joined(rows.column("key"), np.uint64).reshape(-1, 2)
        key, ids, n = pair[:, 0], _joined(rows.column("id"), np.uint64).reshape(-1, 2), _joined(rows.column("n"), np.int64)
        self.ids, who = _numbered(ids)
        self.n = np.zeros(len(self.ids), np.int64)
        self.n[who] = n
        order = np.lexsort((who, key))
        key, who, whole = key[order], who[order], pair[order, 1]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])])[: len(key)]
        key, who, whole = key[new], who[new], whole[new]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        many = np.diff(np.append(begin, len(key)))
        # a sub-bucket of one id is part of a larger bucket
        several = np.repeat(many > 1, many) | (key != whole)
        self.key, self.who, self.whole = key[several], who[several], whole[several]
        self.many = np.repeat(many, many)[several]

    def bucket(self) -> tuple[np.ndarray, np.ndarray]:
        """(where each bucket begins, the bucket of each entry)."""
        new = np.concatenate([[True], self.key[1:] != self.key[:-1]])[: len(self.key)]
        return np.flatnonzero(new), np.cumsum(new) - 1


def _by_id(ids: np.ndarray, parts: int) -> list[np.ndarray]:
    """Row numbers by the part of the id."""
    part = (ids[:, 1] % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []


def _part_of(ids: np.ndarray, at: np.ndarray, parts: int) -> int:
    return int(ids[at[0], 1] % np.uint64(parts))


def _propose(parts: int):
    def run(rows: pa.Table) -> pa.Table:
        e, src = _Entries(rows), rows.column("part")[0].as_py()
        out = []
        if len(e.key):
            score = np.bincount(e.who, weights=e.many, minlength=len(e.ids))
            begin, bucket = e.bucket()
            order = np.lexsort((e.who, score[e.who], bucket))
            lead = e.who[order[np.append(begin[1:], len(e.key)) - 1]]
            own = lead[bucket] != e.who
            pair, votes = np.unique(e.who[own] * len(e.ids) + lead[bucket[own]], return_counts=True)
            who, to = pair // len(e.ids), pair % len(e.ids)
            for at in _by_id(e.ids[who], parts):
                i = who[at]
                out.append((_part_of(e.ids, i, parts), src, e.ids[i].tobytes(), e.ids[to[at]].tobytes(), votes[at].astype(np.int32).tobytes(), e.n[i].tobytes()))
            if src >= parts:  # leaders of sub-buckets meet under the whole key
                out.append((-1, src, e.ids[lead].tobytes(), e.whole[begin].tobytes(), b"", e.n[lead].tobytes()))
            # leaders without a leader ask for their component too
            asks = np.setdiff1d(lead, who)
            for at in _by_id(e.ids[asks], parts):
                out.append((_part_of(e.ids, asks[at], parts), src, e.ids[asks[at]].tobytes(), b"", b"", b""))
        columns = zip(*out, strict=True) if out else [[]] * 6
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["part", "src", "id", "lead", "votes", "n"])

    return run


def _best(rows: pa.Table) -> pa.Table:
    """The leader of each id: the one with most votes, by id among equals."""
    ids, who = _numbered(_joined(rows.column("id"), np.uint64).reshape(-1, 2))
    leads, to = _numbered(_joined(rows.column("lead"), np.uint64).reshape(-1, 2))
    n = np.zeros(len(ids), np.int64)
    n[who] = _joined(rows.column("n"), np.int64)
    pair, which = np.unique(who * len(leads) + to, return_inverse=True)
    votes = np.bincount(which, weights=_joined(rows.column("votes"), np.int32), minlength=len(pair))
    order = np.lexsort((pair, votes, pair // max(1, len(leads))))
    last = np.flatnonzero(np.diff(np.append(pair[order] // max(1, len(leads)), -1)))
    chosen = pair[order[last]]
    return pa.table({"id": as_ids(ids[chosen // max(1, len(leads))]), "lead": as_ids(leads[chosen % max(1, len(leads))]), "n": pa.array(n[chosen // max(1, len(leads))])})


# ---- products ----
def as_stored(many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sets that are stored as they are: (elements, uint64, one set after the
    other, and how many each has)."""
    return np.frombuffer(b"".join(many), np.uint64), np.array([len(x) // 8 for x in many], np.int64)


def _columns(value: np.ndarray, owner: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, column, size): the incidence of owners by the elements that two
    owners or more of one *group* (of each owner) have, by column and owner,
    and the distinct elements of each owner.  *value* may repeat."""
    n = len(group)
    key = value + mix64(group.astype(np.uint64) + np.uint64(1))[owner]
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    run = np.cumsum(new) - 1
    last = np.concatenate([new[1:], [True]])[: len(key)]
    alone = new & last
    size = np.bincount(owner[alone], minlength=n)
    entry = np.sort(run[~alone] * n + owner[~alone])
    entry = entry[np.concatenate([[True], entry[1:] != entry[:-1]])[: len(entry)]]
    run, owner = entry // max(1, n), entry % max(1, n)
    size += np.bincount(owner, minlength=n)
    new = np.concatenate([[True], run[1:] != run[:-1]])[: len(run)]
    times = np.diff(np.append(np.flatnonzero(new), len(run)))
    keep = np.repeat(times > 1, times)
    return owner[keep], np.repeat(np.cumsum(times > 1) - 1, times)[keep], size


def _pairs_of(owner: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of owners within each column; *column* is sorted."""
    times = np.diff(np.append(np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])[: len(column)]), len(column)))
    left, right = [], []
    for d in range(1, int(times.max(initial=1))):
        at = np.flatnonzero(column[d:] == column[:-d])
        left.append(owner[at])
        right.append(owner[at + d])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least number in the component of each of *n*, by the links i, j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _similar(common, a, b, percent: int):
    return (100 * common >= percent * (a + b - common)) & (common > 0)


def _dense(column: np.ndarray, owner: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of one cluster by dense products of column blocks;
    *column* counts up from 0, *owner* is a row.  Rows go by size, so that
    row blocks out of each other's reach are left out."""
    order = np.argsort(size, kind="stable")
    place = np.empty(len(size), np.int64)
    place[order] = np.arange(len(size))
    row, sizes, step, left, right = place[owner], size[order], 256, [], []
    total = int(column.max(initial=-1)) + 1
    by_row = np.argsort(row, kind="stable")
    row, column = row[by_row], column[by_row]
    edge = np.searchsorted(row, np.arange(0, len(size) + step, step))
    for x in range(0, len(size), step):
        for y in range(x, len(size), step):
            if 100 * sizes[min(x + step, len(size)) - 1] < percent * sizes[y]:
                break
            many = [min(step, len(size) - k) for k in (x, y)]
            common = np.zeros(many, np.float32)
            for low in range(0, total, 4096):
                parts = []
                for k, m in zip((x, y), many, strict=True):
                    r, c = row[edge[k // step] : edge[k // step + 1]], column[edge[k // step] : edge[k // step + 1]]
                    inside = (c >= low) & (c < low + 4096)
                    d = np.zeros((m, min(4096, total - low)), np.float32)
                    d[r[inside] - k, c[inside] - low] = 1
                    parts.append(d)
                common += parts[0] @ parts[1].T
            i, j = np.nonzero(_similar(common, sizes[x : x + many[0], None], sizes[None, y : y + many[1]], percent))
            own = (i + x) < (j + y)
            left.append(order[i[own] + x])
            right.append(order[j[own] + y])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _within(percent: int, expand: Expand):
    """Links within the clusters of a row block: (a, b) with b the least id of
    a's component there."""

    def run(rows: pa.Table) -> pa.Table:
        ids, raw = rows.column("id").combine_chunks(), rows.column("set").to_pylist()
        cluster = np.unique(np.array(rows.column("lead").to_pylist(), object), return_inverse=True)[1] if len(ids) else np.empty(0, np.int64)
        value, many = expand(raw)
        del raw
        # an element of two clusters is two columns
        owner, column, size = _columns(value, np.repeat(np.arange(len(many)), many), cluster)
        group = cluster[owner]
        by_group = np.argsort(group, kind="stable")
        owner, column, group = owner[by_group], column[by_group], group[by_group]
        members = np.bincount(cluster, minlength=1)
        small = members[group] <= SPARSE
        a, b = _pairs_of(owner[small], column[small])
        pair, common = np.unique(a * len(size) + b, return_counts=True)
        a, b = pair // max(1, len(size)), pair % max(1, len(size))
        ok = _similar(common, size[a], size[b], percent)
        left, right = [a[ok]], [b[ok]]
        edge = np.searchsorted(group, np.arange(len(members) + 1))
        for g in np.flatnonzero(members > SPARSE).tolist():
            own = np.flatnonzero(cluster == g)
            at = slice(edge[g], edge[g + 1])
            i, j = _dense(np.unique(column[at], return_inverse=True)[1], np.searchsorted(own, owner[at]), size[own], percent)
            left.append(own[i])
            right.append(own[j])
        # numbers follow the ids, so the least number is the least id
        by_id = np.argsort(np.array(ids.to_pylist(), object), kind="stable")
        rank = np.empty(len(size), np.int64)
        rank[by_id] = np.arange(len(size))
        label = _labels(len(size), rank[np.concatenate(left)], rank[np.concatenate(right)])
        far = np.flatnonzero(label != np.arange(len(size)))
        return pa.table({"a": ids.take(pa.array(by_id[far])), "b": ids.take(pa.array(by_id[label[far]]))})

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int, expand: Expand) -> DataFrame:
    """The *pairs* (a, b) whose sets (id, set) reach *percent* of Jaccard."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                value, many = expand(part.column("x").to_pylist() + part.column("y").to_pylist())
                pair = np.tile(np.arange(part.num_rows), 2)
                owner, _, size = _columns(value, np.repeat(np.arange(len(many)), many), pair)
                common = np.bincount(pair[owner], minlength=part.num_rows) // 2
                mask = pa.array(_similar(common, size[: part.num_rows], size[part.num_rows :], percent), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


# ---- union-find ----
def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of union-find: (a, p) names each id of *edges* (a, b) by its
    least neighbour's hook; the edges between different names are left."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    hook = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
    above = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
    names = table(hook.join(above, "p").select("a", F.col("q").alias("p")), "names")
    return names, table(renamed(edges, names).distinct(), "edges")


def renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """*edges* between the names of their ends, where these differ."""
    one = edges.join(names, "a", "left").select(F.coalesce("p", "a").alias("a"), "b")
    other = names.select(F.col("a").alias("b"), F.col("p").alias("pb"))
    return one.join(other, "b", "left").select("a", F.coalesce("pb", "b").alias("b")).where("a <> b")


def components(edges: DataFrame, begun: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, component) of the ids in *edges* (a, b): the smallest id reachable.

    Distributed union-find by contraction: each id hooks to its least
    neighbour, follows that one's hook, and the edges are renamed; what is left
    between different names is a smaller graph, until nothing is left.  Each
    round is written to the shared folder, so a lost executor costs at most a
    round.  *begun*: names and remaining edges of a first round.
    """
    names, left = begun or _contract(edges)
    out = names.select(F.col("a").alias("id"), F.col("p").alias("component"))
    while not left.isEmpty():
        names, left = _contract(left)
        up = names.select(F.col("a").alias("__c"), F.col("p").alias("__next"))
        # ids that no edge of the rounds before had come in by themselves
        out = out.join(up, out["component"] == up["__c"], "full").select(F.coalesce("id", "__c").alias("id"), F.coalesce("__next", "component").alias("component"))
    return table(out, "labels")


# ---- the whole ----
def link(buckets: DataFrame, parts: int, sets: DataFrame, percent: int, expand: Expand = as_stored, sized: Callable[[int, int], int] | None = None, done: Callable[[], None] = lambda: None) -> DataFrame | None:
    """(id, component) of all ids that link with another; None if none may.

    *buckets*: rows of ``pack``, entries may repeat.  *sets*: (id, set) of the
    ids, as bytes that *expand* takes apart.  *sized*: where sizes are exact,
    how many keys two sets of given sizes share at least if they link; else
    None.  *done* is called once *sets* isn't read any more.
    """
    with scratch() as s:
        found = _link(buckets, parts, sets, percent, expand, sized, done)
        return found if found is None else s.keep(found)


def _link(buckets: DataFrame, parts: int, sets: DataFrame, percent: int, expand: Expand, sized: Callable | None, done: Callable[[], None]) -> DataFrame | None:
    votes = table(buckets.where("part >= 0").groupBy("part").applyInArrow(_propose(parts), _VOTES), "votes")
    heavy = not buckets.where(F.col("part") >= parts).isEmpty()
    chosen = votes.where("part >= 0 and octet_length(lead) > 0")
    if heavy:
        chosen = chosen.unionByName(_tops(votes, parts))
    pairs = table(chosen.groupBy("part").applyInArrow(_best, "id binary, lead binary, n long"), "pairs")

    units = F.col("n") / UNIT + 1
    clusters = pairs.groupBy("lead").agg(F.sum(units).cast("long").alias("units"))
    total = clusters.agg(F.sum("units")).first()[0]
    if total is None:
        return None
    large = clusters.where(F.col("units") > BLOCK // 4)
    block = F.when(F.col("units").isNull(), F.pmod(F.xxhash64("lead"), F.lit(max(1, total // BLOCK)))).otherwise(F.xxhash64("lead", F.pmod(F.xxhash64("id"), F.ceil(F.col("units") / BLOCK))))
    placed = table(pairs.join(large, "lead", "left").select("id", "lead", "n", block.alias("block")), "placed")
    members = placed.select("id", "lead", "block").unionByName(placed.select(F.col("lead").alias("id"), "lead", "block").distinct())
    sets = table(sets, "sets", packed=True, blobs=True)
    done()
    rows = members.join(sets, "id").select("block", "lead", "id", "set")
    edges = table(rows.groupBy("block").applyInArrow(_within(percent, expand), "a binary, b binary"), "links")
    names, left = _contract(edges)

    # what the entries need to know of their ids; a leader that follows none stands in its own cluster
    known = placed.select("id", "lead", "block")
    alone = members.join(placed.select("id"), "id", "left_anti").groupBy("id").agg(F.min("block").alias("block"))
    known = known.unionByName(alone.select("id", F.col("id").alias("lead"), "block")).join(names.withColumnRenamed("a", "__a"), F.col("id") == F.col("__a"), "left")
    known = table(known.select("id", F.coalesce("p", "id").alias("c"), "lead", "block"), "known")
    asked = votes.where("part >= 0").select("part", F.lit(0).alias("kind"), "src", "id", F.lit(b"").alias("c"), F.lit(b"").alias("lead"), F.lit(b"").alias("block"))
    answers = asked.unionByName(known.mapInArrow(_packed_known(parts), _KNOWN)).groupBy("part").applyInArrow(_answer, _KNOWN)
    nothing = F.lit(b"")
    entries = buckets.where("part >= 0").select("part", F.lit(0).alias("kind"), "key", "id", "n", nothing.alias("c"), nothing.alias("lead"), nothing.alias("block"))
    told = answers.select(F.col("src").alias("part"), F.lit(1).alias("kind"), nothing.alias("key"), "id", nothing.alias("n"), "c", "lead", "block")
    open_ = table(entries.unionByName(told).groupBy("part").applyInArrow(_open(percent, sized is not None, parts), _OPEN), "open")

    counted = open_.where("kind = 0").groupBy("a", "b").agg(F.sum("x").alias("common"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    if sized is not None:
        counted = counted.where(F.col("common") >= sized(F.col("na"), F.col("nb")))
    more = verify(counted.select("a", "b"), sets, percent, expand)
    wide = open_.where("kind in (1, 3)").select("key", F.col("a").alias("id"), F.col("b").alias("c"), F.col("na").alias("n"))
    groups = open_.where("kind = 2").select("key", F.col("x").alias("block"), F.col("a").alias("c"), "na", "nb") if heavy else None
    if not open_.where("kind > 0").isEmpty():
        more = more.unionByName(_large(wide, groups, members, known, sets, percent, expand, sized is not None))
    more = table(more, "links")
    left = table(left.unionByName(renamed(more, names)).distinct(), "edges") if not more.isEmpty() else left
    return components(edges, (names, left))


def _tops(votes: DataFrame, parts: int) -> DataFrame:
    """Votes of the leaders of a heavy key's sub-buckets for one of them."""

    def listed(batches):
        for batch in batches:
            for k, i, n in zip(*(batch.column(c).to_pylist() for c in ("lead", "id", "n")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), as_ids(id_rows(i)), pa.array(np.frombuffer(n, np.int64))], ["key", "id", "n"])

    leads = votes.where("part = -1").select("lead", "id", "n").mapInArrow(listed, "key long, id binary, n long")
    top = leads.groupBy("key").agg(F.max_by("id", F.struct("n", "id")).alias("lead"))
    met = leads.join(top, "key").where("id <> lead").groupBy("id", "lead").agg(F.count("*").alias("votes"), F.max("n").alias("n"))

    def run(batches):
        for batch in batches:
            ids, lead = (id_rows(b"".join(batch.column(c).to_pylist())) for c in ("id", "lead"))
            # a leader that all others of its sub-bucket follow had no vote so far
            votes, n = batch.column("votes").to_numpy().astype(np.int32), batch.column("n").to_numpy()
            out = [(_part_of(ids, at, parts), -1, ids[at].tobytes(), lead[at].tobytes(), votes[at].tobytes(), n[at].tobytes()) for at in _by_id(ids, parts)]
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names=["part", "src", "id", "lead", "votes", "n"])

    return met.select("id", "lead", "votes", "n").mapInArrow(run, _VOTES)


_KNOWN = "part int, kind int, src int, id binary, c binary, lead binary, block binary"
_KNOWN_NAMES = ["part", "kind", "src", "id", "c", "lead", "block"]
_KNOWN_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _packed_known(parts: int):
    def run(batches):
        for batch in batches:
            ids, c, lead = (id_rows(b"".join(batch.column(k).to_pylist())) for k in ("id", "c", "lead"))
            block = batch.column("block").to_numpy()
            out = [(_part_of(ids, at, parts), 1, 0, ids[at].tobytes(), c[at].tobytes(), lead[at].tobytes(), block[at].tobytes()) for at in _by_id(ids, parts)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, _KNOWN_TYPES, strict=True)], names=_KNOWN_NAMES)

    return run


def _answer(rows: pa.Table) -> pa.Table:
    """What is known of the ids that each block of keys asks for."""
    kind = rows.column("kind").to_numpy()
    told, asks = rows.filter(pa.array(kind == 1)), rows.filter(pa.array(kind == 0))
    ids = _joined(told.column("id"), np.uint64).reshape(-1, 2)
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    ids = ids[order]
    c, lead = (_joined(told.column(k), np.uint64).reshape(-1, 2)[order] for k in ("c", "lead"))
    block = _joined(told.column("block"), np.int64)[order]
    wanted = asks.column("id").to_pylist()
    src = np.repeat(asks.column("src").to_numpy(), [len(x) // 16 for x in wanted]) if wanted else np.empty(0, np.int32)
    want = id_rows(b"".join(wanted))
    both, which = _numbered(np.concatenate([ids, want]))
    place = np.full(len(both), -1, np.int64)
    place[which[: len(ids)]] = np.arange(len(ids))
    at = place[which[len(ids) :]]
    found = at >= 0
    at, src = at[found], src[found]
    own = np.unique(src.astype(np.int64) * (len(ids) + 1) + at)
    src, at = own // (len(ids) + 1), own % (len(ids) + 1)
    out = []
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(src)) + 1) if len(at) else ():
        k = at[part]
        out.append((0, 1, int(src[part[0]]), ids[k].tobytes(), c[k].tobytes(), lead[k].tobytes(), block[k].tobytes()))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, _KNOWN_TYPES, strict=True)], names=_KNOWN_NAMES)


_OPEN = "kind int, key long, a binary, b binary, x long, na long, nb long"


def _open(percent: int, sized: bool, parts: int):
    """Of a block's entries, what no step has settled yet: pairs of small
    buckets (a, b, shared keys x, sizes), kind 0, and the ids of larger ones (a
    with component b), kind 1."""

    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_numpy()
        e, told = _Entries(rows.filter(pa.array(kind == 0))), rows.filter(pa.array(kind == 1))
        ids = _joined(told.column("id"), np.uint64).reshape(-1, 2)
        c, lead = (_joined(told.column(k), np.uint64).reshape(-1, 2) for k in ("c", "lead"))
        # numbers for ids, components and leaders alike
        names, number = _numbered(np.concatenate([e.ids, ids, c, lead])) if len(e.ids) + len(ids) else (e.ids, np.empty(0, np.int64))
        own, ids, c, lead = np.split(number, np.cumsum([len(e.ids), len(ids), len(c)]))
        comp, led, block = np.arange(len(names)), np.full(len(names), -1), np.zeros(len(names), np.int64)
        comp[ids], led[ids], block[ids] = c, lead, _joined(told.column("block"), np.int64)
        comp, led, block = comp[own], led[own], block[own]
        begin, bucket = e.bucket()
        out = []
        if len(e.key) and rows.column("part")[0].as_py() >= parts:
            # entries by whole key, block and component; those of many ids are told as one
            order = np.lexsort((comp[e.who], block[e.who], e.whole))
            who, key = e.who[order], e.whole[order]
            differ = [v[1:] != v[:-1] for v in (key, block[who], comp[who])]
            group = np.flatnonzero(np.concatenate([[True], differ[0] | differ[1] | differ[2]]))
            times = np.diff(np.append(group, len(who)))
            least, most = (f(e.n[who], group) for f in (np.minimum.reduceat, np.maximum.reduceat))
            g = group[times >= TOLD]
            big = np.repeat(times >= TOLD, times)
            out.append((np.full(len(g), 2, np.int32), key[g].view(np.int64), names[comp[who[g]]], e.ids[who[g]], block[who[g]], least[times >= TOLD], most[times >= TOLD]))
            k, w = key[~big], who[~big]
            out.append((np.full(len(k), 3, np.int32), k.view(np.int64), e.ids[w], names[comp[w]], block[w], e.n[w], e.n[w]))
        elif len(e.key):
            mixed = np.maximum.reduceat(comp[e.who], begin) != np.minimum.reduceat(comp[e.who], begin)
            keep = mixed[bucket]
            key, who, many = e.key[keep], e.who[keep], e.many[keep]
            few = many <= LARGE
            k, w = key[few], who[few]
            left, right = [], []
            for d in range(1, LARGE):
                at = np.flatnonzero(k[d:] == k[:-d])
                i, j = w[at], w[at + d]
                fresh = comp[i] != comp[j]
                if sized:
                    fresh &= 100 * np.minimum(e.n[i], e.n[j]) >= percent * np.maximum(e.n[i], e.n[j])
                # both in one row block, or one leads the other: compared already
                fresh &= ~((led[i] == led[j]) & (block[i] == block[j]) & (led[i] >= 0)) & (led[i] != own[j]) & (led[j] != own[i])
                left.append(i[fresh])
                right.append(j[fresh])
            i, j = np.concatenate(left), np.concatenate(right)
            pair, times = np.unique(np.minimum(i, j) * len(e.ids) + np.maximum(i, j), return_counts=True)
            i, j = pair // len(e.ids), pair % len(e.ids)
            out.append((np.zeros(len(i), np.int32), np.zeros(len(i), np.int64), e.ids[i], e.ids[j], times, e.n[i], e.n[j]))
            k, w = key[~few], who[~few]
            out.append((np.ones(len(k), np.int32), k.view(np.int64), e.ids[w], names[comp[w]], many[~few], e.n[w], e.n[w]))
        tables = [pa.table([pa.array(x[0]), pa.array(x[1]), as_ids(x[2]), as_ids(x[3]), *(pa.array(v.astype(np.int64)) for v in x[4:])], names=["kind", "key", "a", "b", "x", "na", "nb"]) for x in out]
        empty = pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())], names=["kind", "key", "a", "b", "x", "na", "nb"])
        return pa.concat_tables([empty, *tables])

    return run


def _cut(members: DataFrame, name: str) -> DataFrame:
    """*members* (label, band, id, c, n) with a block of bounded units."""
    units = F.ceil(F.sum(F.col("n") / UNIT + 1) / BLOCK)
    parts = members.groupBy("label", "band").agg(units.alias("parts"))
    return members.join(parts, ["label", "band"]).select("id", "c", "n", F.xxhash64("label", "band", F.pmod(F.xxhash64("id"), "parts")).alias(name))


def _large(rows: DataFrame, groups: DataFrame | None, members: DataFrame, known: DataFrame, sets: DataFrame, percent: int, expand: Expand, sized: bool) -> DataFrame:
    """Links between different components of large buckets, *rows* (key, id, c,
    n) and *groups* (key, row block, c, sizes na to nb): what is outside a
    bucket's largest component against the whole bucket, block by block.  Ids
    are cut into blocks anew, where sizes are exact by bands of them; only
    blocks whose sizes are within reach meet."""
    share = rows.groupBy("key", "c").agg(F.count("*").alias("own"))
    if groups is not None:
        share = share.unionByName(groups.groupBy("key", "c").agg((F.count("*") * TOLD).alias("own"))).groupBy("key", "c").agg(F.sum("own").alias("own"))
    # keys of one component are settled
    major = share.groupBy("key").agg(F.max_by("c", F.struct("own", "c")).alias("major"), F.sum("own").alias("many"), F.count("*").alias("kinds")).where("kinds > 1")
    split = table(rows.join(major, "key"), "split")
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.log(F.lit(100 / percent)) + 1e-9).cast("int") if sized else F.lit(0)
    # ids whose largest bucket has the same largest component lie in the same blocks
    own = split.groupBy("id", "c").agg(F.max_by("major", F.struct("many", "key")).alias("label"), F.max("n").alias("n")).withColumn("band", band)
    own = table(_cut(table(own, "members"), "unit"), "blocks")
    reach = own.groupBy("unit").agg(F.min("n").alias("na"), F.max("n").alias("nb"))
    parts = split.select("key", "id", (F.col("c") != F.col("major")).alias("odd")).join(own.select("id", "unit"), "id").groupBy("key", "unit").agg(F.max("odd").alias("odd")).join(reach, "unit")
    content = own.select("unit", "id", "c")
    if groups is not None:
        told = groups.join(major, "key").groupBy("key", F.xxhash64(F.lit("row block"), "block").alias("unit")).agg(F.max(F.col("c") != F.col("major")).alias("odd"), F.min("na").alias("na"), F.max("nb").alias("nb"))
        parts = parts.unionByName(told.select(*parts.columns))
    parts = table(parts, "parts")
    left = parts.where("odd").select("key", F.col("unit").alias("one"), F.col("na").alias("na2"), F.col("nb").alias("nb2"))
    near = (F.col("nb") * 100 >= F.col("na2") * percent) & (F.col("nb2") * 100 >= F.col("na") * percent) if sized else F.lit(True)
    tasks = left.join(parts.select("key", "unit", "na", "nb"), "key").where(near).select(F.least("one", "unit").alias("one"), F.greatest("one", "unit").alias("two")).distinct()
    tasks = table(tasks.withColumn("task", F.xxhash64("one", "two")), "tasks")
    if groups is not None:
        wanted = parts.select("unit").distinct()
        whole = members.select(F.xxhash64(F.lit("row block"), "block").alias("unit"), "id").distinct().join(wanted, "unit", "left_semi")
        content = content.unionByName(whole.join(known.select("id", "c"), "id").select("unit", "id", "c"))
    content = content.join(sets, "id")
    sides = [tasks.select(F.col(c).alias("unit"), "task", F.lit(k).alias("side")) for k, c in enumerate(("one", "two"))]
    return sides[0].unionByName(sides[1]).join(content, "unit").select("task", "side", "id", "c", "set").groupBy("task").applyInArrow(_between(percent, expand), "a binary, b binary")


def _between(percent: int, expand: Expand):
    """All overlaps of two blocks by a sparse product of their incidences;
    links come back as a spanning forest over the components known so far."""

    def run(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        ids, comp, raw = rows.column("id").to_pylist(), rows.column("c").to_pylist(), rows.column("set").to_pylist()
        order = np.argsort(side, kind="stable")
        half = int((side == 0).sum())
        at = [order[:half], order[half:]]
        value, many = expand([raw[i] for i in order.tolist()])
        owner, column, sizes = _columns(value, np.repeat(np.arange(len(many)), many), np.zeros(len(many), np.int64))
        size = [sizes[:half], sizes[half:]]
        count = [np.bincount(column[owner < half], minlength=column.max(initial=-1) + 1), np.bincount(column[owner >= half], minlength=column.max(initial=-1) + 1)]
        a: list[bytes] = []
        b: list[bytes] = []
        if len(column):
            common = np.zeros((half, len(many) - half), np.float32)
            # rare columns add their pairs one by one, frequent ones by dense products
            often = count[0] * count[1] > 64
            rare = ~often[column] & (count[0] > 0)[column] & (count[1] > 0)[column]
            first = rare & (owner < half)
            second = owner[rare & (owner >= half)] - half
            times = count[1][column[first]]
            rare_many = np.where(often | (count[0] == 0), 0, count[1])
            begin = (np.cumsum(rare_many) - rare_many)[column[first]]
            to = second[np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)]
            np.add.at(common, (np.repeat(owner[first], times), to), 1)
            number, total = np.cumsum(often) - 1, int(often.sum())
            place = [number[column[often[column] & s]] for s in (owner < half, owner >= half)]
            who = [owner[often[column] & (owner < half)], owner[often[column] & (owner >= half)] - half]
            for low in range(0, total, 2048):
                dense = []
                for k in (0, 1):
                    inside = (place[k] >= low) & (place[k] < low + 2048)
                    d = np.zeros((len(at[k]), min(2048, total - low)), np.float32)
                    d[who[k][inside], place[k][inside] - low] = 1
                    dense.append(d)
                common += dense[0] @ dense[1].T
            x, y = np.nonzero(_similar(common, size[0][:, None], size[1][None, :], percent))
            names = {c: i for i, c in enumerate(sorted(set(comp)))}
            number = np.array([names[c] for c in comp])
            i, j = number[at[0][x]], number[at[1][y]]
            fresh = np.flatnonzero(i != j)
            # one link for each two components
            _, first = np.unique(np.minimum(i, j)[fresh] * len(names) + np.maximum(i, j)[fresh], return_index=True)
            root = list(range(len(names)))

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for k in fresh[first].tolist():
                p, q = find(int(i[k])), find(int(j[k]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    a.append(ids[at[0][x[k]]])
                    b.append(ids[at[1][y[k]]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run
