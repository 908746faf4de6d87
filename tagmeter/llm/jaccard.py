"""Operator 7, n-gram Jaccard join as a blocked sparse matrix product.

Rows of the document by n-gram incidence matrix come in blocks, one for each
piece of text; columns come in blocks by n-gram hash.  A first product, of the
incidence with its own column counts, gives for each document how many of its
n-grams no other document has.  It needs only the columns whose hash lies below
``REGION``: a document with more unshared ones there than the bound
n - ceil(t n) can't reach similarity t with any other, so it is discarded.  For
the others, n-grams in ascending order of their counts form a prefix of
n - ceil(t n) + 1; two documents that link share an n-gram of both prefixes,
and the closer their sizes, the more (``shared_at_least``).

Documents that share prefix columns are brought together in row blocks, and the
product of these rows with themselves over all columns gives the overlaps, as
``linking`` describes; pairs across row blocks add up their shared prefix
columns, block of columns by block, and fall out below the bound that their
sizes set.  What is left is multiplied too.

Documents with equal sets are one class from the start, known by a 128-bit
digest.  Within a block, n-grams that several documents have are counted and
sent once, so an n-gram that a third of all documents have costs a row for
each block.

Defined cases: a null or wordless text has an empty set and links with
nothing; with fewer words than n, the whole sequence is the one n-gram; equal
rows are in one component; a null doc_id links like others, but never names a
component unless its component has no other id (then null).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, map_pieces, scratch, table, texts, window_hashes, word_hashes
from .incidence import Rows, Shared, fingerprints, key_blocks, marks, name_of, row_pieces, shared_keys
from .linking import PACKED, ask, asked_sets, id_rows, link, pack

N, PERCENT = 5, 75
#: Share of the hash range, in eighths, whose columns are counted.
REGION = 3

_TOP = np.uint64(REGION << 61)


def shingles(many: list[bytes], n: int = N) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    lists = [t.lower().split() for t in many]
    flat = word_hashes([w for x in lists for w in x])
    out, at = [], 0
    for words in lists:
        h = flat[at : at + len(words)]
        at += len(words)
        if not len(h):
            out.append(np.empty(0, np.uint64))
        elif len(h) < n:
            # shorter sequences are told apart by their length
            out.append(window_hashes(h, len(h)) ^ np.uint64(len(h)))
        else:
            out.append(np.unique(window_hashes(h, n)))
    return out


def digest_of(grams: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes())


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def pieces_of(docs: DataFrame, n: int = N) -> DataFrame:
    """Row blocks of the incidence matrix, one for each piece of text: its
    distinct sets (ids, sizes, grams) and its rows (doc_id, text_hash, and
    which set each has, -1 for an empty one)."""

    def make(piece: pa.RecordBatch) -> dict:
        rows: dict[bytes, int] = {}
        kept, which = [], []
        for grams in shingles(texts(piece), n):
            if not len(grams):
                which.append(-1)
                continue
            name = digest_of(grams)
            if name not in rows:
                rows[name] = len(rows)
                kept.append(grams)
            which.append(rows[name])
        ids, size = b"".join(rows), [len(g) for g in kept]
        salt = fingerprints(ids)[1] if kept else 0
        sizes = np.array([salt, *size], np.int64).tobytes()
        made = {"name": [name_of((ids, sizes))], "ids": [ids], "sizes": [sizes], "grams": [b"".join(g.tobytes() for g in kept)], "many": [sum(size)]}
        return made | {c: [piece.column(c).to_pylist()] for c in ("doc_id", "text_hash")} | {"which": [which]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_pieces(rows, make, f"name binary, ids binary, sizes binary, grams binary, many long, doc_id array<{kind}>, text_hash array<long>, which array<int>")


def classes(pieces: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles and digest (null for an empty set) of
    each row."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                which = batch.column("which")[i].values.to_numpy()
                ids, size = id_rows(batch.column("ids")[i].as_py()), np.frombuffer(batch.column("sizes")[i].as_py(), np.int64)[1:]
                size = np.append(size, 0)[which]
                digest = [None if k < 0 else ids[k].tobytes() for k in which.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i].values, batch.column("text_hash")[i].values, pa.array(size), pa.array(digest, pa.binary())], ["doc_id", "text_hash", "n_shingles", "digest"])

    kind = pieces.schema["doc_id"].dataType.elementType.simpleString()
    return pieces.select("ids", "sizes", "doc_id", "text_hash", "which").mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, digest binary")


def _block(percent: int):
    """Rows of the incidence: a piece's distinct sets, with the columns that
    are counted, or where these don't fill the prefix the next ones too."""

    def run(piece: pa.RecordBatch) -> Rows | None:
        ids, sizes = piece.column("ids")[0].as_py(), piece.column("sizes")[0].as_py()
        if not ids:
            return None
        size = np.frombuffer(sizes, np.int64)
        salt, size = int(size[0]), size[1:]
        grams = np.frombuffer(piece.column("grams")[0].as_py(), np.uint64)
        who = np.repeat(np.arange(len(size)), size)
        low = np.bincount(who[grams < _TOP], minlength=len(size))
        sent = np.maximum(low, [prefix(int(k), percent) for k in size])
        begin = np.cumsum(size) - size
        keep = np.arange(len(grams)) - begin[who] < sent[who]
        return Rows(grams[keep], marks(ids, salt)[who[keep]], who[keep], (ids, sizes))

    return run


def _prefixes(percent: int, parts: int):
    """Prefix n-grams of the rows of a piece that the bound leaves."""

    def run(got: Shared) -> dict:
        ids, size = id_rows(got.head[0]), np.frombuffer(got.head[1], np.int64)
        mark, size = marks(got.head[0], int(size[0])), size[1:]
        by_mark = np.argsort(mark)
        row = lambda places: by_mark[np.searchsorted(mark[by_mark], places)]
        alone = np.bincount(row(got.lone), minlength=len(size)) // got.copies
        room = np.array([prefix(int(x), percent) for x in size]) - alone
        who = row(got.place)
        fits = room[who] > 0
        gram, who, count = got.key[fits], who[fits], got.count[fits]
        # counted columns first, by count; the others by hash
        order = np.lexsort((gram, np.where(gram < _TOP, count, 0), gram >= _TOP, who))
        gram, who, count = gram[order], who[order], count[order]
        take = np.arange(len(who)) - np.searchsorted(who, who) < room[who]
        gram, who, count = gram[take], who[take], count[take]
        if not len(who):
            return {c: [] for c in ("part", "key", "id", "n")}
        made, asks = pack(gram, ids[who], size[who], count, parts), ask(name_of(got.head), ids[np.unique(who)])
        return {c: made[c] + asks[c] for c in made}

    return run


def shared_at_least(percent: int):
    """How many prefix n-grams two sets of sizes a and b share at least if
    they reach *percent*: prefixes leave at most n - p of each set out."""

    def run(a: Column, b: Column) -> Column:
        least = F.ceil((a + b) * percent / (100 + percent) - 1e-9)
        room = [F.ceil(x * percent / 100 - 1e-9) for x in (a, b)]
        return F.least(least - room[0], least - room[1]) + 1

    return run


def _stored(row: dict, wanted: np.ndarray) -> list[bytes]:
    end = 8 * np.cumsum(np.frombuffer(row["sizes"], np.int64)[1:])
    begin = np.concatenate([[0], end])
    return [row["grams"][begin[i] : end[i]] for i in wanted.tolist()]


def linked(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (null for an empty set) and
    component_id of each row."""
    spark = docs.sparkSession
    with scratch() as s:
        pieces = table(pieces_of(docs, n), "pieces", packed=True)
        rows = s.keep(table(classes(pieces), "classes", blobs=True))
        total = pieces.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
        parts = key_blocks(spark, total * REGION // 8)
        buckets = table(shared_keys(pieces.select("ids", "sizes", "grams"), _block(percent), _prefixes(percent, parts), PACKED, parts, int(_TOP), distinct=True, cut=row_pieces), "prefixes", blobs=True)
        found = link(buckets, parts, asked_sets(buckets, pieces, ["sizes", "grams"], _stored), percent, sized=shared_at_least(percent), done=lambda: drop(pieces))
        named = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("own"))
        if found is None:
            named = named.select("digest", F.col("digest").alias("component"), F.col("own").alias("component_id"))
        else:
            named = named.join(found, named["digest"] == found["id"], "left").select("digest", "own", F.coalesce("component", "digest").alias("component"))
            named = table(named, "components")
            least = named.groupBy("component").agg(F.min("own").alias("component_id"))
            named = named.join(least, "component").select("digest", "component", "component_id")
        named = s.keep(table(named.withColumnRenamed("digest", "__tm_digest"), "components"))
    out = rows.join(named, rows["digest"] == named["__tm_digest"], "left")
    return out.select("doc_id", "text_hash", "n_shingles", "component", F.when(F.col("digest").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """*docs* with one row of each component: that of its smallest doc_id, and
    of repeated rows one.  Rows with an empty set all stay."""
    names = docs.columns
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("r")
    chosen = linked(docs, n, percent).where("component is not null").groupBy("component").agg(first).select(F.col("r.doc_id").alias("__tm_d"), F.col("r.text_hash").alias("__tm_t"))
    has_word = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = docs.withColumn("__tm_hash", F.xxhash64("text"))
    kept = rows.where(has_word).join(chosen, F.col("doc_id").eqNullSafe(F.col("__tm_d")) & (F.col("__tm_hash") == F.col("__tm_t")), "left_semi").dropDuplicates(["doc_id", "__tm_hash"])
    return kept.select(*names).unionByName(docs.where(~has_word))


WORD = r"[^\x20\x09-\x0D]"


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""

QUERIES = {"op7_jaccard": op7_jaccard}
ORACLES = {"op7_jaccard": SQL}
