"""Operator 8, URL filters: prefix rules, then a Bloom filter cascade of hosts.

The list is a table of hosts; an entry stands for its host and all subdomains.
Without one, a list is compiled from the corpus by words in host labels, as
category lists are.  The cascade answers membership exactly over the corpus's
complete key universe, its distinct hosts: level 0 encodes the listed keys,
level 1 the universe's keys that level 0 passes by mistake, level 2 the listed
keys that level 1 passes by mistake, and so on until a level passes none.  A
key's verdict is the parity of the first level that stops it.

Levels are built by grouped bit_or over distinct keys, so only bit words reach
the driver, and they go out as a broadcast.  Keys are dealt to shards by hash,
as many as keep each level below ``MAX_BITS``; pages pass through one shard's
cascade after the other, so no join is needed at any size of the list.

Defined cases: a null url or one without ``://`` has empty host and path, fits
no rule and isn't listed; repeated or null entries of a list count once or not
at all; repeated rows get equal verdicts; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_pieces, scratch, table

#: Rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words in a registered name that put a host on the list.
LISTED_WORDS = ("spam", "pills", "casino", "bets", "adult", "porn", "track")

#: Bits for each key of a level, hash functions, and the bound of a level.
BITS_PER_KEY, HASHES, MAX_BITS = 12, 4, 1 << 28


def with_parts(pages: DataFrame) -> DataFrame:
    """*pages*' page_id and url with host and path."""
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule = verdict = None
    for what, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)) if rule is None else rule.when(fits, F.lit(host + path))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return rule, verdict


def compiled_list(universe: DataFrame, words=LISTED_WORDS) -> DataFrame:
    """(host): the hosts of *universe* (key) whose labels hold a listed word."""
    return universe.where(F.col("key").rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)")).select(F.col("key").alias("host"))


def with_listed(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """*universe* (key) with ``listed``: whether the key or a parent of it is a
    host of *listed*.  Only distinct keys and their parents are shuffled."""
    hosts = listed.select(F.lower("host").alias("__host")).where("__host is not null and __host <> ''").distinct()
    labels = F.split("key", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = universe.select("key", F.explode(parents).alias("__parent")).join(hosts, F.col("__parent") == F.col("__host"), "left_semi")
    met = met.select(F.col("key").alias("__met")).distinct()
    return universe.join(met, F.col("key") == F.col("__met"), "left").select("key", F.col("__met").isNotNull().alias("listed"))


class Cascade:
    """Levels of (bits as bytes, number of bits); immutable."""

    def __init__(self, levels: list[tuple[np.ndarray, int]]) -> None:
        self.levels = levels

    @staticmethod
    def places(keys: list[str], level: int, m: int) -> np.ndarray:
        import xxhash

        h = np.array([xxhash.xxh3_64_intdigest(k.encode(), seed=level) for k in keys], np.uint64)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(m)).astype(np.int64)

    def passes(self, keys: list[str], level: int) -> np.ndarray:
        bits, m = self.levels[level]
        at = self.places(keys, level, m)
        return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(1)

    def members(self, keys: list[str]) -> np.ndarray:
        """Exact for the keys of the universe that the cascade was built on."""
        out, at = np.zeros(len(keys), bool), np.arange(len(keys))
        for level in range(len(self.levels)):
            if not len(at):
                break
            ok = self.passes([keys[i] for i in at.tolist()], level)
            out[at[~ok]] = level % 2 == 1
            at = at[ok]
        out[at] = len(self.levels) % 2 == 1
        return out


def shard_of(keys: list[str], shards: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(k.encode(), seed=1 << 20) % shards for k in keys], np.int64)


#: Bit words that travel to the driver in one row.
WORDS = 1 << 14


def build(universe: DataFrame, bits_per_key: int = BITS_PER_KEY, shard: int = 0, shards: int = 1) -> Cascade:
    """A cascade for the keys of one shard of *universe* (distinct ``key``,
    boolean ``listed``)."""
    levels: list[tuple[np.ndarray, int]] = []
    spark = universe.sparkSession
    while True:
        level, cascade = len(levels), spark.sparkContext.broadcast(Cascade(list(levels)))

        def encoded(batches, level=level, cascade=cascade):
            """The keys that this level encodes: those of its side that pass all levels below."""
            for batch in batches:
                keys, listed = batch.column("key").to_pylist(), np.array(batch.column("listed").to_pylist(), bool)
                own = np.flatnonzero(listed == (level % 2 == 0))
                if shards > 1 and len(own):
                    own = own[shard_of([keys[i] for i in own.tolist()], shards) == shard]
                for below in range(level):
                    if len(own):
                        own = own[cascade.value.passes([keys[i] for i in own.tolist()], below)]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in own.tolist()], pa.string())], ["key"])

        todo = universe.select("key", "listed").mapInArrow(encoded, "key string")
        many = todo.count()
        if level and not many:
            return Cascade(levels)
        m = max(64, many * bits_per_key)

        def words(batches, level=level, m=m):
            for batch in batches:
                at = np.unique(Cascade.places(batch.column("key").to_pylist(), level, m)) if batch.num_rows else np.empty(0, np.int64)
                word, which = np.unique(at >> 5, return_inverse=True)
                bits = np.zeros(len(word), np.int64)
                np.bitwise_or.at(bits, which, np.int64(1) << (at & 31))
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(bits, pa.int64())], ["word", "bits"])

        def packed(rows: pa.Table) -> pa.Table:
            block, out = rows.column("block")[0].as_py(), np.zeros(WORDS, np.uint32)
            out[rows.column("word").to_numpy() - block * WORDS] = rows.column("bits").to_numpy().astype(np.uint32)
            return pa.table({"block": pa.array([block], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

        got = todo.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        got = got.withColumn("block", F.shiftright("word", 14)).groupBy("block").applyInArrow(packed, "block long, bits binary")
        bits = np.zeros(-(-((m + 31) // 32) // WORDS) * WORDS, np.uint32)
        for row in got.toLocalIterator():
            bits[row.block * WORDS : (row.block + 1) * WORDS] = np.frombuffer(row.bits, np.uint32)
        levels.append((bits.view(np.uint8), m))
        if not many:
            return Cascade(levels)


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, words=LISTED_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed.  *listed*: hosts; without it
    a list is compiled by *words*."""
    parts = with_parts(pages)
    with scratch():
        hosts = table(parts.select(F.col("host").alias("key")).distinct(), "hosts")
        universe = table(with_listed(hosts, compiled_list(hosts, words) if listed is None else listed), "universe")
        shards = max(1, -(-universe.where("listed").count() * BITS_PER_KEY // max_bits))
        cascades = [build(universe, shard=k, shards=shards) for k in range(shards)]
    seen = parts.select("page_id", "host", "path", F.lit(False).alias("listed"))
    kind = pages.schema["page_id"].dataType.simpleString()
    for k, cascade in enumerate(cascades):
        shared = pages.sparkSession.sparkContext.broadcast(cascade)

        def make(piece: pa.RecordBatch, k=k, shared=shared) -> dict:
            hosts = piece.column("host").dictionary_encode()
            keys = hosts.dictionary.to_pylist()
            known = shared.value.members(keys) & (shard_of(keys, shards) == k if shards > 1 else True)
            had = piece.column("listed").to_numpy(zero_copy_only=False)
            return {c: piece.column(c) for c in ("page_id", "host", "path")} | {"listed": pa.array(had | known[hosts.indices.to_numpy()])}

        seen = map_pieces(seen, make, f"page_id {kind}, host string, path string, listed boolean", "host")
    rule, verdict = rule_of(rules)
    return seen.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def op8_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _sql() -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v) for v, h, p in order]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    return rf"""
WITH r AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r),
c AS (SELECT DISTINCT host AS entry FROM p WHERE host <> '' AND regexp_matches(host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)')),
l AS (SELECT *, EXISTS (SELECT 1 FROM c WHERE host = entry OR ends_with(host, '.' || entry)) AS listed FROM p)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM l"""


QUERIES = {"op8_urls": op8_urls}
ORACLES = {"op8_urls": _sql()}
