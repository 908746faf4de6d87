"""Operator 4, secret scans with corpus-wide ownership frequency.

One pass finds candidates in whole texts: three base kinds (assignments,
access keys, hex strings) and long mixed tokens.  A candidate is known by a
hash of its value.  Hashes are then counted over the corpus by distinct
documents (the repositories) and distinct sources (the owners), pre-aggregated
on the map side.  Values that several owners hold are widely copied examples;
values of one owner look live, in however many of its documents.  Base spans always stay;
mixed tokens become spans, of kind ``owned``, where they look live.

Defined cases: a null text is empty and has no spans; an owner that is null
counts as one owner; repeated rows of one document count as one repository;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pieces, table, texts

KINDS = ("assign", "access", "hex", "owned")

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: A mixed token: this long, with a digit, a lower and an upper case letter.
MIN_TOKEN = 20
TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")

#: At most this many owners hold a value that looks live.
LIVE_OWNERS = 1

_HEX_MAP = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_HEX_RUN = b"h" * MIN_HEX
_TOKEN_MAP = bytes(116 if c < 128 and (chr(c).isalnum() or chr(c) in "+/_=-") else 32 for c in range(256))
_TOKEN_RUN = b"t" * MIN_TOKEN


def find(text: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, bytes]]]:
    """Base spans (start, kind's rank, end), in bytes, and candidate values
    (span's start, kind's rank, end, value).  The cheap tests before each
    pattern are necessary conditions of a match, so none is lost."""
    base, values = [], []
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= MIN_ASSIGN:
                base.append((m.start(), 0, m.end()))
                values.append((m.start(), 0, m.end(), m[2]))
    if b"AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                base.append((m.start(), 1, m.end()))
                values.append((m.start(), 1, m.end(), m[0]))
    if _HEX_RUN in text.translate(_HEX_MAP):
        for m in HEX.finditer(text):
            if m.end() - m.start() >= MIN_HEX:
                base.append((m.start(), 2, m.end()))
                values.append((m.start(), 2, m.end(), m[0]))
    if _TOKEN_RUN in text.translate(_TOKEN_MAP):
        taken = [(a, b) for a, _, b in base]
        for m in TOKEN.finditer(text):
            t, a, b = m[0], m.start(), m.end()
            if any(c in b"0123456789" for c in t) and t != t.lower() and t != t.upper() and not any(x < b and a < y for x, y in taken):
                values.append((a, 3, b, t))
    return sorted(base), values


def code_points(text: bytes, at: list[int]) -> dict[int, int]:
    """Byte offsets to code points."""
    if text.isascii():
        return {x: x for x in at}
    out, last, count = {}, 0, 0
    for x in sorted(set(at)):
        count += len(text[last:x].decode())
        out[x], last = count, x
    return out


CAND = "array<struct<value:string,kind:int,start:int,end:int>>"


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, owner, n_assign, n_access, n_hex, base (spans as text), cands."""

    def make(piece: pa.RecordBatch) -> dict:
        n, base_text, cands = ([], [], []), [], []
        for text in texts(piece):
            base, values = find(text)
            at = code_points(text, [x for s in base for x in (s[0], s[2])] + [x for v in values for x in (v[0], v[2])])
            for k in range(3):
                n[k].append(sum(s[1] == k for s in base))
            base_text.append(",".join(f"{KINDS[k]}:{at[a]}:{at[b]}" for a, k, b in base))
            cands.append([{"value": hashlib.sha256(v).hexdigest()[:32], "kind": k, "start": at[a], "end": at[b]} for a, k, b, v in values])
        return {"doc_id": piece.column("doc_id"), "owner": piece.column("_owner"), "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base": base_text, "cands": cands}

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.col(owner).cast("string").alias("_owner"))
    return map_pieces(rows, make, f"doc_id {kind}, owner string, n_assign long, n_access long, n_hex long, base string, cands {CAND}")


def ownership(found: DataFrame) -> DataFrame:
    """value, n_docs, n_owners over all candidates.

    (value, owner) pairs are counted on the map side first, so a value that a
    third of all documents hold costs one row for each owner and task.
    """
    each = found.select("doc_id", "owner", F.explode(F.array_distinct(F.transform("cands", lambda c: c["value"]))).alias("value"))
    # Documents are counted once for each id: a row repeated within a task is combined there.
    once = each.groupBy("value", "owner", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, owner: str = "source", live_owners: int = LIVE_OWNERS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans, n_live, n_example.

    spans are the base spans and the owned ones, by start and kind; n_live and
    n_example count the document's candidates of either sort.
    """
    found = table(candidates(docs, owner).withColumn("row", F.monotonically_increasing_id()), "secrets")
    counts = ownership(found)
    each = found.where("size(cands) > 0").select("row", F.explode("cands").alias("c")).select("row", "c.*")
    live = F.col("n_owners") <= live_owners
    judged = each.join(counts, "value").withColumn("live", live)
    shown = F.when((F.col("kind") < 3) | F.col("live"), F.struct("start", "kind", "end"))
    by_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(shown)).alias("all_spans"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((F.col("n_owners") > live_owners).cast("long")).alias("n_example"),
    )
    name = "element_at(array('assign', 'access', 'hex', 'owned'), s.kind + 1)"
    out = found.drop("cands").join(by_row, "row", "left")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base",
        F.expr(f"coalesce(array_join(transform(all_spans, s -> concat({name}, ':', s.start, ':', s.end)), ','), '')").alias("spans"),
        F.expr("coalesce(n_live, 0L)").alias("n_live"), F.expr("coalesce(n_example, 0L)").alias("n_example"),
    )


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_example")


QUERIES = {"op4_secrets": op4_secrets}
ORACLES: dict[str, str] = {}
