"""Operator 1, quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements
and one failure bit per rule.  A policy is a versioned set of bits, applied to
the ledger by one bitwise AND, and ablations are counted from grouped bits, so
neither reads a text again.

Toxic vocabulary can also be learned from labels: ``learn`` weighs words and
their beginnings by how much more often toxic documents hold them, and
``ledger`` then adds a document's score and one more bit, which policy v3
uses.  Weights are whole thousandths, so that sums don't depend on their order.
The registered query learns from ``labels`` and applies v3; its SQL learns the
same terms on its own.

Defined cases: a null or empty text measures 0 throughout and fails the
word-count rule; repeated rows are judged alike; no value is clipped; without a toxic and
a clean labelled document nothing is learned and the score's bit stays 0.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_pieces, scratch, table, texts

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

#: Insults, by which the toxicity rule counts words.
TOXIC = (
    "idiot", "idiots", "moron", "morons", "loser", "losers", "clown", "clowns", "worthless", "pathetic",
    "disgusting", "stupid", "imbecile", "scum", "trash", "dumb", "idiota", "imbécil", "estúpido", "basura",
    "asqueroso", "inútil", "patético", "payaso", "crétin", "imbécile", "débile", "minable", "pathétique",
    "ordure", "dégoûtant", "abruti", "trottel", "dummkopf", "wertlos", "erbärmlich", "ekelhaft", "abschaum",
    "versager", "dreckskerl", "vollidiot",
)

#: (name, SQL of the failure); the position is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_words", "n_words > 1000000"),
    ("word_length", "2 * n_words > word_chars or word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("toxic_words", "n_toxic >= 1 and 1000 * n_toxic >= n_words"),
    ("shouting", "100 * n_shouted > 30 * n_words"),
)
#: The rule that ``ledger`` adds for a learned vocabulary, at the next bit.
LEARNED = "toxic_score"
BASE = ("few_words", "repeated_words")
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE + ("many_words", "word_length", "symbols", "repeated_lines"),
    "v2": tuple(name for name, _ in RULES),
    "v3": (*(name for name, _ in RULES), LEARNED),
}
LATEST = "v3"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_toxic", "n_shouted")

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in bytes(range(256)).lower())


_NAMES = (*(name for name, _ in RULES), LEARNED)


def bits(names: tuple[str, ...]) -> int:
    at = {name: i for i, name in enumerate(_NAMES)}
    return sum(1 << at[n] for n in names)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    code = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    many = len(known)
    if many < 2_000_000:
        key = (code[:-2] * many + code[1:-1]) * many + code[2:]
    else:
        pair = np.unique(code[:-2] * many + code[1:-1], return_inverse=True)[1]
        key = pair * many + code[2:]
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    if len(count) == len(key):
        return 0
    again = count[which] > 1
    cover = np.zeros(n, bool)
    for j in range(3):
        cover[j : n - 2 + j] |= again
    return int(cover.sum())


def measure(text: bytes, toxic: frozenset[bytes]) -> tuple[int, ...]:
    words = text.split()
    bare = text.translate(None, SPACES)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    # a code point has one byte that isn't 10xxxxxx
    chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "surrogatepass"))
    return (
        len(words),
        chars,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(map(toxic.__contains__, text.translate(_LETTERS).split())),
        sum(map(bytes.isupper, words)),
    )


#: Labelled documents that ``learn`` reads at most, by least MD5 of the id.
LEARN_DOCS = 20_000
#: Toxic documents that must hold a term, how many times more often than clean
#: ones, and the terms kept at most.
TERM_DOCS, TERM_LIFT, MAX_TERMS = 3, 20.0, 20_000
#: Letters of the beginnings that are terms beside whole words.
PREFIXES = (4, 5, 6, 7)


def terms(text: bytes) -> set[str]:
    """The words of a text and their beginnings, which end in ``*``."""
    words = {w.decode() for w in text.translate(_LETTERS).split()}
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


class Vocabulary:
    """Weights of toxic terms and the score from which a text is toxic."""

    def __init__(self, weights: dict[str, int], least: float = math.inf) -> None:
        self.weights, self.least = weights, least

    def score(self, text: bytes) -> int:
        return sum(self.weights[t] for t in terms(text) if t in self.weights) if self.weights else 0


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = LEARN_DOCS) -> Vocabulary:
    """Fit on documents that *labels* (doc_id, toxic) covers.

    A term's weight is a thousand times the logarithm of its lift; the least
    score is the one with the best F1 on the sample.  Of rows that repeat an id
    the least text counts, and a toxic label before a clean one.
    """
    told = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = told.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_docs)
    with scratch():
        # the join comes first, so that only labelled texts are shuffled
        found = docs.select("doc_id", "text").join(F.broadcast(told), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        sample = table(found.select("text", F.col("toxic").cast("long").alias("toxic")), "labelled")
        many = {r.toxic: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not many.get(1) or not many.get(0):
            return Vocabulary({})

        def listed(piece: pa.RecordBatch) -> dict:
            each = [sorted(terms(t)) for t in texts(piece)]
            toxic = np.repeat(piece.column("toxic").to_numpy(), [len(x) for x in each])
            return {"term": [t for x in each for t in x], "toxic": pa.array(toxic)}

        held = map_pieces(sample, listed, "term string, toxic long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        lift = F.col("a") / many[1] / ((F.col("b") + 0.5) / many[0])
        kept = held.where((F.col("a") >= TERM_DOCS) & (lift >= TERM_LIFT)).orderBy(F.desc("a"), "term").limit(MAX_TERMS).select("term", lift.alias("lift"))
        found = Vocabulary({r.term: round(1000 * math.log(r.lift)) for r in kept.collect()})

        def scored(piece: pa.RecordBatch) -> dict:
            return {"score": [found.score(t) for t in texts(piece)], "toxic": piece.column("toxic")}

        got = map_pieces(sample, scored, "score long, toxic long").where("score > 0").groupBy("score").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
        best = hit = seen = 0
        for r in sorted(got.collect(), key=lambda r: -r.score):
            hit, seen = hit + r.a, seen + r["n"]
            if 2 * hit / (seen + many[1]) > best:
                best, found.least = 2 * hit / (seen + many[1]), r.score
    return found


def ledger(docs: DataFrame, toxic: tuple[str, ...] = TOXIC, learned: Vocabulary | None = None) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``; with *learned* also its
    score and bit."""
    lexicon = frozenset(w.encode() for w in toxic)

    def make(piece: pa.RecordBatch) -> dict:
        got = np.array([measure(t, lexicon) for t in texts(piece)], np.int64).reshape(-1, len(MEASURES))
        score = {} if learned is None else {LEARNED: [learned.score(t) for t in texts(piece)]}
        return {"doc_id": piece.column("doc_id")} | {m: pa.array(got[:, i]) for i, m in enumerate(MEASURES)} | score

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES) + (f", {LEARNED} long" if learned else "")
    measured = map_pieces(docs.select("doc_id", "text"), make, schema)
    failed = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    if learned:
        failed.append(F.when(F.col(LEARNED) >= learned.least, F.lit(bits((LEARNED,)))).otherwise(F.lit(0)))
    total = failed[0]
    for x in failed[1:]:
        total = total.bitwiseOR(x)
    return measured.withColumn("fail_bits", total.cast("long"))


def failed(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(bits(POLICIES[policy]))) != 0


def apply_policy(rows: DataFrame, policy: str = LATEST) -> DataFrame:
    """The ledger with base_failed and kept."""
    base = F.col("fail_bits").bitwiseAND(F.lit(bits(BASE))) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & ~failed(policy))


def ablation(rows: DataFrame, policy: str = LATEST) -> DataFrame:
    """For each rule of *policy*: rule, n_failed (documents that fail it) and
    n_only (documents that it alone removes).  The ledger is first counted by
    bits, of which there are at most 2 to the number of rules."""
    mask = bits(POLICIES[policy])
    grouped = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("b")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in enumerate(_NAMES) if name in POLICIES[policy]]
    each = grouped.select("b", "n", F.explode(F.array(*rules)).alias("r"))
    hit = F.col("b").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = apply_policy(ledger(docs, learned=learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def _sql() -> str:
    lexicon = ", ".join(f"'{w}'" for w in TOXIC)
    rules = (*RULES, (LEARNED, f"{LEARNED} >= least"))
    failing = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(rules))
    words = r"regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+')"
    begun = ", ".join(map(str, PREFIXES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cover AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
each AS (SELECT rid, unnest(list_distinct({words})) AS word FROM d),
term AS (SELECT rid, word AS term FROM each
         UNION SELECT rid, left(word, k) || '*' FROM each, (SELECT unnest([{begun}]) AS k) WHERE length(word) > k),
told AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id
         ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {LEARN_DOCS}),
sample AS (SELECT arg_min(rid, t) AS rid, toxic FROM d JOIN told USING (doc_id) GROUP BY doc_id, toxic),
many AS (SELECT count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n0 FROM sample),
held AS (SELECT term, sum(toxic) AS a, sum(1 - toxic) AS b FROM sample JOIN term USING (rid) GROUP BY term),
weight AS (SELECT term, CAST(round(1000 * ln(lift)) AS BIGINT) AS w
           FROM (SELECT term, a, CAST(a AS DOUBLE) / n1 / ((CAST(b AS DOUBLE) + CAST(0.5 AS DOUBLE)) / n0) AS lift FROM held, many WHERE n1 > 0 AND n0 > 0)
           WHERE a >= {TERM_DOCS} AND lift >= {TERM_LIFT} ORDER BY a DESC, term LIMIT {MAX_TERMS}),
scored AS (SELECT rid, sum(w) AS {LEARNED} FROM term JOIN weight USING (term) GROUP BY rid),
level AS (SELECT {LEARNED} AS score, sum(toxic) AS a, count(*) AS n FROM sample JOIN scored USING (rid) WHERE {LEARNED} > 0 GROUP BY 1),
best AS (SELECT score, 2 * sum(a) OVER up / (sum(n) OVER up + n1) AS f1 FROM level, many WINDOW up AS (ORDER BY score DESC)),
chosen AS (SELECT max(score) AS least FROM (SELECT score FROM best WHERE f1 > 0 ORDER BY f1 DESC, score DESC LIMIT 1)),
li AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter({words}, lambda x: x IN ({lexicon}))) AS n_toxic,
         coalesce({LEARNED}, 0) AS {LEARNED}, least,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_shouted
  FROM d LEFT JOIN cover USING (rid) LEFT JOIN li USING (rid) LEFT JOIN scored USING (rid), chosen),
f AS (SELECT *, CAST({failing} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {bits(BASE)}) <> 0 AS base_failed,
       (fail_bits & {bits(BASE) | bits(POLICIES[LATEST])}) = 0 AS kept, fail_bits
FROM f"""


QUERIES = {"op1_quality": op1_quality}
ORACLES = {"op1_quality": _sql()}
