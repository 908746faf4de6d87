"""Operator 6, language identification by prediction by partial matching.

Each language has a byte model: a tree of contexts of up to three bytes, with
escape probabilities by method C (an escape gets the number of distinct
symbols as its count) and a uniform model below the empty context.  The
statistics are frozen after training, and a text's score under a language is
its exact code length in bits: every byte of the whole text is coded under the
longest context in the tree.  The shortest code names the language.

The trees keep every context that training met.  All languages share one
numbering of contexts and of strings of up to four bytes; a string that no
training text has costs its context's escape and what the shorter context
says.  Scoring is a few gathers and a sum.

Training: the models are fitted on a bounded sample of labelled rows, by least
hash of the id: for each language about ``TRAIN_BYTES`` of text, or less where
many languages would make their cost table (languages by distinct strings by
four bytes) larger than ``MODEL_BYTES``; one row at least, and no more of a row
than the language's bound.  Index tables have at most ``DENSE`` entries each,
larger ones are searched.  So the broadcast is bounded however many rows the
corpus has.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a
table without labelled rows predicts ``und`` throughout; rows whose lang is
null are predicted, never learned from; ties go to the language that sorts
first; repeated rows are predicted alike.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pieces, small, small_batches, texts

#: Bound of the training text for each language, in expectation.
TRAIN_BYTES = 1_000_000
#: Bound of the cost table, whose strings are no more than the training bytes.
MODEL_BYTES = 256 << 20
#: Entries up to which an index is a table.
DENSE = 16 << 20
FOLDS = 5
#: Bytes that are coded at a time, of however long a text: some 60 times as
#: much memory is needed for them.
WINDOW = 128 << 10
#: Rows that a worker gets at a time to judge.
JUDGED_ROWS = 500

HELD_OUT = "crc32(coalesce(cast(doc_id as string), '')) % 5 = 0"


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == 0


class _Index:
    """Numbers of codes, -1 for others."""

    def __init__(self, codes: np.ndarray, space: int) -> None:
        self.codes = codes  # sorted, distinct
        self.table = None
        if space <= DENSE:
            self.table = np.full(space, -1, np.int32)
            self.table[codes] = np.arange(len(codes), dtype=np.int32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[codes]
        if not len(self.codes):
            return np.full(len(codes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1).astype(np.int32)


def _costs(context: np.ndarray, count: np.ndarray, lower: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By method C: the cost in bits of each string (of *context*, met *count*
    times; *lower*: what the shorter context says), and each context's escape."""
    whole = np.maximum(total + kinds, 1)
    escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / whole), 0.0)
    cost = np.where(count > 0, -np.log2(np.maximum(count, 1) / whole[context]), escape[context] + lower)
    return cost, escape


def _windows(many: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """The number of a text and at most WINDOW bytes of it after the three
    before them, which are spaces at its start."""
    for at, t in enumerate(many):
        yield at, b"   " + t[:WINDOW]
        for k in range(WINDOW, len(t), WINDOW):
            yield at, t[k - 3 : k + WINDOW]


class Model:
    """Cost tables of all languages."""

    def __init__(self, samples: dict[str, list[bytes]]) -> None:
        self.langs = sorted(samples)
        if not self.langs:
            return
        seen = np.zeros(256, np.int64)
        for v in samples.values():
            for t in (b" ", *v):
                seen += np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        used = np.flatnonzero(seen)
        self.symbols = a = len(used) + 1  # the last is any byte not met in training
        self.of_byte = np.full(256, a - 1, np.int32)
        self.of_byte[used] = np.arange(len(used))
        # strings of four, three, two symbols and one, with counts, a language at a time
        met = []
        for k in self.langs:
            # a text starts and ends with a space, so histories don't cross texts
            s = self.of_byte[np.frombuffer(b"   " + b"   ".join(samples[k]), np.uint8)].astype(np.int64)
            code, levels = s[3:], []
            for n in range(1, 4):
                levels.append(np.unique(code, return_counts=True))
                code = s[3 - n : -n] * a**n + code
            met.append([*levels, np.unique(code, return_counts=True)])
            del s, code
        union = lambda many: np.unique(np.concatenate(many))
        self.strings3, self.contexts3 = _Index(union([m[2][0] for m in met]), a**3), _Index(union([m[3][0] // a for m in met]), a**3)
        short4 = lambda codes: self.contexts3(codes // a).astype(np.int64) * a + codes % a
        self.strings4 = _Index(union([short4(m[3][0]) for m in met]), len(self.contexts3.codes) * a)
        u3, u4, c3 = self.strings3.codes, self.strings4.codes, self.contexts3.codes
        n = len(self.langs)
        self.cost1, self.escape2 = np.empty((n, a * a), np.float32), np.empty((n, a * a), np.float32)
        self.cost3, self.cost4 = np.empty((n, len(u3)), np.float32), np.empty((n, len(u4)), np.float32)
        self.escape3 = np.zeros((n, len(c3) + 1), np.float32)  # the last for contexts not met

        def spread(at: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
            out = np.zeros(size, np.int64)
            out[at] = count
            return out

        for i, (zero, one, two, three) in enumerate(met):
            # below the empty context all 256 bytes are alike
            zero, one = spread(*zero, a), spread(*one, a * a)
            low, _ = _costs(np.zeros(a, np.int64), zero, np.full(a, 8.0), zero.sum(keepdims=True), (zero > 0).sum(keepdims=True))
            square = one.reshape(a, a)
            self.cost1[i], _ = _costs(np.repeat(np.arange(a), a), one, np.tile(low, a), square.sum(1), (square > 0).sum(1))
            count, context = spread(self.strings3(two[0]), two[1], len(u3)), u3 // a
            kinds = np.bincount(context[count > 0], minlength=a * a)
            self.cost3[i], self.escape2[i] = _costs(context, count, self.cost1[i][u3 % (a * a)], np.bincount(context, weights=count, minlength=a * a), kinds)
            count, context = spread(self.strings4(short4(three[0])), three[1], len(u4)), u4 // a
            kinds = np.bincount(context[count > 0], minlength=len(c3))
            # a string of four has its last three in the union
            lower = self.cost3[i][self.strings3(c3[context] % (a * a) * a + u4 % a)]
            self.cost4[i], self.escape3[i, :-1] = _costs(context, count, lower, np.bincount(context, weights=count, minlength=len(c3)), kinds)
        rate = [self.bits(v)[:, i].sum() / max(1, sum(map(len, v))) for i, v in enumerate(samples[k] for k in self.langs)]
        self.usual = np.array(rate)  # bits a byte of each language's own sample

    def bits(self, many: list[bytes]) -> np.ndarray:
        """Code lengths, a row for each text and a column for each language."""
        out = np.zeros((len(many), len(self.langs)))
        a, part, held = self.symbols, [], 0
        for at, window in _windows(many):
            if part and held + len(window) > WINDOW + 3:
                self._add(out, part, a)
                part, held = [], 0
            part.append((at, window))
            held += len(window)
        if part:
            self._add(out, part, a)
        return out

    def _add(self, out: np.ndarray, part: list[tuple[int, bytes]], a: int) -> None:
        """Add the bits of windows to the rows of *out* that they belong to."""
        s = self.of_byte[np.frombuffer(b"".join(w for _, w in part), np.uint8)].astype(np.int64)
        if len(s) <= 3:
            return
        size, row = np.array([len(w) for _, w in part]), np.array([at for at, _ in part])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        two = s[1:-2] * a + s[2:-1]
        context = self.contexts3(s[:-3] * a * a + two)
        four = np.where(context >= 0, self.strings4(np.maximum(context, 0).astype(np.int64) * a + s[3:]), -1)
        rare = np.flatnonzero(four < 0)
        escaped, pair, symbol = context[rare], two[rare], s[3:][rare]
        three = self.strings3(pair * a + symbol)
        rarer = np.flatnonzero(three < 0)
        for i in range(len(self.langs)):
            cost = self.cost4[i][four]
            short = self.cost3[i][three]
            short[rarer] = self.escape2[i][pair[rarer]] + self.cost1[i][pair[rarer] % a * a + symbol[rarer]]
            cost[rare] = self.escape3[i][escaped] + short
            # total[j]: bits of the symbols before j, from the fourth on
            total = np.concatenate([np.zeros(4), np.cumsum(cost, dtype=np.float64)])
            np.add.at(out[:, i], row, total[begin + size] - total[begin + 3])

    def predict(self, many: list[bytes]) -> tuple[list[str], list[float]]:
        names, scores, _ = self.judge(many)
        return names, scores

    def judge(self, many: list[bytes]) -> tuple[list[str], list[float], list[float]]:
        """Names, scores, and bits a byte as a multiple of what the language's
        own sample takes."""
        names, scores, excess = ["und"] * len(many), [0.0] * len(many), [0.0] * len(many)
        at = [i for i, t in enumerate(many) if has_letter(t)]
        if not at or not self.langs:
            return names, scores, excess
        got = self.bits([many[i] for i in at])
        best = got.argmin(1)
        share = 1 / np.exp2(np.minimum(got.min(1, keepdims=True) - got, 0)).sum(1)
        for j, i in enumerate(at):
            names[i], scores[i] = self.langs[best[j]], float(share[j])
            excess[i] = float(got[j, best[j]] / len(many[i]) / self.usual[best[j]])
        return names, scores, excess


_ASCII_LETTERS = bytes(c for c in range(128) if chr(c).isalpha())


def has_letter(text: bytes) -> bool:
    if len(text.translate(None, _ASCII_LETTERS)) < len(text):
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode()))


def train(docs: DataFrame, train_bytes: int = TRAIN_BYTES, model_bytes: int = MODEL_BYTES) -> Model:
    """Fit on rows that aren't held out and have a lang."""
    labelled = docs.where(f"not ({HELD_OUT}) and lang is not null and text is not null").select("lang", "text", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(6)), F.lit(1 << 30)).alias("__h"))
    sizes = labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.min("__h").alias("least")).collect()
    if not sizes:
        return Model({})
    bound = max(1, min(train_bytes, model_bytes // (4 * len(sizes) ** 2)))
    share = [(r.lang, min(1.0, bound / max(r["n"], 1)) * (1 << 30), r.least) for r in sizes]
    limits = docs.sparkSession.createDataFrame([(k, max(float(x), float(least + 1))) for k, x, least in share], "__lang string, __most double")
    drawn = labelled.join(F.broadcast(limits), labelled["lang"].cast("string") == F.col("__lang")).where("__h < __most")
    samples: dict[str, list[bytes]] = {}
    for row in drawn.select("lang", F.substring(F.encode("text", "utf-8"), 1, bound).alias("t")).collect():
        samples.setdefault(row.lang, []).append(bytes(row.t))
    return Model({k: sorted(v) for k, v in samples.items()})


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns *keep*, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *(c for c in keep if c != "doc_id")]

    def make(piece: pa.RecordBatch) -> dict:
        lang, score = shared.value.predict(texts(piece))
        return {c: piece.column(c) for c in names} | {"lang_pred": lang, "score": score}

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_pieces(docs.select(*dict.fromkeys([*names, "text"])), make, f"{schema}, lang_pred string, score double")


#: A document is rejected below this share of probability, or where it has
#: MIN_BYTES and takes MAX_EXCESS times the bits that its language usually does.
MIN_SCORE, MIN_BYTES, MAX_EXCESS = 0.5, 200, 4.0


def keep_known(docs: DataFrame, model: Model | None = None, min_score: float = MIN_SCORE, max_excess: float = MAX_EXCESS) -> DataFrame:
    """*docs* without those that are ``und``, score below *min_score*, or whose
    code is so long that they are in no language the model knows.

    Workers get a few rows at a time and name those that go; the rows
    themselves stay with Spark, so no more than one table of ids is made."""
    model = model or train(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def make(piece: pa.RecordBatch) -> dict:
        many = texts(piece)
        got = zip(many, *shared.value.judge(many), strict=True)
        mask = pa.array([x == "und" or s < min_score or (e > max_excess and len(t) >= MIN_BYTES) for t, x, s, e in got], pa.bool_())
        return {c: piece.column(c).filter(mask) for c in ("__tm_d", "__tm_t")}

    rows = docs.select(F.col("doc_id").alias("__tm_d"), F.xxhash64("text").alias("__tm_t"), "text")
    with small_batches(spark, JUDGED_ROWS):
        gone = small(map_pieces(rows, make, f"__tm_d {docs.schema['doc_id'].dataType.simpleString()}, __tm_t long"), "unknown")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__tm_d")) & (F.xxhash64("text") == F.col("__tm_t")), "left_anti")


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language": op6_language}
ORACLES: dict[str, str] = {}
