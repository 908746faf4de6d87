"""Operator 2, mixing sources to target weights: a time-varying curriculum.

Sources, by code point with null last, get target token counts by weight, no
source above ``MAX_REPEAT`` times its size; the excess is reshared by weight.
Each source's weight schedule over training time is integrated; a document's
place in its source's stream is a cumulative token count; inverting the
cumulative demand turns that place into a training time, and the demand of all
sources up to that time is its position in the training stream, in words;
documents are range-sorted by position.

A source may hold most rows, so cumulative counts have two levels: sums of
hash buckets that are many more than sources, a running sum over buckets, and
a running sum inside a bucket.  No task sees a whole source's documents.  Only
one row for each source meets in one task, to rank them and find the targets.

Within a source the order is by md5 of the seed, the id and the text's md5, so
reruns agree and rows that share an id don't meet in one bucket.
A source's stream is its documents in that order, then again, up to its
target; the document on the boundary gives only its first words, so the taken
words equal the rounded target.

Defined cases: a null or wordless text has size 0 and takes nothing; a null
source is a source of its own; rows that share an id follow in order of size
and text; equal rows may be taken unequally at the boundary, but their sum is
fixed; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

WEIGHTS = (3, 1, 2)
SHARE, MAX_REPEAT = 1.5, 2
SEED = "mix-1"
#: Rows in a hash bucket, about, and the least number of buckets of a source.
BUCKET_ROWS, MIN_BUCKETS = 4096, 256

#: Relative weight at points of training time, one schedule for each weight in
#: turn; between points it is linear.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))

#: Columns of a plan; a kept column of one of these names gives way.
OUTPUT = ("doc_id", "size", "source_size", "target", "taken", "time", "position", "passes")

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = MAX_REPEAT) -> DataFrame:
    """*sizes* (source, skey, source_size) with rank, weight and target.

    One row for each source, in one task.  By ascending ratio of cap to
    weight, the level is what is left, shared by the weights left, at the first
    source whose ratio it doesn't exceed; from there on it only falls.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * repeat)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    ranked = ranked.withColumn("before", F.sum("cap").over(order) - F.col("cap"))
    ranked = ranked.withColumn("left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    ranked = ranked.withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    ranked = ranked.withColumn("level", F.max(fits).over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return ranked.select("skey", "source_size", "rank", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def _d(x: float) -> str:
    return f"cast({x!r} as double)"


def _pieces(knots) -> tuple[list[tuple[float, float, float, float, float]], float]:
    """(start, weight there, length, weight at the end, integral before) of
    each piece of a schedule, and its whole integral."""
    out, total = [], 0.0
    for (t, f), (u, g) in zip(knots, knots[1:], strict=False):
        out.append((t, f, u - t, g, total))
        total += (f + g) / 2 * (u - t)
    return out, total


def demand(t: str, knots) -> str:
    """SQL of the share of a source's demand up to time *t*: the schedule's
    integral."""
    pieces, total = _pieces(knots)
    parts = []
    for start, f, length, g, _ in pieces:
        x = f"least({_d(length)}, greatest({_d(0.0)}, {t} - {_d(start)}))"
        parts.append(f"({_d(f)} * {x} + {_d((g - f) / length / 2)} * {x} * {x})")
    return f"(({' + '.join(parts)}) / {_d(total)})"


def inverse(share: str, knots) -> str:
    """SQL of the time at which the schedule's integral reaches *share*."""
    pieces, total = _pieces(knots)
    out = None
    for start, f, length, g, before in reversed(pieces):
        v = f"({share} * {_d(total)} - {_d(before)})"
        x = f"coalesce({_d(2.0)} * {v} / nullif({_d(f)} + sqrt(greatest({_d(0.0)}, {_d(f * f)} + {_d(2 * (g - f) / length)} * {v})), {_d(0.0)}), {_d(0.0)})"
        at = f"({_d(start)} + {x})"
        out = at if out is None else f"(case when {share} * {_d(total)} < {_d(before + (f + g) / 2 * length)} then {at} else {out} end)"
    return f"least({_d(1.0)}, greatest({_d(0.0)}, {out}))"


def time_sql(share: str, kind: str, schedules) -> str:
    return "(case " + " ".join(f"when {kind} = {k} then {inverse(share, x)}" for k, x in enumerate(schedules)) + " end)"


def position_sql(t: str, words: list[str], schedules) -> str:
    """SQL of the words that all sources have given by time *t*; *words*: what
    the sources of each schedule give in all."""
    return "(" + " + ".join(f"{w} * {demand(t, x)}" for w, x in zip(words, schedules, strict=True)) + ")"


def plan(docs: DataFrame, keep: tuple[str, ...] = (), weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """A row for each document: the columns *keep*, doc_id, size, source_size,
    target, taken, time and position (of the first pass, null if nothing is
    taken) and passes (array of pass, time, position, words)."""
    keep = tuple(c for c in keep if c not in OUTPUT)
    source = F.col("source").cast("string")
    skey = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit(""))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select("doc_id", *keep, source.alias("__tm_source"), skey.alias("__tm_skey"), size.alias("__tm_size"), order.alias("__tm_order"), F.xxhash64("text").alias("__tm_text"))
    narrow = base.select("doc_id", "__tm_source", "__tm_skey", "__tm_size", "__tm_order", "__tm_text")
    narrow = table(narrow, "mix") if not keep else narrow
    counted = narrow.groupBy("__tm_skey", "__tm_source").agg(F.sum("__tm_size").alias("source_size"), F.count("*").alias("n"))
    counted = table(counted.select("__tm_skey", F.col("__tm_source").alias("source"), "source_size", "n"), "mix-sources")
    rows = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(MIN_BUCKETS, 1 << math.ceil(math.log2(max(1, rows / BUCKET_ROWS))))
    # the bucket is a prefix of the order's hash, so buckets are in its order
    bucket = F.floor(F.conv(F.substring("__tm_order", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int")
    wanted = targets(counted.withColumnRenamed("__tm_skey", "skey"), weights, share, repeat)
    wanted = wanted.withColumn("kind", (F.col("rank") % len(schedules)).cast("int")).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    given = wanted.agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("words"))), F.lit(0)).alias(f"k{k}") for k in range(len(schedules)))).first()
    given = [_d(float(x)) for x in given]
    sums = narrow.groupBy("__tm_skey", bucket.alias("__tm_bucket")).agg(F.sum("__tm_size").alias("b"))
    upto = Window.partitionBy("__tm_skey").orderBy("__tm_bucket")
    sums = sums.withColumn("__tm_before", F.sum("b").over(upto) - F.col("b"))
    sums = sums.join(wanted, sums["__tm_skey"] == wanted["skey"]).select(F.col("__tm_skey").alias("__tm_k"), F.col("__tm_bucket").alias("__tm_b"), "__tm_before", "source_size", F.col("kind").alias("__tm_kind"), F.col("words").alias("__tm_words"), "target")

    left = (base if keep else narrow).withColumn("__tm_bucket", bucket)
    joined = left.join(sums, (left["__tm_skey"] == sums["__tm_k"]) & (left["__tm_bucket"] == sums["__tm_b"]))
    inside = Window.partitionBy("__tm_skey", "__tm_bucket").orderBy("__tm_order", "doc_id", "__tm_size", "__tm_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = joined.withColumn("__tm_at", F.col("__tm_before") + F.sum("__tm_size").over(inside) - F.col("__tm_size"))
    each = []
    for p in range(math.ceil(repeat)):
        at = at.withColumn("__tm_begin", F.col("__tm_at") + F.col("source_size") * p)
        at = at.withColumn(f"__tm_w{p}", F.greatest(F.lit(0), F.least(F.col("__tm_size"), F.col("__tm_words") - F.col("__tm_begin"))).cast("long"))
        at = at.withColumn("__tm_share", F.expr(f"(cast(__tm_begin as double) + cast(__tm_w{p} as double) / {_d(2.0)}) / nullif(cast(__tm_words as double), {_d(0.0)})"))
        at = at.withColumn(f"__tm_t{p}", F.expr(time_sql("__tm_share", "__tm_kind", schedules)))
        each.append(F.struct(F.lit(p + 1).alias("pass"), F.col(f"__tm_t{p}").alias("time"), F.expr(position_sql(f"__tm_t{p}", given, schedules)).alias("position"), F.col(f"__tm_w{p}").alias("words")))
    passes = F.filter(F.array(*each), lambda x: x["words"] > 0)
    return at.select(
        "doc_id", *keep, F.col("__tm_size").alias("size"), "source_size", "target",
        F.aggregate(passes, F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        F.try_element_at(passes, F.lit(1))["time"].alias("time"), F.try_element_at(passes, F.lit(1))["position"].alias("position"), passes.alias("passes"),
    )


def sequence(planned: DataFrame) -> DataFrame:
    """A row for each document and pass, range-sorted by training position."""
    each = planned.select("*", F.explode("passes").alias("_p")).drop("passes", "time", "position", "taken")
    return each.select("*", F.col("_p.pass").alias("pass"), F.col("_p.time").alias("time"), F.col("_p.position").alias("position"), F.col("_p.words").alias("words")).drop("_p").orderBy("position", "doc_id", "pass")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, n_passes, and where the first pass begins to be
    trained on: position (the middle of its words in the stream, in words, to
    a thousandth), by which the rows are sorted."""
    planned = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    planned = planned.withColumn("position", F.round("position", 3)).withColumn("n_passes", F.size("passes").cast("long"))
    return planned.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "n_passes", "position")


def _sql() -> str:
    words = [f"(SELECT CAST(coalesce(sum(words), 0) AS DOUBLE) FROM t WHERE kind = {k})" for k in range(len(SCHEDULES))]
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][rk % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, CAST({MAX_REPEAT} * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, sum(cap) OVER q - cap AS before, sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wleft,
        sum(source_size) OVER () * {SHARE} AS total FROM w WINDOW q AS (ORDER BY cap / weight, rk)),
v AS (SELECT *, max(CASE WHEN (total - before) / wleft <= cap / weight THEN (total - before) / wleft END) OVER () AS level FROM l),
t AS (SELECT source, source_size, rk % {len(SCHEDULES)} AS kind, least(cap, level * weight) AS target, CAST(floor(least(cap, level * weight) + 0.5) AS BIGINT) AS words FROM v),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.words, t.kind,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(0, least(size, words - a)) AS first, greatest(0, least(size, words - a - source_size)) AS second FROM c),
u AS (SELECT *, (CAST(a AS DOUBLE) + CAST(first AS DOUBLE) / CAST(2.0 AS DOUBLE)) / nullif(CAST(words AS DOUBLE), CAST(0.0 AS DOUBLE)) AS share FROM p),
x AS (SELECT *, {time_sql('share', 'kind', SCHEDULES)} AS tm FROM u)
SELECT doc_id, size, source_size, target, first + second AS taken, CAST((first > 0)::INT + (second > 0)::INT AS BIGINT) AS n_passes,
       CASE WHEN first > 0 THEN round({position_sql('tm', words, SCHEDULES)}, 3) END AS position
FROM x"""


QUERIES = {"op2_mixing": op2_mixing}
ORACLES = {"op2_mixing": _sql()}
