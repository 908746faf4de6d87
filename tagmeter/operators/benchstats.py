"""Statistics of paired benchmark runs."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latency_log(spark: SparkSession, path: str) -> DataFrame:
    """A per-transaction log of blank-separated fields: the third is the
    latency, the fifth and sixth the end in seconds and microseconds."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(f) >= 6).select((f[4].cast("long") * 1_000_000 + f[5].cast("long")).alias("end_us"), f[2].cast("long").alias("latency_us"))


def nearest_rank(column: str | Column, p: float) -> Column:
    """L1: the value at rank ceil(p n)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.percentile_disc(c, p) if hasattr(F, "percentile_disc") else F.element_at(F.array_sort(F.collect_list(c)), F.ceil(F.count(c) * p).cast("int"))


def latency_summary(df: DataFrame, *by: str) -> DataFrame:
    """L1: count, p50, p95, p99, average and maximum in milliseconds."""
    keys = "".join(f"{b}, " for b in by)
    disc = ", ".join(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_us) / 1000 AS p{int(p * 100)}_ms" for p in (0.5, 0.95, 0.99))
    tail = f" GROUP BY {', '.join(by)}" if by else ""
    return df.sparkSession.sql(f"SELECT {keys}count(*) AS n, {disc}, avg(latency_us) / 1000 AS avg_ms, max(latency_us) / 1000 AS max_ms FROM {{rows}}{tail}", rows=df)


def spread(df: DataFrame, value: str, *by: str) -> DataFrame:
    """L2: median (mean of the middle two) and the spread in per cent of it."""
    m = F.median(value)
    return df.groupBy(*by).agg(m.alias("median"), ((F.max(value) - F.min(value)) / m * 100).alias("spread_pct"))


def near_boundary(df: DataFrame, interval_us: int, margin_us: int, offset_us: int | None = None) -> DataFrame:
    """L3: marks log rows that run, widened by *margin* on both sides, over a
    bucket boundary."""
    from .store import EPOCH_US

    offset = F.lit(EPOCH_US if offset_us is None else offset_us)
    low, high = F.col("end_us") - F.col("latency_us") - margin_us - offset, F.col("end_us") + margin_us - offset
    return df.withColumn("near", high - F.pmod(high, F.lit(interval_us)) >= low)


def boundary_split(df: DataFrame, interval_us: int, margin_us: int, offset_us: int | None = None) -> DataFrame:
    """L3: rows near a boundary and others, and how many boundaries lie after
    the first start and up to the last end."""
    from .store import EPOCH_US

    offset = F.lit(EPOCH_US if offset_us is None else offset_us)
    marked = near_boundary(df, interval_us, margin_us, offset_us)
    first, last = F.min(F.col("end_us") - F.col("latency_us")) - offset, F.max("end_us") - offset
    interval = F.lit(interval_us)
    crossed = ((last - F.pmod(last, interval) - first + F.pmod(first, interval)) / interval).cast("long")
    return marked.groupBy("near").agg(F.count("*").alias("n"), F.avg("latency_us").alias("avg_us"), F.max("latency_us").alias("max_us")).crossJoin(marked.agg(crossed.alias("boundaries")))


def t_quantile(level: float, df: int) -> float:
    """Two-sided Student t quantile, by bisection on its integral."""

    def tail(t: float) -> float:
        # regularised incomplete beta of x at (df / 2, 1 / 2), by continued fraction
        x, a, b = df / (df + t * t), df / 2, 0.5
        if x >= 1:
            return 1.0
        flip = x > (a + 1) / (a + b + 2)
        if flip:
            x, a, b = 1 - x, b, a
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        f = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d)
                c = 1 + num / c
                f *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        got = front * f
        return 1 - got if flip else got

    low, high = 0.0, 1e7
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > 1 - level else (low, mid)
    return (low + high) / 2


def paired(runs: DataFrame, value: str) -> DataFrame:
    """Each run beside its baseline's of the same scenario and block.
    Two runs of one block and configuration are an error."""
    twice = runs.groupBy("scenario", "block", "config").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("a block has two runs of one configuration")
    base = runs.select("scenario", "block", F.col("config").alias("baseline"), F.col(value).alias("base"))
    own = runs.where("baseline is not null").select("scenario", "block", "config", "baseline", F.col(value).alias("own"))
    return own.join(base, ["scenario", "block", "baseline"])


def intervals(pairs: DataFrame, level: float = 0.95, log: bool = False) -> DataFrame:
    """Mean difference, or geometric mean ratio, with its t interval.
    The number of blocks is small, so quantiles are a literal table."""
    x = F.ln(F.col("own") / F.col("base")) if log else F.col("own") - F.col("base")
    got = pairs.withColumn("x", x).groupBy("scenario", "config").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("x").alias("n"))
    most = got.agg(F.coalesce(F.max("n"), F.lit(2))).first()[0]
    table = F.create_map(*(F.lit(v) for n in range(2, max(3, most + 1)) for v in (n, t_quantile(level, n - 1))))
    half = table[F.col("n").cast("int")] * F.col("sd") / F.sqrt("n")
    out = got.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)
    return out.select("scenario", "config", "n", *((F.exp(c) if log else F.col(c)).alias(c) for c in ("mean", "low", "high")))


def verdict(nothing: float = 0.0) -> Column:
    """What an interval says."""
    return F.when(F.col("low") > nothing, "slower").when(F.col("high") < nothing, "faster").otherwise("unresolved")


def simultaneous_level(m: int) -> float:
    """The level at which *m* intervals hold together at 95 %."""
    return 1 - 0.05 / max(1, m)


def headline(rows: DataFrame, core: str = "^ro|^rw") -> DataFrame:
    """The range of resolved core means, and how many there are."""
    kept = rows.where(F.col("scenario").rlike(core))
    sure = (F.col("low") > 0) | (F.col("high") < 0)
    return kept.agg(F.min(F.when(sure, F.col("mean"))).alias("least"), F.max(F.when(sure, F.col("mean"))).alias("most"), F.sum(sure.cast("long")).alias("resolved"), F.count("*").alias("n"))


def absolute(runs: DataFrame, *values: str) -> DataFrame:
    """Medians by scenario and configuration."""
    return runs.groupBy("scenario", "config").agg(*(F.median(v).alias(v) for v in values))


def block_plan(configs: list[str], blocks: int, seed: int = 1) -> list[tuple[int, str]]:
    """Each block runs every configuration once, in an order of its own."""
    out = []
    for b in range(blocks):
        order = list(configs)
        random.Random(f"{seed}/{b}").shuffle(order)
        out += [(b, c) for c in order]
    return out


def write_summaries(df: DataFrame, path: str) -> None:
    """Run summaries as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
