"""Time buckets and the aggregated store in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bucket boundaries are whole intervals since 2000-01-01 UTC.
EPOCH_US = 946_684_800_000_000
KEY = ["dbid", "userid", "queryid", "toplevel", "tags_json"]
#: Executions of a chunk when the watermark is computed.
CHUNK = 100_000


def bucket_id(ts: Column, interval: int) -> Column:
    """floor((ts - epoch) / interval), exact for times before the epoch."""
    d, i = F.unix_micros(ts) - F.lit(EPOCH_US), F.lit(interval * 1_000_000)
    return ((d - F.pmod(d, i)) / i).cast("long")


def bucket_start(bucket: Column, interval: int) -> Column:
    # a small bucket and a short interval are both int literals
    return F.timestamp_micros(bucket.cast("long") * F.lit(interval * 1_000_000) + F.lit(EPOCH_US))


def clamped(df: DataFrame, interval: int) -> DataFrame:
    """*df* with bucket_id, raised to the greatest bucket seen before by seq.

    A running maximum over a whole log would be one task, so it has two
    levels: maxima of chunks of seq, whose running maximum is small, and the
    running maximum inside each chunk.
    """
    own = df.withColumn("_b", bucket_id(F.col("end_ts"), interval)).withColumn("_chunk", (F.col("seq") / CHUNK).cast("long"))
    chunks = own.groupBy("_chunk").agg(F.max("_b").alias("_m"))
    before = F.max("_m").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select(F.col("_chunk").alias("_c"), before.alias("_before"))
    inside = F.max("_b").over(Window.partitionBy("_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = own.join(chunks, own["_chunk"] == chunks["_c"])
    return joined.withColumn("bucket_id", F.greatest(inside, F.coalesce("_before", inside))).select(*df.columns, "bucket_id")


def in_order(df: DataFrame, interval: int) -> bool:
    """Whether end_ts never falls as seq rises, so that clamping is the identity."""
    late = clamped(df, interval).where(F.col("bucket_id") != bucket_id(F.col("end_ts"), interval))
    return late.isEmpty()


def aggregate(df: DataFrame) -> DataFrame:
    """Slots: calls and time by entry and bucket."""
    rows = df.withColumn("toplevel", F.col("nesting_level") == 0)
    return rows.groupBy(*KEY, "bucket_id").agg(F.count("*").alias("calls"), F.sum("elapsed_ms").alias("total_exec_time"), F.min("end_ts").alias("first_ts"))


def entries(slots: DataFrame) -> DataFrame:
    """Per entry: totals since it began, its last bucket."""
    return slots.groupBy(*KEY).agg(
        F.sum("calls").alias("calls_total"), F.sum("total_exec_time").alias("exec_time_total"), F.min("first_ts").alias("stats_since"), F.max("bucket_id").alias("last_bucket")
    )


def exemplars(df: DataFrame) -> DataFrame:
    """Per entry: the latest value of each exemplar key, as JSON."""
    rows = df.withColumn("toplevel", F.col("nesting_level") == 0)
    each = rows.select(*KEY, "seq", F.explode(F.from_json("exemplars_json", "map<string,string>")).alias("k", "v"))
    last = each.groupBy(*KEY, "k").agg(F.max_by("v", "seq").alias("v"))
    packed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))
    return last.groupBy(*KEY).agg(F.to_json(packed).alias("exemplars_json"))


def live(current: Column | int, count: int) -> Column:
    """Whether a slot's bucket is in the window that ends at *current*."""
    current = F.lit(current) if isinstance(current, int) else current
    return F.col("bucket_id").between(current - F.lit(count - 1), current)


def current_bucket(slots: DataFrame) -> int | None:
    """The watermark: the greatest bucket seen.  One number is read back and
    then stands as a literal in a query, so all its parts see the same."""
    return slots.agg(F.max("bucket_id")).first()[0]


def oldest_live(slots: DataFrame, current: int, count: int) -> DataFrame:
    """The oldest bucket of all that are live."""
    return slots.where(live(current, count)).agg(F.min("bucket_id").alias("oldest_bucket"))


def bounded(placed: DataFrame, settings) -> tuple[tuple[DataFrame, DataFrame], dict]:
    """((slots, entries), counters) of a store that *placed* executions fill
    beyond ``max_entries`` (E9, E10, E13).  Which entries go depends on all
    arrivals before, so the sequential model runs over the whole log in order;
    its state and its result are bounded by the settings, and rows are read
    partition by partition."""
    from ..functions.model import BoundedStore

    spark = placed.sparkSession
    model = BoundedStore(settings.max_entries, settings.bucket_count)
    rows = placed.withColumn("toplevel", F.col("nesting_level") == 0).select("seq", *KEY, "bucket_id", "elapsed_ms", F.unix_micros("end_ts").alias("at"))
    for r in rows.orderBy("seq").toLocalIterator(prefetchPartitions=True):
        model.record(tuple(r[k] for k in KEY), r.bucket_id, r.elapsed_ms, r.at)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*KEY).schema)
    slots = [(*k, b, c, ms, e.stats_since) for k, e in model.entries.items() for b, (c, ms) in e.slots.items()]
    found = [(*k, e.calls_total, e.exec_time_total, e.stats_since, e.last_bucket) for k, e in model.entries.items()]
    moment = F.timestamp_micros
    slots = spark.createDataFrame(slots, f"{kind}, bucket_id long, calls long, total_exec_time double, first_us long")
    found = spark.createDataFrame(found, f"{kind}, calls_total long, exec_time_total double, since_us long, last_bucket long")
    slots = slots.select(*KEY, "bucket_id", "calls", "total_exec_time", moment("first_us").alias("first_ts"))
    return (slots, found.select(*KEY, "calls_total", "exec_time_total", moment("since_us").alias("stats_since"), "last_bucket")), dict(model.counters)


def evict_candidates(found: DataFrame, current: int, count: int, max_entries: int) -> DataFrame:
    """The entries that one eviction pass would free (E9, E11): the dead, then
    the least by (last_bucket, usage, tags) up to the target.  The live part is
    a bounded top-k."""
    from ..plans.sizing import evict_live, evict_target

    dead = found.where(F.col("last_bucket") < current - count + 1)
    alive = found.where(F.col("last_bucket") >= current - count + 1)
    total = found.agg(F.count("*").alias("n"), F.sum((F.col("last_bucket") < current - count + 1).cast("long")).alias("d")).first()
    if total["n"] < max_entries:
        return dead.limit(0)
    k = evict_live(evict_target(max_entries), total["d"] or 0, total["n"] - (total["d"] or 0))
    return dead.unionByName(alive.orderBy("last_bucket", "calls_total", *KEY).limit(k))


def ring_violations(slots: DataFrame, found: DataFrame, current: int, count: int) -> DataFrame:
    """Rows that break the store's invariants, with the reason."""
    joined = slots.join(found.select(*KEY, "last_bucket"), KEY)
    slot = F.pmod("bucket_id", F.lit(count))
    reason = (
        F.when(F.col("bucket_id") > F.lit(current), "bucket after the watermark")
        .when(F.col("bucket_id") > F.col("last_bucket"), "bucket after the entry's last")
        .when((F.col("calls") <= 0) | (F.col("total_exec_time") < 0), "empty or negative slot")
    )
    bad = joined.withColumn("reason", reason).where("reason is not null").select(*KEY, "bucket_id", "reason")
    twice = slots.where(live(current, count)).groupBy(*KEY, slot.alias("slot")).agg(F.count("*").alias("n"), F.min("bucket_id").alias("bucket_id")).where("n > 1")
    return bad.unionByName(twice.select(*KEY, "bucket_id", F.lit("two live buckets in a slot").alias("reason")))
