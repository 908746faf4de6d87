"""The SQL surface: per-bucket, total, last-bucket, activity and health views
(G1-G10, P5-P8, D12)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import sizing
from . import caps, extract, nesting, store
from .store import KEY

COLUMNS = ["bucket_start", "userid", "dbid", "queryid", "toplevel", "tags_json", "calls", "total_exec_time", "calls_total", "exec_time_total", "stats_since", "exemplars_json"]


def visible(caller: int | None, see_all: bool) -> Column:
    """P5: whether a row shows its query and tags."""
    return F.lit(True) if see_all or caller is None else F.col("userid") == caller


#: Columns of a log that only extraction reads.
TEXT = ("query_string", "stmt_location", "stmt_len", "scs", "application_name", "tags_override")


def once(df: DataFrame, folder: str | None = None) -> DataFrame:
    """*df*, computed once: texts are lexed in one pass however often views
    read the tags.  On a cluster it is a narrow table in the shared folder,
    else it is cached."""
    spark = df.sparkSession
    told = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        return df.persist()
    path = f"{told.rstrip('/')}/tagged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def free(df: DataFrame | None) -> None:
    """Undo ``once``."""
    if df is None:
        return
    df.unpersist()
    if path := getattr(df, "stored_at", None):
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@dataclass
class Store:
    """A batch store: slots and entries of one set of executions."""

    settings: object
    executions: DataFrame  # with tags
    slots: DataFrame
    found: DataFrame
    latest: DataFrame
    current: int | None
    evictions: dict | None = None  # counters of a store that had to evict
    kept: DataFrame | None = None  # recorded executions after caps
    reset_at: object = None  # when the store was last emptied
    own: DataFrame | None = None  # what ``once`` keeps

    @classmethod
    def build(cls, executions: DataFrame, settings, fast: bool = True, clamp: bool = True) -> Store:
        """Tags, caps, nesting, filters, buckets and aggregation of a log."""
        from ..sources.executions import recorded

        text = TEXT if caps.capping(settings) else (*TEXT, "candidates_json")
        own = once(extract.with_tags(executions, settings, fast).drop(*text))
        tagged = nesting.with_nesting(own, settings.nested_tags)
        kept = caps.applied(tagged.where(recorded(settings)), settings)
        placed = store.clamped(kept, settings.bucket_interval) if clamp else kept.withColumn("bucket_id", store.bucket_id(F.col("end_ts"), settings.bucket_interval))
        # the slots are small beside the log, and every view starts from them
        slots = store.aggregate(placed).persist()
        found = store.entries(slots)
        latest = store.exemplars(placed) if settings.parsed["exemplars"] else None
        current = store.current_bucket(slots)
        if found.count() <= settings.max_entries:
            return cls(settings, tagged, slots, found, latest, current, kept=kept, own=own)
        slots.unpersist()
        (slots, found), evictions = store.bounded(placed, settings)
        latest = latest.join(found.select(*KEY), KEY, "left_semi") if latest is not None else None
        return cls(settings, tagged, slots, found, latest, current, evictions, kept, own=own)

    def stats(self, showtags: bool = True, merge_buckets: bool = False, last_only: bool = False, caller: int | None = None, see_all: bool = True) -> DataFrame:
        """Rows of live buckets, or one for each entry, or of the last
        closed bucket alone."""
        s = self.settings
        current = self.current if self.current is not None else 0
        keep = store.live(current, s.bucket_count)
        if last_only:
            keep = keep & (F.col("bucket_id") == current - 1)
        rows = self.slots.where(keep)
        if merge_buckets:
            rows = rows.groupBy(*KEY).agg(F.min("bucket_id").alias("bucket_id"), F.sum("calls").alias("calls"), F.sum("total_exec_time").alias("total_exec_time"))
        rows = rows.join(self.found.drop("last_bucket"), KEY)
        rows = rows.join(self.latest, KEY, "left") if self.latest is not None else rows.withColumn("exemplars_json", F.lit(None).cast("string"))
        rows = rows.withColumn("bucket_start", store.bucket_start(F.col("bucket_id"), s.bucket_interval))
        shown = visible(caller, see_all)
        tags = shown if showtags else F.lit(False)
        if not merge_buckets and not last_only:  # an entry's buckets, oldest first
            rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "bucket_id")
        out = rows.withColumn("queryid", F.when(shown, F.col("queryid")))
        out = out.withColumn("tags_json", F.when(tags, F.col("tags_json"))).withColumn("exemplars_json", F.when(tags, F.col("exemplars_json")))
        return out.select(*COLUMNS)

    def totals(self, **more) -> DataFrame:
        return self.stats(merge_buckets=True, **more)

    def last_bucket(self, **more) -> DataFrame:
        return self.stats(last_only=True, **more)

    def activity(self, caller: int | None = None, see_all: bool = True) -> DataFrame:
        """The latest top-level statement of each session.  A log of
        completions has idle sessions only; one that is still running has no
        status yet."""
        top = self.executions.where("nesting_level = 0")
        # a maximum of rows with text would sort the log: one of numbers tells
        # which rows can be the latest, and only those are compared
        latest = top.groupBy("pid").agg(F.max("seq").alias("_last")).select("_last")
        top = top.join(latest, top["seq"] == F.col("_last"), "left_semi")
        last = top.groupBy("pid").agg(F.max_by(F.struct("userid", "dbid", "queryid", "status", "tags_json"), "seq").alias("r"))
        last = last.select("pid", "r.userid", "r.dbid", "r.queryid", F.when(F.col("r.status").isNull(), "active").otherwise("idle").alias("state"), "r.tags_json")
        shown = visible(caller, see_all)
        return last.withColumn("queryid", F.when(shown, F.col("queryid"))).withColumn("tags_json", F.when(shown, F.col("tags_json")))

    def counters(self) -> DataFrame:
        """One row of counters, from the executions and the entries.  Patterns
        are compiled when settings are read, so none fails later."""
        s = self.settings
        current = self.current if self.current is not None else 0
        from ..sources.executions import utility_missing_queryid

        capped = ["capped_tags", "cap_table_full", "dropped_tags"] if caps.capping(s) else []
        missing = F.coalesce(F.sum(utility_missing_queryid(s)), F.lit(0)).alias("utility_missing_queryid")
        counts = self.executions.agg(missing, *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("invalid_tags", *([] if capped else ["dropped_tags"]), "heuristic_scans", "exemplar_values_dropped", "normalized_tags")))
        start = store.bucket_start(F.lit(current), s.bucket_interval)
        closed = store.bucket_start(F.lit(current - 1), s.bucket_interval)
        zero = F.lit(0).cast("long")
        evicted = [F.lit((self.evictions or {}).get(c, 0)).cast("long").alias(c) for c in ("dealloc", "reclaimed_entries", "evicted_entries", "dropped_records")]
        since = F.min("stats_since") if self.reset_at is None else F.lit(self.reset_at)
        head = self.found.agg(F.count("*").alias("entries"), since.alias("stats_reset")).crossJoin(counts)
        if capped:
            head = head.crossJoin(self.kept.agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in capped)))
        else:
            head = head.withColumns({"capped_tags": zero, "cap_table_full": zero})
        return head.select(
            F.col("entries"), F.lit(s.max_entries).cast("long").alias("max_entries"), F.lit(s.bucket_count).cast("long").alias("buckets"), F.lit(s.bucket_interval).cast("long").alias("bucket_seconds"),
            start.alias("current_bucket_start"), closed.alias("last_closed_bucket_start"), F.col("stats_reset"), F.floor(F.unix_micros("stats_reset") / 1_000_000).alias("stats_reset_epoch"),
            F.lit(sizing.store_bytes(s.max_entries, s.max_tagset_bytes, s.bucket_count)).alias("shmem_bytes"), F.lit(s.exemplar_value_bytes).cast("long").alias("exemplar_value_bytes"),
            *evicted,
            "invalid_tags", "dropped_tags", "heuristic_scans", "normalized_tags", zero.alias("regex_compile_failures"), "utility_missing_queryid",
            "capped_tags", "cap_table_full", "exemplar_values_dropped", F.lit(s.server_major).cast("long").alias("server_major"),
        )

    def info(self) -> DataFrame:
        """The counters and the oldest live bucket, judged by one watermark."""
        s = self.settings
        current = self.current if self.current is not None else 0
        oldest = store.oldest_live(self.slots, current, s.bucket_count).select(store.bucket_start(F.col("oldest_bucket"), s.bucket_interval).alias("oldest_bucket"))
        return self.counters().crossJoin(oldest)

    def close(self) -> None:
        """Free what the store keeps; its views can't be read afterwards."""
        self.slots.unpersist()
        free(self.own)

    def create_views(self, spark: SparkSession, prefix: str = "context") -> None:
        """Temporary views: <prefix>, _totals, _last_bucket, _activity, _info, _counters."""
        self.stats().createOrReplaceTempView(prefix)
        self.totals().createOrReplaceTempView(f"{prefix}_totals")
        self.last_bucket().createOrReplaceTempView(f"{prefix}_last_bucket")
        self.activity().createOrReplaceTempView(f"{prefix}_activity")
        self.info().createOrReplaceTempView(f"{prefix}_info")
        self.counters().createOrReplaceTempView(f"{prefix}_counters")

    def reset(self, at: datetime | None = None) -> Store:
        """An empty store of the same watermark, without counters and
        admitted values; ``stats_reset`` is *at* (else the present)."""
        none = F.lit(False)
        latest, kept = (None if df is None else df.where(none) for df in (self.latest, self.kept))
        return Store(self.settings, self.executions.where(none), self.slots.where(none), self.found.where(none), latest, self.current, kept=kept, reset_at=at or datetime.now(UTC))


def has_tag(key: str, value: str | None = None) -> Column:
    """Whether the tag set holds a key, with a value or with null."""
    m = F.from_json("tags_json", "map<string,string>")
    there = F.map_contains_key(m, key)
    return there & (m[key].isNull() if value is None else F.coalesce(m[key] == value, F.lit(False)))


def tag(key: str) -> Column:
    return F.from_json("tags_json", "map<string,string>")[key]
