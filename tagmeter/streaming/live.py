"""The store over a stream (N1-N9, E9-E12): exact in one state, or sharded.

``exact`` keeps the whole bounded store in one key's state, so eviction and
the watermark are global, as in a single server, and late rows are raised to
it.  Otherwise the stream is aggregated by entry and bucket in parallel; state
expires with the live window, late rows count in the bucket where they ended,
and rows that are older than the live window are dropped.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.model import BoundedStore
from ..operators import store
from ..operators.store import KEY

OUT = "dbid long, userid long, queryid long, toplevel boolean, tags_json string, bucket_id long, calls long, total_exec_time double, calls_total long, exec_time_total double"


def exact_store(rows: DataFrame, settings) -> DataFrame:
    """A stream of tagged executions to the live slots after each batch."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = pickle.loads(state.get[0]) if state.exists else BoundedStore(settings.max_entries, settings.bucket_count)
        for batch in batches:
            for r in batch.sort_values("seq").itertuples():
                entry = (r.dbid, r.userid, r.queryid, bool(r.toplevel), r.tags_json)
                model.record(entry, r.bucket, r.elapsed_ms, 0, json.loads(r.exemplars_json or "{}"))
        state.update((pickle.dumps(model),))
        out = [(*k, b, c, ms, ct, et) for k, b, c, ms, ct, et in model.rows()]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    narrow = rows.select(
        F.lit(0).alias("one"), "seq", "dbid", "userid", "queryid", (F.col("nesting_level") == 0).alias("toplevel"), "tags_json", "elapsed_ms", "exemplars_json",
        store.bucket_id(F.col("end_ts"), settings.bucket_interval).alias("bucket"),
    )
    return narrow.groupBy("one").applyInPandasWithState(step, OUT, "model binary", "update", GroupStateTimeout.NoTimeout)


def bucket_stream(rows: DataFrame, settings) -> DataFrame:
    """Sharded: calls and time by entry and tumbling bucket, kept as long as a
    bucket may be live.  The window's start follows the 2000 grid."""
    interval = settings.bucket_interval
    offset = (store.EPOCH_US // 1_000_000) % interval
    kept = rows.withWatermark("end_ts", f"{interval * settings.bucket_count} seconds").withColumn("toplevel", F.col("nesting_level") == 0)
    window = F.window("end_ts", f"{interval} seconds", None, f"{offset} seconds")
    return kept.groupBy(window, *KEY).agg(F.count("*").alias("calls"), F.sum("elapsed_ms").alias("total_exec_time")).select(F.col("window.start").alias("bucket_start"), *KEY, "calls", "total_exec_time")


def upsert(path: str):
    """A foreachBatch sink: each batch's slots are added to a table of slots,
    written aside and swapped, so a batch that runs twice counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write


def merged(df: DataFrame) -> DataFrame:
    """Slots of all batches that ``upsert`` wrote: the latest update of each."""
    latest = F.struct("batch_id", "calls", "total_exec_time")
    return df.groupBy("bucket_start", *KEY).agg(F.max(latest).alias("r")).select("bucket_start", *KEY, "r.calls", "r.total_exec_time")
