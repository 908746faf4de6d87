"""Saving and loading a store."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..operators.store import KEY

VERSION = 1


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def save(slots: DataFrame, settings, current: int, path: str) -> None:
    """Slots as Parquet with a manifest, made aside and renamed, so that a
    reader sees a whole snapshot or none."""
    spark = slots.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}"
    slots.write.parquet(f"{aside}/slots")
    rows = spark.read.parquet(f"{aside}/slots").agg(F.count("*").alias("n"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls")).first()
    manifest = {"version": VERSION, "bucket_interval": settings.bucket_interval, "bucket_count": settings.bucket_count, "current": current, "rows": rows["n"], "calls": rows["calls"]}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{aside}/manifest")
    fs, target = _fs(spark, path)
    old = _fs(spark, f"{path}.old")[1]
    if fs.exists(target):  # the old one stays until the new one is in place
        fs.delete(old, True)
        fs.rename(target, old)
    fs.rename(_fs(spark, aside)[1], target)
    fs.delete(old, True)


def load(spark: SparkSession, settings, now_bucket: int, path: str, unlink: bool = True) -> tuple[DataFrame | None, int]:
    """(slots, watermark) of a snapshot, or (None, now) where it must be
    discarded: another version, interval or bucket count, or contents that
    don't match the manifest.  Dead entries and tag sets over the limit go;
    over ``max_entries`` the least recent do.  *unlink*: a snapshot is loaded
    once; what was loaded is kept aside as ``<path>.loaded``, since the slots
    are read from there, and what is discarded is deleted."""
    fs, target = _fs(spark, path)
    if not fs.exists(target) and fs.exists(old := _fs(spark, f"{path}.old")[1]):
        fs.rename(old, target)  # saving ended between its two renames
    if not fs.exists(target):
        return None, now_bucket
    m = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if (m["version"], m["bucket_interval"], m["bucket_count"]) != (VERSION, settings.bucket_interval, settings.bucket_count):
        if unlink:
            fs.delete(target, True)
        return None, now_bucket
    slots = spark.read.parquet(f"{path}/slots")
    got = slots.agg(F.count("*").alias("n"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls")).first()
    if (got["n"], got["calls"]) != (m["rows"], m["calls"]):
        if unlink:
            fs.delete(target, True)
        return None, now_bucket
    if unlink:
        loaded = _fs(spark, f"{path}.loaded")[1]
        fs.delete(loaded, True)
        fs.rename(target, loaded)
        slots = spark.read.parquet(f"{path}.loaded/slots")
    current = max(now_bucket, m["current"])
    found = store.entries(slots).where(F.col("last_bucket") >= current - settings.bucket_count + 1)
    size = F.aggregate(F.map_entries(F.from_json("tags_json", "map<string,string>")), F.lit(0), lambda a, e: a + F.octet_length(e["key"]) + 2 + F.coalesce(F.octet_length(e["value"]), F.lit(0)))
    found = found.where(size <= settings.max_tagset_bytes)
    if found.count() > settings.max_entries:
        found = found.orderBy(F.col("last_bucket").desc(), F.col("calls_total").desc(), *KEY).limit(settings.max_entries)
    return slots.join(found.select(*KEY), KEY, "left_semi"), current
