"""Cardinality caps: the first N distinct values of a key in a scope are kept,
later ones become null (H1-H8, D-8, D-10)."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.tagset import Pipeline, Result, to_json

TAGS, PAIRS = "map<string,string>", "array<array<string>>"
#: Columns that the fold makes anew.
FOLDED = ("tags_json", "capped_tags", "dropped_tags", "cap_table_full")
#: Slots up to which the admitted values are broadcast.
MAX_BROADCAST = 1_000_000


def scope_of(settings) -> Column:
    """H3: the role in its database, the database, or the server."""
    if settings.cardinality_cap_scope == "role":
        return F.concat_ws("/", F.col("userid").cast("string"), F.col("dbid").cast("string"))
    if settings.cardinality_cap_scope == "database":
        return F.col("dbid").cast("string")
    return F.lit("server")


def cap_of(settings, key: str | Column = "key") -> Column:
    """H2: the cap of a key; 0 exempts it."""
    out = F.lit(settings.cardinality_cap)
    for k, n in settings.parsed["caps"].items():
        out = F.when((F.col(key) if isinstance(key, str) else key) == k, F.lit(n)).otherwise(out)
    return out


def admitted(df: DataFrame, settings, known: DataFrame | None = None) -> DataFrame:
    """(scope, key, value, first_seq) of the values that caps admit, in order
    of arrival.  *known*: values admitted before stay (H6).

    Values are reduced to first arrivals on the map side; the rank is cut at
    the cap before it is shuffled.  Of all admitted values, the first
    ``cardinality_cap_slots`` hold a slot (H5).
    """
    each = df.select("seq", scope_of(settings).alias("scope"), F.explode(F.from_json("tags_json", TAGS)).alias("key", "value"))
    each = each.where(cap_of(settings) > 0)
    first = each.groupBy("scope", "key", "value").agg(F.min("seq").alias("first_seq"))
    if known is not None:
        first = first.unionByName(known.select("scope", "key", "value", F.lit(-1).cast("long").alias("first_seq"))).groupBy("scope", "key", "value").agg(F.min("first_seq").alias("first_seq"))
    rank = F.row_number().over(Window.partitionBy("scope", "key").orderBy("first_seq", "value"))
    ranked = first.withColumn("rank", rank).where(F.col("rank") <= _most(settings)).where((F.col("rank") <= cap_of(settings)) | (F.col("first_seq") < 0)).drop("rank")
    return ranked.orderBy("first_seq", _rank_of(settings), "scope", "value").limit(settings.cardinality_cap_slots)


def _most(settings) -> int:
    return max([settings.cardinality_cap, *settings.parsed["caps"].values(), 1])


def capping(settings) -> bool:
    return bool(settings.cardinality_cap or settings.parsed["caps"])


def _rank_of(settings) -> Column:
    """The order in which the keys of one execution ask for slots."""
    keys = settings.parsed["tags"]
    return F.col("key") if keys == ("*",) else F.array_position(F.array(*map(F.lit, keys)), F.col("key"))


def with_caps(df: DataFrame, settings, known: DataFrame | None = None) -> DataFrame:
    """*df* with tags_json, capped_tags and cap_table_full after caps, set-based.

    Exact where no tag was dropped for want of room (``dropped``).  The admitted values,
    at most ``cardinality_cap_slots``, meet the executions by scope and tag
    sets are rewritten in place, so the log itself isn't shuffled where they
    can be broadcast."""
    if not capping(settings):
        return df.withColumn("cap_table_full", F.lit(0).cast("long"))
    ok = admitted(df, settings, known).groupBy("scope", "key").agg(F.collect_list("value").alias("v"))
    ok = ok.groupBy(F.col("scope").alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("_ok"))
    if settings.cardinality_cap_slots <= MAX_BROADCAST:
        ok = F.broadcast(ok)
    none = F.array().cast("array<string>")

    def held(k: Column) -> Column:
        return F.coalesce(F.col("_ok")[k], none)

    tags = F.from_json("tags_json", TAGS)
    new = F.transform_values(tags, lambda k, v: F.when((cap_of(settings, k) == 0) | F.array_contains(held(k), v), v))
    lost = F.size(F.filter(F.map_values("_new"), lambda v: v.isNull()))
    # a key below its cap loses values only to a full table
    short = F.size(F.filter(F.map_entries("_new"), lambda e: e["value"].isNull() & (F.size(held(e["key"])) < cap_of(settings, e["key"]))))
    rows = df.withColumn("_scope", scope_of(settings)).join(ok, F.col("_scope") == F.col("_s"), "left").withColumn("_new", new)
    rows = rows.withColumn("capped_tags", F.coalesce(lost, F.lit(0)).cast("long")).withColumn("cap_table_full", F.coalesce(short, F.lit(0)).cast("long"))
    return rows.withColumn("tags_json", F.when(F.col("capped_tags") > 0, F.to_json("_new")).otherwise(F.col("tags_json"))).drop("_scope", "_s", "_ok", "_new")


def dropped(settings) -> Column:
    """Whether an execution has tags that found no room, or may not find any
    once they are null, which takes a byte more than an empty value."""
    less = F.size(F.from_json("candidates_json", PAIRS)) > F.size(F.from_json("tags_json", TAGS))
    tight = F.col("tags_json").contains(':""') & (F.octet_length("tags_json") > settings.max_tagset_bytes)
    return F.coalesce(less, F.lit(False)) | tight


def applied(df: DataFrame, settings) -> DataFrame:
    """*df* (with candidates_json) after caps and limits on size, as a server
    applies them one execution after the other (D-8, D-10, H4, H5).

    Scopes in which every tag found room take ``with_caps``; the others are
    folded in order.  Scopes depend on each other only through the slots, so
    the fold runs by scope unless the slots could run out, and else over the
    whole log."""
    if not capping(settings):
        return with_caps(df, settings).drop("candidates_json")
    over = df.where(dropped(settings)).select(scope_of(settings).alias("_over")).distinct()
    if over.isEmpty():
        return with_caps(df, settings).drop("candidates_json")
    asked = df.select(scope_of(settings).alias("scope"), F.explode(F.coalesce(F.from_json("candidates_json", PAIRS), F.array().cast(PAIRS))).alias("p"))
    plain = df.where("candidates_json is null").select(scope_of(settings).alias("scope"), F.explode(F.map_entries(F.from_json("tags_json", TAGS))).alias("e"))
    asked = asked.select("scope", F.col("p")[0].alias("key"), F.col("p")[1].alias("value")).unionByName(plain.select("scope", "e.key", "e.value"))
    most = asked.distinct().groupBy("scope", "key").count().agg(F.sum(F.least(F.col("count"), cap_of(settings)))).first()[0] or 0
    if most > settings.cardinality_cap_slots:
        return with_caps_exact(df, settings, whole=True).drop("candidates_json")
    mine = scope_of(settings) == F.col("_over")
    rest, bad = df.join(over, mine, "left_anti"), df.join(over, mine, "left_semi")
    return with_caps(rest, settings).unionByName(with_caps_exact(bad, settings)).drop("candidates_json")


class Admission:
    """Sequential admission (H1, H4, H5, H7); the slots are common to all
    scopes.  A call tells whether the caps let a value be, and admits it if
    *admit*; ``was_full`` tells whether the last one lacked a slot."""

    def __init__(self, settings) -> None:
        self.cap, self.caps, self.slots = settings.cardinality_cap, settings.parsed["caps"], settings.cardinality_cap_slots
        self.values: dict[tuple[str, str], set[str]] = {}
        self.scope, self.used, self.was_full = "", 0, False

    def __call__(self, key: str, value: str, admit: bool = True) -> bool:
        self.was_full = False
        cap = self.caps.get(key, self.cap)
        if not cap:
            return True
        known = self.values.setdefault((self.scope, key), set())
        if value in known:
            return True
        if len(known) >= cap:
            return False
        if self.used >= self.slots:
            self.was_full = True
            return False
        if admit:
            known.add(value)
            self.used += 1
        return True


def with_caps_exact(df: DataFrame, settings, whole: bool = False) -> DataFrame:
    """As with_caps, as a fold in order of arrival, where caps and limits on
    size interact; dropped_tags is counted anew.  A task sorts its scopes
    (*whole*: the log) on disk if need be and reads them batch by batch; it
    holds no more than the admitted values of one scope (*whole*: of all)."""
    pipeline = Pipeline(settings)
    names = [c for c in df.columns if c not in FOLDED]
    out = StructType([df.schema[c] for c in names] + [StructField("tags_json", StringType())] + [StructField(c, LongType()) for c in FOLDED[1:]])

    def fold(batches):
        cap = Admission(settings)
        for rows in batches:
            got = []
            for scope, tags, text in zip(*(rows.column(c).to_pylist() for c in ("_scope", "tags_json", "candidates_json")), strict=True):
                if scope != cap.scope:
                    cap.scope = scope
                    if not whole:
                        cap.values.clear()
                r = Result(candidates=list(json.loads(tags).items()) if text is None else [tuple(x) for x in json.loads(text)])
                pipeline.place(r, cap)
                got.append((to_json(r.tags), r.counts.get("capped_tags", 0), r.counts.get("dropped_tags", 0), r.counts.get("cap_table_full", 0)))
            cols = list(zip(*got, strict=True)) or [()] * 4
            more = [pa.array(cols[0], pa.string())] + [pa.array(c, pa.int64()) for c in cols[1:]]
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in names] + more, names=[*names, *FOLDED])

    rows = df.withColumn("_scope", scope_of(settings))
    # dealt by the scope itself, rows that come from a join on it would not be
    # shuffled again, and that join's shuffle may be read by mapper
    order = rows.repartition(1).sortWithinPartitions("seq") if whole else rows.repartition(F.xxhash64("_scope")).sortWithinPartitions("_scope", "seq")
    return order.mapInArrow(fold, out)


def combinations(cap: int, keys: int, capped: bool = False, absent: bool = False) -> int:
    """H9: entries that capped keys can make together."""
    n = cap + int(capped) + int(absent)
    return n**keys - int(absent)
