"""Store, caps, nesting, snapshots, streaming, sizing and statistics."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tagmeter.functions.model import BoundedStore
from tagmeter.operators import benchstats, caps, extract, nesting, reports, store, views
from tagmeter.operators.views import Store, has_tag
from tagmeter.plans import sizing
from tagmeter.plans.settings import Settings
from tagmeter.sources import executions, snapshot
from tagmeter.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return executions.from_events(spark.read.parquet(f"{SF}/events.parquet")).cache()


def test_sizing_table():
    """Documented totals of representative settings."""
    backends = sizing.max_backends()
    assert backends == 136 and sizing.max_backends(17) == 123 and sizing.max_backends(16) == 122
    assert sizing.store_bytes(10_000, 512, 12) == 9_261_312
    assert sizing.store_bytes(10_000, 512, 288) == 75_719_568
    assert sizing.store_bytes(50_000, 512, 12) == 46_130_976
    assert sizing.store_bytes(10_000, 512, 12, sizing.exemplar_bytes(10_000, 2 << 20, 1)) == 11_367_088
    assert sizing.store_bytes(2_000, 256, 12) == 1_356_800
    assert sizing.cap_bytes(16_384) == 147_488
    assert sizing.activity_bytes(backends, 512) == 75_088 and sizing.activity_bytes(backends, 256) == 40_272
    assert sizing.exemplar_layout(10_000, 2 << 20, 1)[0] == 206 and sizing.exemplar_layout(10_000, 2 << 20, 2)[0] == 102


def test_buckets_before_and_after_the_epoch(spark):
    df = spark.sql("SELECT timestamp'1999-12-31 23:59:59' AS t UNION ALL SELECT timestamp'2000-01-01 00:00:00' UNION ALL SELECT timestamp'2000-01-01 00:07:00'")
    got = [r[0] for r in df.select(store.bucket_id(F.col("t"), 420).alias("b")).orderBy("b").collect()]
    assert got == [-1, 0, 1]
    assert str(df.select(store.bucket_start(F.lit(1), 420).alias("s")).first()[0]) == "2000-01-01 00:07:00"


def test_clamp_matches_the_model(spark, monkeypatch):
    monkeypatch.setattr(store, "CHUNK", 7)
    rng = random.Random(4)
    rows = [(i, 946684800 + rng.randint(0, 90) + i) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, s long").select("seq", F.timestamp_seconds("s").alias("end_ts"))
    got = {r.seq: r.bucket_id for r in store.clamped(df, 10).collect()}
    high = -(10**9)
    for seq, s in rows:
        high = max(high, (s - 946684800) // 10)
        assert got[seq] == high


def test_batch_store_matches_the_model(spark, log):
    s = Settings(track="all", bucket_interval=86_400, bucket_count=5)
    built = Store.build(log, s)
    model = BoundedStore(s.max_entries, s.bucket_count)
    tagged = nesting.with_nesting(extract.with_tags(log, s)).where(executions.recorded(s)).withColumn("b", store.bucket_id(F.col("end_ts"), s.bucket_interval))
    for r in tagged.orderBy("seq").collect():
        model.record((r.dbid, r.userid, r.queryid, r.nesting_level == 0, r.tags_json), r.b, r.elapsed_ms)
    want = {(k, b): (c, round(ms, 6), ct) for k, b, c, ms, ct, _ in model.rows()}
    epoch = 946684800
    got = {((r.dbid, r.userid, r.queryid, r.toplevel, r.tags_json), (int(r.bucket_start.timestamp()) - epoch) // 86_400): (r.calls, round(r.total_exec_time, 6), r.calls_total) for r in built.stats().collect()}
    assert got == want
    assert built.reset().stats().count() == 0
    assert store.ring_violations(built.slots, built.found, built.current, 5).isEmpty()
    assert store.in_order(log, 86_400)


def test_close_frees_the_log(spark, log, tmp_path, monkeypatch):
    keep = views.once
    monkeypatch.setattr(views, "once", lambda df: keep(df, str(tmp_path)))
    built = Store.build(log, Settings(track="all", bucket_interval=86_400))
    assert built.totals().count() > 0 and len(list(tmp_path.iterdir())) == 1
    built.close()
    assert not list(tmp_path.iterdir())


def test_totals_example():
    """100 calls since the entry began, 10 of them live."""
    m = BoundedStore(100, 2)
    for _ in range(90):
        m.record(("k",), 0, 1.0)
    for _ in range(10):
        m.record(("k",), 5, 1.0)
    assert [(c, ct) for _, _, c, _, ct, _ in m.rows()] == [(10, 100)]
    m.record(("k",), 3, 1.0)  # late: raised to 5
    assert m.rows()[0][1:3] == (5, 11) and m.closed() == []


def test_eviction_golden_numbers():
    """125 entries into a table of 100: five passes, 25 live evictions."""
    m = BoundedStore(100, 12)
    for key in itertools.product(range(5), repeat=3):
        m.record(key, 1, 1.0)
    assert (m.counters["dealloc"], m.counters["evicted_entries"], len(m.entries)) == (5, 25, 100)
    assert m.reclaim() == 0 and m.advance(100) and m.reclaim() == 100


@pytest.mark.parametrize(("values", "cap", "absent", "want"), [(5, 0, False, 125), (7, 5, False, 216), (7, 5, True, 342)])
def test_cap_combinations(spark, values, cap, absent, want):
    names = [str(v) for v in range(values)] + ([None] if absent else [])
    rows = []
    for seq, (a, c, j) in enumerate(itertools.product(names, repeat=3)):
        tags = {k: v for k, v in (("action", a), ("controller", c), ("job", j)) if v is not None}
        rows.append((seq, 1, 1, "{" + ",".join(f'"{k}":"{v}"' for k, v in tags.items()) + "}", str([[k, v] for k, v in tags.items()]).replace("'", '"'), 0, 0))
    df = spark.createDataFrame(rows, "seq long, userid long, dbid long, tags_json string, candidates_json string, capped_tags long, dropped_tags long")
    s = Settings(cardinality_cap=cap)
    for run in (caps.with_caps, caps.with_caps_exact):
        assert run(df, s).where("tags_json <> '{}'").select("tags_json").distinct().count() == want
    assert caps.combinations(5, 3) == 125 and caps.combinations(5, 3, True) == 216 and caps.combinations(5, 3, True, True) == 342


def test_caps_keep_known_values_and_overrides(spark):
    df = spark.createDataFrame([(i, 1, 1, f'{{"action":"{v}","job":"{v}"}}') for i, v in enumerate("abcab")], "seq long, userid long, dbid long, tags_json string")
    s = Settings(cardinality_cap=1, cardinality_cap_overrides="job:0")
    got = [r.tags_json for r in caps.with_caps(df, s).orderBy("seq").collect()]
    assert got == ['{"action":"a","job":"a"}', '{"action":null,"job":"b"}', '{"action":null,"job":"c"}', '{"action":"a","job":"a"}', '{"action":null,"job":"b"}']
    known = spark.createDataFrame([("1/1", "action", "z")], "scope string, key string, value string")
    assert caps.with_caps(df, s, known).where(has_tag("action")).count() == 5


def in_turn(rows, keys, cap, slots, room):
    """Caps and the limit on size, one execution after the other: (tags, nulls, lost to a full table, dropped)."""
    seen, used, out = {}, 0, []
    for user, tags in rows:
        left, kept, null, full, gone = room, {}, 0, 0, 0
        for k in [k for k in keys if k in tags]:
            v, known = tags[k], seen.setdefault((user, k), set())
            over, none_left = v not in known and len(known) >= cap, v not in known and len(known) < cap and used >= slots
            need = len(k) + 2 + (1 if over or none_left else len(v))
            if over or none_left:
                if len(k) + 3 > left:
                    gone += 1
                    continue
                null, full = null + 1, full + none_left
            elif need > left:
                gone += 1
                continue
            elif v not in known:
                known.add(v)
                used += 1
            left -= len(k) + 3 if over or none_left else need
            kept[k] = None if over or none_left else v
        out.append((kept, null, full, gone))
    return out


@pytest.mark.parametrize(("cap", "values", "users"), [(3, 6, (0, 1, 2)), (900, 700, (0, 1))])
def test_caps_meet_limits_on_size(spark, log, cap, values, users):
    """In one scope all tags fit, in the others many don't; at 900 the slots run out."""
    rng = random.Random(cap)
    rows = []
    for _ in range(900):
        user = rng.choice(users)
        longest = 20 if user == 2 else 70
        rows.append((user, {k: f"{rng.randrange(values)}".ljust(rng.randrange(4, longest), "x") for k in ("job", "action", "controller") if rng.random() < 0.8}))
    text = [(i, u, "SELECT 1 /*" + ",".join(f"{k}:{v}" for k, v in t.items()) + "*/") for i, (u, t) in enumerate(rows)]
    one = log.limit(1).drop("seq", "userid", "query_string", "nesting_level", "dbid")
    df = one.crossJoin(spark.createDataFrame(text, "seq long, userid long, query_string string")).withColumns({"nesting_level": F.lit(0), "dbid": F.lit(1).cast("long")})
    keys = ("action", "controller", "job")
    s = Settings(track="all", untagged="record", cardinality_cap=cap, cardinality_cap_slots=256, max_tagset_bytes=128, max_tag_value_len=128)
    want = in_turn(rows, keys, cap, 256, 128)
    built = Store.build(df, s)
    got = built.kept.orderBy("seq").collect()
    assert [json.loads(r.tags_json) for r in got] == [w[0] for w in want]
    assert [(r.capped_tags, r.cap_table_full, r.dropped_tags) for r in got] == [w[1:] for w in want]
    c, total = built.counters().first(), [sum(w[i] for w in want) for i in (1, 2, 3)]
    assert [c.capped_tags, c.cap_table_full, c.dropped_tags] == total and total[0] and total[2] and bool(total[1]) == (cap == 900)
    empty = built.reset().counters().first()
    assert (empty.entries, empty.capped_tags, empty.dropped_tags) == (0, 0, 0) and empty.stats_reset is not None


def test_a_scope_is_folded_in_one_task(spark, tmp_path):
    """Each scope admits its first value, also where the join that finds the
    scopes to fold becomes a broadcast while it runs."""
    rows = [(i, i % 3, 1, f'{{"action":"v{i * 7 % 10}"}}', f'[["action","v{i * 7 % 10}"],["job","x"]]', 0, 0) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, userid long, dbid long, tags_json string, candidates_json string, capped_tags long, dropped_tags long")
    for part in range(4):
        df.where(f"seq % 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.files.openCostInBytes": str(128 << 20), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {(r.userid, r.tags_json) for r in caps.applied(spark.read.parquet(str(tmp_path / "log")), Settings(cardinality_cap=1, max_tags=1)).collect()}
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert got == {(u, t) for u, v in ((0, "v0"), (1, "v7"), (2, "v4")) for t in (f'{{"action":"{v}"}}', '{"action":null}')}


def test_exact_and_plain_paths_agree(spark, log):
    s = Settings(track="all")
    a = extract.with_tags(log, s, fast=True).select("seq", "tags_json")
    b = extract.with_tags(log, s, fast=False).select("seq", "tags_json")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    plain = log.select(extract.plain_tags(s).alias("p"))
    assert plain.where("p is not null").count() > 0


def test_registered_function(spark):
    extract.register(spark, Settings())
    assert '"controller": "x"' in spark.sql("SELECT extract_tags('SELECT 1 /*controller:x*/', -1, 0)").first()[0]


def test_nesting_spreads_the_log(spark):
    """Statements that ask for no root's tags don't meet in one task, nor do
    nested ones without a root; a level that isn't known keeps its own tags."""
    rows = spark.range(4000, numPartitions=4).selectExpr(
        "id AS seq", "CASE WHEN id % 4 = 0 THEN 1 WHEN id % 400 = 1 THEN NULL ELSE 0 END AS nesting_level", "false AS during_planning",
        "CASE WHEN id % 8 = 0 THEN id + 1 END AS root_seq", "concat('{\"job\":\"', id, '\"}') AS tags_json",
    )
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = nesting.with_nesting(rows).select("seq", "tags_json", F.spark_partition_id().alias("task")).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    want = {i: "{}" if i % 8 == 4 else f'{{"job":"{i + (i % 8 == 0)}"}}' for i in range(4000)}
    assert len(got) == 4000 and {r.seq: r.tags_json for r in got} == want
    tasks = [r.task for r in got]
    assert max(map(tasks.count, set(tasks))) <= 1500
    bare = [r.task for r in got if r.tags_json == "{}"]
    assert max(map(bare.count, set(bare))) <= 250


def test_activity_sorts_no_log(spark, log):
    """The latest top-level statement of each session; only rows that can be it
    are compared with their text."""
    built = Store.build(log, Settings(track="all", bucket_interval=86_400))
    want = {}
    for r in built.executions.where("nesting_level = 0").orderBy("seq").collect():
        want[r.pid] = (r.userid, r.dbid, r.queryid, "idle", r.tags_json)
    assert {r.pid: (r.userid, r.dbid, r.queryid, r.state, r.tags_json) for r in built.activity().collect()} == want
    plain = Store.build(log, Settings(track="all", bucket_interval=86_400, nested_tags="scan"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plain.activity()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "LeftSemi" in plan[plan.rindex("SortAggregate") :]


def test_recorded_predicates(spark, log):
    base = extract.with_tags(log.limit(50), Settings())
    n = base.count()
    odd = base.withColumn("status", F.when(F.col("seq") % 2 == 0, "error").otherwise("ok"))
    s = Settings(track="all", untagged="record")
    assert odd.where(executions.recorded(s)).count() == odd.where("status = 'ok'").count()
    assert base.where(executions.recorded(s.but(enabled=False))).count() == 0 and base.where(executions.recorded(s.but(track="none"))).count() == 0
    util = base.withColumn("is_utility", F.lit(True)).withColumn("command_tag", F.lit("DEALLOCATE"))
    assert util.where(executions.recorded(s.but(server_major=16))).count() == 0 and util.where(executions.recorded(s)).count() == n
    assert util.withColumn("queryid", F.lit(0)).select(executions.utility_missing_queryid(s).alias("m")).agg(F.sum("m")).first()[0] == n


def test_snapshot(spark, log, tmp_path):
    s = Settings(track="all", bucket_interval=86_400)
    built = Store.build(log, s)
    path = f"file://{tmp_path}/snap"
    snapshot.save(built.slots, s, built.current, path)
    slots, current = snapshot.load(spark, s, built.current, path)
    alive = built.found.where(F.col("last_bucket") >= current - 11).count()
    assert store.entries(slots).count() == alive and current == built.current
    assert snapshot.load(spark, s, built.current, path)[0] is None  # loaded once
    snapshot.save(built.slots, s, built.current, path)
    few, _ = snapshot.load(spark, s.but(max_entries=100), built.current, path, unlink=False)
    assert store.entries(few).count() == 100
    (tmp_path / "snap").rename(tmp_path / "snap.old")  # as if saving had ended there
    assert snapshot.load(spark, s, built.current, path, unlink=False)[0] is not None
    (manifest,) = (tmp_path / "snap" / "manifest").glob("part-*.txt")
    told = manifest.read_text()
    for crc in (tmp_path / "snap" / "manifest").glob(".*.crc"):
        crc.unlink()
    manifest.write_text(told.replace('"rows": ', '"rows": 1'))
    assert snapshot.load(spark, s, built.current, path)[0] is None and not (tmp_path / "snap").exists()
    snapshot.save(built.slots, s, built.current, path)
    assert snapshot.load(spark, s.but(bucket_count=3), built.current, path)[0] is None
    assert snapshot.load(spark, s, built.current, path)[0] is None  # discarded above


def test_streams_match_the_batch(spark, log, tmp_path):
    s = Settings(track="all", bucket_interval=86_400, bucket_count=1000)
    tagged = extract.with_tags(log, s).where(executions.recorded(s))
    names = ["seq", "end_ts", "dbid", "userid", "queryid", "nesting_level", "tags_json", "exemplars_json", "elapsed_ms"]
    for part in range(3):
        tagged.where(f"seq % 3 = {part}").select(*names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tagged.select(*names).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = {(r.dbid, r.userid, r.queryid, r.toplevel, r.tags_json, r.bucket_id): r.calls for r in store.aggregate(tagged.withColumn("bucket_id", store.bucket_id(F.col("end_ts"), 86_400))).collect()}

    sink = str(tmp_path / "out")
    live.bucket_stream(stream, s).writeStream.outputMode("update").foreachBatch(live.upsert(sink)).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.dbid, r.userid, r.queryid, r.toplevel, r.tags_json, (int(r.bucket_start.timestamp()) - 946684800) // 86_400): r.calls for r in live.merged(spark.read.parquet(sink)).collect()}
    assert got == want

    batches = []
    live.exact_store(stream, s).writeStream.outputMode("update").foreachBatch(lambda df, i: batches.append(df.collect())).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert sum(r.calls for r in batches[-1]) == sum(want.values())


def test_nesting_levels(spark):
    df = spark.sql("SELECT array(named_struct('command_tag', 'EXECUTE', 'is_utility', true), named_struct('command_tag', 'DO', 'is_utility', true)) AS parents, true AS during_planning")
    assert df.select(executions.nesting_level().alias("n")).first()[0] == 2
    assert df.select(executions.nesting_level(server_major=16).alias("n")).first()[0] == 0


def test_statistics(spark, tmp_path):
    for level, n, want in ((0.95, 1, 12.706), (0.95, 9, 2.2622), (0.99, 9, 3.2498), (0.95, 30, 2.0423)):
        assert math.isclose(benchstats.t_quantile(level, n), want, rel_tol=1e-4)
    (tmp_path / "log").write_text("".join(f"0 {i} {i * 1000} 0 946684800 {i}\n" for i in range(1, 11)))
    got = benchstats.latency_summary(benchstats.latency_log(spark, str(tmp_path / "log"))).first()
    assert (got.n, got.p50_ms, got.p95_ms, got.max_ms) == (10, 5.0, 10.0, 10.0)
    assert benchstats.simultaneous_level(5) == pytest.approx(0.99)
    assert sorted(c for b, c in benchstats.block_plan(["a", "b"], 3) if b == 1) == ["a", "b"]
    runs = spark.createDataFrame([("ro", b, c, None if c == "base" else "base", float(v)) for b in range(4) for c, v in (("base", 10 + b), ("ext", 12 + b))], "scenario string, block int, config string, baseline string, us double")
    row = benchstats.intervals(benchstats.paired(runs, "us")).withColumn("v", benchstats.verdict()).first()
    assert row["mean"] == 2 and row["v"] == "slower"
    assert benchstats.headline(benchstats.intervals(benchstats.paired(runs, "us"))).first()["resolved"] == 1
    with pytest.raises(ValueError, match="two runs"):
        benchstats.paired(runs.unionAll(runs), "us")
    benchstats.write_summaries(runs, str(tmp_path / "runs"))
    assert benchstats.read_summaries(spark, str(tmp_path / "runs"), "scenario string, us double").count() == 8


def test_exporters(spark, log):
    s = Store.build(log, Settings(track="all", bucket_interval=86_400))
    s.create_views(spark)
    assert spark.sql("SELECT count(*) FROM context_totals").first()[0] > 0
    rate = reports.report(spark, "rate_last_bucket", s)
    assert reports.with_start_time(rate, s.counters()).columns[-1] == "start_time_unix_nano"
    line = reports.exposition(spark.sql("SELECT 'a\"b\\\\c' AS l, 1 AS v"), "m", ["l"]).first()[0]
    assert line == 'm_v{l="a\\"b\\\\c"} 1'


def test_table_function(spark):
    extract.register_table_function(spark, Settings())
    got = spark.sql("SELECT q.i, t.key, t.value FROM VALUES (1, 'SELECT 1 /*controller:x,action:y*/'), (2, 'SELECT 1') q(i, s), LATERAL tags_of(q.s) t ORDER BY key").collect()
    assert [tuple(r) for r in got] == [(1, "action", "y"), (1, "controller", "x")]


def test_statements_of_one_string(spark, log):
    """Leading comments belong to their statement even far into a string."""
    text = "SELECT 1; " * 500 + "/*controller:lead*/ SELECT 2"
    rows = [(i * 10, 8) for i in range(500)] + [(5020, 8)]
    one = log.limit(1).drop("query_string", "stmt_location", "stmt_len", "pid").crossJoin(spark.createDataFrame([(text, a, n, 1) for a, n in rows], "query_string string, stmt_location int, stmt_len int, pid int"))
    got = extract.with_tags(extract.with_since(one), Settings(extractors="marginalia(position=prepend)"))
    assert [r.stmt_location for r in got.where("tags_json <> '{}'").collect()] == [5020]
