"""Every engine query beside its SQL, on the smallest tables."""

import duckdb
import pytest

from tagmeter import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in data])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    # what an eviction frees depends on all arrivals before it
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"bounded_store"}


def test_no_query_is_empty(spark):
    for name in ("paired_interval", "paired_ratio", "ring_violations", "boundary_split", "bounded_store"):
        assert queries.QUERIES[name](spark, SF).count() > 0


def test_bounded_store(spark):
    """Against the sequential model over the same log."""
    from tagmeter.functions.model import BoundedStore
    from tagmeter.operators import store
    from tagmeter.sources import executions
    from tagmeter.operators.views import Store
    from tagmeter.plans.settings import Settings

    s = Settings(**(queries.BASE | {"max_entries": 100, "nested_tags": "scan"}))
    log = executions.from_events(spark.read.parquet(f"{SF}/events.parquet"))
    built, whole = Store.build(log, s), Store.build(log, s.but(max_entries=100_000))
    counted = built.counters().first()
    assert whole.found.count() > 100 >= counted.entries and counted.evicted_entries > 0 and counted.dealloc > 0
    model = BoundedStore(100, s.bucket_count)
    for r in sorted(whole.executions.where("tags_json <> '{}'").collect(), key=lambda r: r.seq):
        bucket = (int(r.end_ts.timestamp() * 1_000_000) - store.EPOCH_US) // 86_400_000_000
        model.record((r.dbid, r.userid, r.queryid, r.nesting_level == 0, r.tags_json), bucket, r.elapsed_ms)
    assert {c: counted[c] for c in model.counters} == model.counters
    assert {tuple(r[k] for k in store.KEY): r.calls_total for r in built.found.collect()} == {k: e.calls_total for k, e in model.entries.items()}
    per_entry = {}
    for r in whole.stats().collect():
        key = (r.dbid, r.userid, r.queryid, r.toplevel, r.tags_json)
        assert per_entry.get(key, r.bucket_start) <= r.bucket_start
        per_entry[key] = r.bucket_start


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(queries.QUERIES) <= set(e.queries())
