"""Registered queries over the driver's tables, each with SQL that derives the
same rows independently: the oracle never parses a comment, it knows from the
shape of each text which tags it must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import benchstats, caps, extract, nesting, reports, store, views
from .plans.settings import Settings
from .sources import executions

#: events span a month, so buckets are days.
BASE = dict(track="all", bucket_interval=86_400, bucket_count=12)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executions.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _store(spark: SparkSession, sf_dir: str, **changes) -> views.Store:
    return views.Store.build(_events(spark, sf_dir), Settings(**(BASE | changes)))


def _statements(df: DataFrame) -> DataFrame:
    rows = df.withColumn("toplevel", F.col("nesting_level") == 0)
    out = rows.groupBy("userid", "dbid", "queryid", "toplevel").agg(F.count("*").alias("calls"), F.sum("elapsed_ms").alias("total_exec_time"))
    return out.withColumn("query", F.concat(F.lit("SELECT "), F.col("queryid").cast("string"))).withColumn("shared_blks_read", F.col("queryid") * 10)


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def _report(name: str, **changes) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _store(spark, sf_dir, **changes)
        text, more = reports.REPORTS[name], {}
        if "{statements}" in text:
            more["statements"] = _statements(s.executions)
        if "{databases}" in text:
            more["databases"] = spark.sql("SELECT * FROM VALUES (0L, 'main'), (1L, 'shop') AS d(oid, datname)")
        if "{sessions}" in text:
            more["sessions"] = spark.sql("SELECT cast(id AS int) AS pid, concat('user', id) AS usename FROM range(10)")
        if "{now_us}" in text:
            more["now_us"] = s.executions.agg(F.max(F.unix_micros("end_ts"))).first()[0]
        out = reports.report(spark, name, s, **more)
        return _ntz(out, "bucket_start") if "bucket_start" in out.columns else out

    return run


_EX = """
ex AS (SELECT event_id AS seq, ts AS end_ts, user_id % 3 AS dbid, user_id % 5 AS userid, event_id % 23 + 1 AS queryid, event_id % 4 <> 0 AS toplevel, value AS ms,
         event_type AS e, coalesce(json_extract_string(props, '$.k'), '') AS k, event_id % 6 AS m, CAST(user_id % 17 AS INTEGER) AS pid FROM events),
own AS (SELECT *, CASE m WHEN 1 THEN CAST(json_object('action', 'show', 'controller', e) AS VARCHAR) WHEN 2 THEN CAST(json_object('action', 'show', 'controller', e) AS VARCHAR)
         WHEN 3 THEN CAST(json_object('controller', e) AS VARCHAR) WHEN 4 THEN CAST(json_object('job', e) AS VARCHAR) ELSE '{}' END AS own_tags FROM ex),
tg AS (SELECT o.*, %TAGS% AS tags_json FROM own o LEFT JOIN own r ON r.seq = o.seq + 1 AND NOT o.toplevel)"""
_INHERIT = "CASE WHEN o.toplevel THEN o.own_tags ELSE coalesce(r.own_tags, '{}') END"
_SLOTS = """,
rec AS (SELECT *, max(CAST(floor((epoch_us(end_ts) - 946684800000000) / 86400000000.0) AS BIGINT)) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS b FROM tg WHERE %KEEP%),
slots AS (SELECT dbid, userid, queryid, toplevel, tags_json, b, count(*) AS calls, sum(ms) AS ms, min(end_ts) AS first_ts FROM rec GROUP BY ALL),
cur AS (SELECT max(b) AS c FROM slots),
ent AS (SELECT dbid, userid, queryid, toplevel, tags_json, CAST(sum(calls) AS BIGINT) AS calls_total, sum(ms) AS exec_time_total, min(first_ts) AS stats_since, max(b) AS last_bucket FROM slots GROUP BY ALL),
live AS (SELECT s.*, make_timestamp(b * 86400000000 + 946684800000000) AS bucket_start FROM slots s, cur WHERE b BETWEEN c - 11 AND c),
tot AS (SELECT dbid, userid, queryid, toplevel, tags_json, min(bucket_start) AS bucket_start, CAST(sum(calls) AS BIGINT) AS calls, sum(ms) AS ms FROM live GROUP BY ALL),
lastb AS (SELECT l.* FROM live l, cur WHERE b = c - 1),
st AS (SELECT userid, dbid, queryid, toplevel, count(*) AS calls, sum(ms) AS total, 'SELECT ' || queryid AS query, queryid * 10 AS blks FROM tg GROUP BY ALL),
db AS (SELECT * FROM (VALUES (0, 'main'), (1, 'shop')) AS d(oid, datname))
"""


def _sql(select: str, tags: str = _INHERIT, keep: str = "tags_json <> '{}'") -> str:
    return "WITH " + _EX.replace("%TAGS%", tags) + _SLOTS.replace("%KEEP%", keep) + select


def _j(key: str, alias: str = "") -> str:
    return f"json_extract_string({alias}tags_json, '$.{key}')"


_LAB = ", ".join(f"coalesce({_j(k, 'c.')}, '') AS tag_{k}" for k in ("controller", "action", "job"))

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, run: Callable, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# ---- reports (2.K, 2.I, 2.J) ----
_add("slice_totals_by_controller", _report("by_controller"), _sql(f"SELECT {_j('controller')} AS controller, CAST(sum(calls) AS BIGINT) AS calls, round(sum(ms), 4) AS ms FROM tot WHERE toplevel GROUP BY 1"))
_add("calls_by_bucket", _report("by_bucket"), _sql(f"SELECT bucket_start, {_j('controller')} AS controller, CAST(sum(calls) AS BIGINT) AS calls, round(sum(ms), 2) AS ms FROM live WHERE toplevel GROUP BY 1, 2"))
_add(
    "top_contexts_with_text", _report("top_contexts"),
    _sql(f"SELECT {_j('controller', 'c.')} AS controller, {_j('action', 'c.')} AS action, CAST(sum(c.calls) AS BIGINT) AS calls, round(sum(c.ms), 4) AS ms, left(s.query, 80) AS query FROM tot c LEFT JOIN st s USING (userid, dbid, queryid, toplevel) WHERE c.toplevel GROUP BY 1, 2, s.query ORDER BY ms DESC, query, controller, action LIMIT 20"),
)
_add("apportion", _report("apportion"), _sql("SELECT c.userid, c.dbid, c.queryid, c.tags_json, s.query, round(s.blks * c.ms / nullif(s.total, 0), 4) AS est_shared_blks_read FROM tot c JOIN st s USING (userid, dbid, queryid, toplevel) WHERE c.toplevel"))
_add(
    "active_sessions", _report("active_sessions"),
    _sql(f"SELECT a.pid, 'user' || a.pid AS usename, 'idle' AS state, {_j('controller', 'a.')} AS controller, a.queryid FROM (SELECT pid, arg_max(queryid, seq) AS queryid, arg_max(tags_json, seq) AS tags_json FROM tg WHERE toplevel GROUP BY pid) a WHERE pid < 10"),
)
_add("distinct_values_per_key", _report("distinct_values"), _sql("SELECT k AS tag, count(DISTINCT json_extract_string(tags_json, '$.' || k)) AS distinct_values FROM (SELECT tags_json, unnest(json_keys(tags_json)) AS k FROM tot) GROUP BY 1"))
_add("tag_sets_per_query", _report("tag_sets"), _sql("SELECT queryid, count(DISTINCT tags_json) AS tag_sets, CAST(sum(calls) AS BIGINT) AS calls FROM tot GROUP BY 1 ORDER BY tag_sets DESC, queryid LIMIT 20"))
_add("rate_last_bucket", _report("rate_last_bucket"), _sql(f"SELECT {_j('controller')} AS controller, round(sum(calls) / 86400.0, 6) AS calls_per_second FROM lastb WHERE toplevel GROUP BY 1"))
_add(
    "metric_tag", _report("metric_tag"),
    _sql(f"SELECT coalesce(d.datname, CAST(c.dbid AS VARCHAR)) AS datname, CAST(c.toplevel AS VARCHAR) AS toplevel, {_LAB}, round(sum(c.calls) / 86400.0, 6) AS calls_per_second, round(sum(c.ms) / 1000 / 86400.0, 6) AS exec_seconds_per_second FROM (SELECT dbid, toplevel, tags_json, calls, ms FROM lastb UNION ALL SELECT dbid, toplevel, tags_json, 0, 0 FROM tot) c LEFT JOIN db d ON d.oid = c.dbid GROUP BY 1, 2, 3, 4, 5"),
)
_add(
    "metric_query_top5", _report("metric_query"),
    _sql(f", q AS (SELECT coalesce(d.datname, CAST(c.dbid AS VARCHAR)) AS datname, CAST(c.toplevel AS VARCHAR) AS toplevel, CAST(c.queryid AS VARCHAR) AS queryid, {_LAB}, round(sum(c.calls) / 86400.0, 6) AS calls_per_second, round(sum(c.ms) / 1000 / 86400.0, 6) AS exec_seconds_per_second FROM lastb c LEFT JOIN db d ON d.oid = c.dbid GROUP BY 1, 2, 3, 4, 5, 6) "
         "SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY datname, toplevel, tag_controller, tag_action, tag_job ORDER BY exec_seconds_per_second DESC, queryid) <= 5 ORDER BY exec_seconds_per_second DESC, queryid, datname, toplevel, tag_controller, tag_action, tag_job LIMIT 500"),
)
_add(
    "metric_info", _report("metric_info"),
    _sql("SELECT CAST((SELECT count(*) FROM ent) AS DOUBLE) AS entries, 10000.0::DOUBLE AS max_entries, CAST((SELECT count(*) FROM tot) AS DOUBLE) AS live_entries, 12.0::DOUBLE AS buckets, 86400.0::DOUBLE AS bucket_interval_seconds, "
         "CAST((c - 1) * 86400 + 946684800 AS DOUBLE) AS last_closed_bucket_timestamp_seconds, (SELECT epoch_us(max(end_ts)) FROM ex) / 1000000.0 - (SELECT epoch_us(min(bucket_start)) FROM tot) / 1000000.0 AS oldest_bucket_age_seconds, 9261312.0::DOUBLE AS shmem_bytes, 0.0::DOUBLE AS dropped_tags_total, 0.0::DOUBLE AS invalid_tags_total, 0.0::DOUBLE AS capped_tags_total FROM cur"),
)
_add("entry_counters", _report("entry_counters"), _sql("SELECT userid, dbid, queryid, toplevel, tags_json, calls_total, round(exec_time_total, 4) AS exec_time_total, epoch_us(stats_since) AS stats_since_us FROM tot JOIN ent USING (userid, dbid, queryid, toplevel, tags_json)"))
_add("capped_labels", _report("capped_labels"), _sql(f"SELECT coalesce({_j('controller')}, '') AS tag_controller, CAST(sum(calls) AS BIGINT) AS calls FROM tot GROUP BY 1"))
_add("row_counts", _report("row_counts", untagged="record"), _sql("SELECT count(*) AS rows, count(*) FILTER (tags_json <> '{}') AS rows_with_tags, count(DISTINCT userid) AS roles FROM live", keep="true"))
_add("quick_start", _report("quick_start"), _sql(f"SELECT {_j('controller')} AS controller, {_j('action')} AS action, CAST(sum(calls) AS BIGINT) AS calls, round(sum(ms), 4) AS ms FROM tot GROUP BY 1, 2"))
_add("integrated_calls", _report("integrated_calls"), _sql(f"SELECT {_j('controller')} AS controller, round(CAST(sum(calls) AS DOUBLE), 4) AS calls FROM live WHERE toplevel GROUP BY 1"))
_add("semi_join_heavy_readers", _report("semi_join"), _sql("SELECT userid, dbid, queryid, toplevel, tags_json, calls FROM tot WHERE queryid IN (SELECT queryid FROM st WHERE blks > 100)"))
_add(
    "parity_with_statements", _report("parity"),
    _sql("SELECT coalesce(c.userid, s.userid) AS userid, coalesce(c.dbid, s.dbid) AS dbid, coalesce(c.queryid, s.queryid) AS queryid, CAST(coalesce(c.calls, 0) - coalesce(s.calls, 0) AS BIGINT) AS calls_diff FROM (SELECT userid, dbid, queryid, toplevel, sum(calls) AS calls FROM tot GROUP BY ALL) c FULL JOIN st s ON c.userid = s.userid AND c.dbid = s.dbid AND c.queryid = s.queryid AND c.toplevel = s.toplevel"),
)
_add("eviction_status", _report("eviction_status"), _sql("SELECT count(*) AS entries, CAST(10000 AS BIGINT) AS max_entries, round(count(*) * 100.0 / 10000, 4) AS percent_full, CAST(0 AS BIGINT) AS evicted_entries, CAST(0 AS BIGINT) AS reclaimed_entries FROM ent"))

# ---- views (2.G, 2.D predicates) ----
_ROWS = "{t}.bucket_start, {t}.userid, {t}.dbid, {t}.queryid, {t}.toplevel, {t}.tags_json, {t}.calls, round({t}.ms, 4) AS total_exec_time, calls_total, round(exec_time_total, 4) AS exec_time_total"


def _view(kind: str, shown: dict | None = None, **changes) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(_store(spark, sf_dir, **changes), kind)(**(shown or {}))
        return _ntz(df.select("bucket_start", "userid", "dbid", "queryid", "toplevel", "tags_json", "calls", F.round("total_exec_time", 4).alias("total_exec_time"), "calls_total", F.round("exec_time_total", 4).alias("exec_time_total")), "bucket_start")

    return run


def _view_sql(table: str, columns: str = _ROWS, **more) -> str:
    return _sql(f"SELECT {columns.format(t=table)} FROM {table} JOIN ent USING (userid, dbid, queryid, toplevel, tags_json)", **more)


_add("context_per_bucket", _view("stats"), _view_sql("live"))
_add("context_totals", _view("totals"), _view_sql("tot"))
_add("last_bucket", _view("last_bucket"), _view_sql("lastb"))
_add("untagged_record", _view("totals", untagged="record"), _view_sql("tot", keep="true"))
_add("nested_none", _view("totals", nested_tags="none"), _view_sql("tot", tags="CASE WHEN o.toplevel THEN o.own_tags ELSE '{}' END"))
_add("nested_scan", _view("totals", nested_tags="scan"), _view_sql("tot", tags="o.own_tags"))
_add("nested_inherit", _view("totals", nested_tags="inherit"), _view_sql("tot"))
_add("track_top", _view("totals", track="top"), _view_sql("tot", keep="tags_json <> '{}' AND toplevel"))
_add("visibility_masked", _view("totals", dict(caller=2, see_all=False)), _view_sql("tot", _ROWS.replace("{t}.queryid", "CASE WHEN {t}.userid = 2 THEN {t}.queryid END AS queryid").replace("{t}.tags_json", "CASE WHEN {t}.userid = 2 THEN {t}.tags_json END AS tags_json")))
_add("showtags_false", _view("totals", dict(showtags=False)), _view_sql("tot", _ROWS.replace("{t}.tags_json", "CAST(NULL AS VARCHAR) AS tags_json")))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(_store(spark, sf_dir).info().select("entries", "max_entries", "buckets", "bucket_seconds", "current_bucket_start", "last_closed_bucket_start", "oldest_bucket", "stats_reset_epoch", "shmem_bytes"), "current_bucket_start", "last_closed_bucket_start", "oldest_bucket")


_add(
    "store_info", counters,
    _sql("SELECT (SELECT count(*) FROM ent) AS entries, CAST(10000 AS BIGINT) AS max_entries, CAST(12 AS BIGINT) AS buckets, CAST(86400 AS BIGINT) AS bucket_seconds, make_timestamp(c * 86400000000 + 946684800000000) AS current_bucket_start, "
         "make_timestamp((c - 1) * 86400000000 + 946684800000000) AS last_closed_bucket_start, (SELECT min(bucket_start) FROM live) AS oldest_bucket, CAST(floor((SELECT min(epoch_us(stats_since)) FROM ent) / 1000000.0) AS BIGINT) AS stats_reset_epoch, CAST(9261312 AS INTEGER) AS shmem_bytes FROM cur"),
)


# ---- store (2.E, 2.N) ----
def clamped_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows: every seventh execution ends three days before its turn."""
    df = _events(spark, sf_dir).withColumn("end_ts", F.when(F.col("seq") % 7 == 0, F.col("end_ts") - F.expr("interval 3 days")).otherwise(F.col("end_ts")))
    return store.clamped(df, 86_400).groupBy("bucket_id").agg(F.count("*").alias("calls"))


_add(
    "clamped_buckets", clamped_buckets,
    "SELECT b AS bucket_id, count(*) AS calls FROM (SELECT max(CAST(floor((epoch_us(CASE WHEN event_id % 7 = 0 THEN ts - INTERVAL 3 DAY ELSE ts END) - 946684800000000) / 86400000000.0) AS BIGINT)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS b FROM events) GROUP BY 1",
)


def _evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return store.evict_candidates(s.found, s.current, 12, 100).select(*store.KEY, "last_bucket", "calls_total")


_add(
    "evict_candidates", _evict,
    _sql("SELECT dbid, userid, queryid, toplevel, tags_json, last_bucket, calls_total FROM ent, cur WHERE last_bucket < c - 11 UNION ALL SELECT * FROM (SELECT dbid, userid, queryid, toplevel, tags_json, last_bucket, calls_total FROM ent, cur WHERE last_bucket >= c - 11 ORDER BY last_bucket, calls_total, dbid, userid, queryid, toplevel, tags_json LIMIT (SELECT greatest(0, 5 - count(*)) FROM ent, cur WHERE last_bucket < c - 11))"),
)


def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of 100 entries: how many stay, what stays, and what the counters say."""
    s = _store(spark, sf_dir, max_entries=100)
    out = s.counters().select("entries", "max_entries", "dealloc", "reclaimed_entries", "evicted_entries", "dropped_records")
    return out.withColumn("kept_calls", F.lit(s.found.agg(F.sum("calls_total")).first()[0]))


_add("bounded_store", _bounded)


def _exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, exemplar_keys="traceparent", nested_tags="scan")
    return s.totals().select("userid", "dbid", "queryid", "toplevel", "tags_json", "exemplars_json").where("exemplars_json is not null")


_add(
    "exemplars_latest", _exemplars,
    _sql("""SELECT t.userid, t.dbid, t.queryid, t.toplevel, t.tags_json, x.j AS exemplars_json FROM tot t JOIN (SELECT userid, dbid, queryid, toplevel, tags_json, '{"traceparent":"00-' || max(seq) || '-01"}' AS j FROM rec WHERE m = 3 GROUP BY ALL) x USING (userid, dbid, queryid, toplevel, tags_json)""", tags="o.own_tags"),
)


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    # planted: buckets of the future, empty slots, and slots that occur twice
    q = F.col("queryid")
    bad = s.slots.withColumn("bucket_id", F.when(q == 1, F.lit(s.current + 5)).otherwise(F.col("bucket_id"))).withColumn("calls", F.when(q == 2, 0).otherwise(F.col("calls")))
    return store.ring_violations(bad.unionByName(s.slots.where(q == 3)), s.found, s.current, 12)


_ROW = "dbid, userid, queryid, toplevel, tags_json"
_add(
    "ring_violations", _violations,
    _sql(f"SELECT {_ROW}, c + 5 AS bucket_id, 'bucket after the watermark' AS reason FROM slots, cur WHERE queryid = 1 UNION ALL SELECT {_ROW}, b, 'empty or negative slot' FROM slots WHERE queryid = 2 UNION ALL SELECT {_ROW}, b, 'two live buckets in a slot' FROM live WHERE queryid = 3"),
)


# ---- caps (2.H) ----
def _capped(scope: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _store(spark, sf_dir, cardinality_cap=2, cardinality_cap_scope=scope, nested_tags="scan")
        return reports.report(spark, "capped_rows", s)

    return run


def _capped_sql(scope: str, tags: str = "o.own_tags", cap: int | str = 2) -> str:
    base = "WITH " + _EX.replace("%TAGS%", tags)
    return (
        base
        + f""", ks AS (SELECT seq, {scope} AS sc, k2, json_extract_string(tags_json, '$.' || k2) AS v FROM (SELECT *, unnest(json_keys(tags_json)) AS k2 FROM tg)),
adm AS (SELECT sc, k2, v FROM (SELECT sc, k2, v, min(seq) AS f FROM ks GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY sc, k2 ORDER BY f, v) <= {cap}),
new AS (SELECT seq, '{{' || string_agg('"' || k2 || '":' || CASE WHEN a.v IS NULL THEN 'null' ELSE '"' || ks.v || '"' END, ',' ORDER BY k2) || '}}' AS nt FROM ks LEFT JOIN adm a USING (sc, k2, v) GROUP BY seq)"""
        + _SLOTS.replace("FROM tg WHERE %KEEP%", "FROM (SELECT * REPLACE (coalesce(nt, tags_json) AS tags_json) FROM tg LEFT JOIN new USING (seq)) WHERE tags_json <> '{}'")
        + "SELECT userid, dbid, queryid, toplevel, tags_json, calls FROM tot WHERE contains(tags_json, ':null')"
    )


_add("capped_rows", _capped("role"), _capped_sql("userid || '/' || dbid"))
_add("cap_scope_database", _capped("database"), _capped_sql("CAST(dbid AS VARCHAR)"))
_add("cap_scope_server", _capped("server"), _capped_sql("'server'"))


def _cap_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tag and one value a key: tags that find no room aren't admitted."""
    return reports.report(spark, "capped_rows", _store(spark, sf_dir, cardinality_cap=1, max_tags=1, nested_tags="scan"))


_ONE_TAG = "CASE WHEN o.m IN (1, 2) THEN '{\"action\":\"show\"}' ELSE o.own_tags END"
_add("cap_with_size_limits", _cap_limits, _capped_sql("userid || '/' || dbid", _ONE_TAG, 1))


def _cap_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: one controller, any action, two jobs."""
    return reports.report(spark, "capped_rows", _store(spark, sf_dir, cardinality_cap=2, cardinality_cap_overrides="controller:1, action:0", nested_tags="scan"))


_add("cap_overrides", _cap_overrides, _capped_sql("userid || '/' || dbid", "o.own_tags", "CASE k2 WHEN 'controller' THEN 1 WHEN 'action' THEN 1000000 ELSE 2 END"))


def _cap_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More values than slots: what is lost to the full table."""
    s = _store(spark, sf_dir, tags="traceparent, controller", exclude_tags="", cardinality_cap=1_000_000, cardinality_cap_slots=256, cardinality_cap_scope="server", max_tags=2, nested_tags="scan")
    return s.counters().select("capped_tags", "cap_table_full", "dropped_tags")


_add(
    "cap_table_full", _cap_counters,
    "WITH " + _EX.replace("%TAGS%", "o.own_tags") + """, ks AS (SELECT seq, 'controller' AS key, 2 AS p, e AS v FROM tg WHERE m IN (1, 2, 3) UNION ALL SELECT seq, 'traceparent', 1, '00-' || seq || '-01' FROM tg WHERE m = 3),
adm AS (SELECT key, v FROM (SELECT key, p, v, min(seq) AS f FROM ks GROUP BY ALL) ORDER BY f, p LIMIT 256)
SELECT count(*) FILTER (a.v IS NULL) AS capped_tags, count(*) FILTER (a.v IS NULL) AS cap_table_full, CAST(0 AS BIGINT) AS dropped_tags FROM ks LEFT JOIN adm a USING (key, v)""",
)


# ---- extraction (2.B, 2.C, 2.D) ----
def _tags(appname: str | None = None, override: str | None = None, **changes) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = extract.with_appname_and_override(_events(spark, sf_dir), appname, override)
        return extract.with_tags(df, Settings(**(BASE | changes))).select("seq", "tags_json", "footer", "invalid_tags")

    return run


def _tags_sql(case: str) -> str:
    return "WITH " + _EX.replace("%TAGS%", "o.own_tags") + f" SELECT seq, {case} AS tags_json, false AS footer, CAST(0 AS BIGINT) AS invalid_tags FROM tg"


def _object(*pairs: str) -> str:
    return f"CAST(json_object({', '.join(pairs)}) AS VARCHAR)"


_add("extract_tags", _tags(), _tags_sql("own_tags"))
_add(
    "extract_route_decoded", _tags(tags="controller, route"),
    _tags_sql(f"CASE WHEN m IN (1, 2) THEN {_object(chr(39) + 'controller' + chr(39), 'e')} WHEN m = 3 THEN {_object(chr(39) + 'controller' + chr(39), 'e', chr(39) + 'route' + chr(39), chr(39) + '/users/' + chr(39) + ' || k')} ELSE '{{}}' END"),
)
_add(
    "normalize_route", _tags(tags="route", normalize=r"route: '/\d+' => '/:id'"),
    _tags_sql(r"CASE WHEN m = 3 THEN CAST(json_object('route', regexp_replace('/users/' || k, '/[0-9]+', '/:id', 'g')) AS VARCHAR) ELSE '{}' END"),
)
_add("truncate_bytes", _tags(tags="route", max_tag_value_len=4), _tags_sql("CASE WHEN m = 3 THEN '{\"route\":\"/use\"}' ELSE '{}' END"))
_add("position_any", _tags(extractors="sqlcommenter(position=any), marginalia(position=any)"), _tags_sql("CASE WHEN m = 5 THEN CAST(json_object('controller', e) AS VARCHAR) ELSE own_tags END"))
_add("position_prepend", _tags(extractors="marginalia(position=prepend)"), _tags_sql("CASE WHEN m = 5 THEN CAST(json_object('controller', e) AS VARCHAR) ELSE '{}' END"))
_add("rename_keys", _tags(extractors="sqlcommenter(rename=controller:endpoint), marginalia(rename=controller:endpoint)", tags="endpoint"), _tags_sql("CASE WHEN m IN (1, 2, 3) THEN CAST(json_object('endpoint', e) AS VARCHAR) ELSE '{}' END"))
_add("regex_extract", _tags(extractors=r"regex(pattern='controller[:=]''?(\w+)', keys=controller)"), _tags_sql("CASE WHEN m IN (1, 2, 3, 5) THEN CAST(json_object('controller', e) AS VARCHAR) ELSE '{}' END"))
_add("star_with_denylist", _tags(tags="*"), _tags_sql("CASE m WHEN 2 THEN CAST(json_object('action', 'show', 'controller', e, 'line', 'a.rb:12') AS VARCHAR) WHEN 3 THEN CAST(json_object('controller', e, 'route', '/users/' || k) AS VARCHAR) ELSE own_tags END"))
_add("appname_tags", _tags(appname="controller:app,job:nightly", extractors="sqlcommenter, marginalia, appname(format=marginalia)"), _tags_sql("CASE WHEN m IN (1, 2) THEN CAST(json_object('action', 'show', 'controller', e, 'job', 'nightly') AS VARCHAR) WHEN m = 3 THEN CAST(json_object('controller', e, 'job', 'nightly') AS VARCHAR) WHEN m = 4 THEN CAST(json_object('controller', 'app', 'job', e) AS VARCHAR) ELSE '{\"controller\":\"app\",\"job\":\"nightly\"}' END"))
_add("override_tags", _tags(override="controller='forced'"), _tags_sql("CASE WHEN m IN (1, 2) THEN '{\"action\":\"show\",\"controller\":\"forced\"}' WHEN m = 4 THEN CAST(json_object('controller', 'forced', 'job', e) AS VARCHAR) ELSE '{\"controller\":\"forced\"}' END"))


_add(
    "normalize_longest", _tags(tags="route", normalize=r"route: '/(u|users|us)' => '/x'"),
    _tags_sql("CASE WHEN m = 3 THEN CAST(json_object('route', '/x/' || k) AS VARCHAR) ELSE '{}' END"),
)


def _constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements whose literals, names and comments hide a false comment (B2-B9,
    B12), that never end (B5), or whose value is no text or too long (C4, D-2, D-7)."""
    df = _events(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), "event_type")
    fake, own = "/*controller:fake*/", F.concat(F.lit(" /*controller:"), F.col("event_type"), F.lit("*/"))
    hidden = [
        f"SELECT 'it''s {fake}'", f"SELECT E'\\'{fake}'", f'SELECT 1 AS "a""{fake}"', f"SELECT $q$ {fake} $q$", f"SELECT 1 -- {fake}\n+ 1",
        f"SELECT /* a {fake} b */ 1 + 1", f"SELECT E'a'\n'\\'{fake}'", f"SELECT U&'{fake}'", f"SELECT $1, $$ ' {fake} $$",
    ]
    shape, text = F.col("seq") % 13, F.lit(None).cast("string")
    for i, t in enumerate(hidden):
        text = F.when(shape == i, F.concat(F.lit(t), own)).otherwise(text)
    text = F.when(shape == 9, F.concat(F.lit("SELECT 'open"), own)).when(shape == 10, F.concat(F.lit("SELECT 1 /*controller:"), F.col("event_type"))).otherwise(text)
    text = F.when(shape == 11, F.lit("SELECT 1 /*controller='%FF'*/")).when(shape == 12, F.lit(f"SELECT 1 /*controller:{'x' * 100}*/")).otherwise(text)
    return extract.with_tags(df.join(e, "seq").withColumn("query_string", text), Settings(**BASE)).select("seq", "tags_json", "invalid_tags")


_add(
    "lexer_constructs", _constructs,
    "SELECT event_id AS seq, CASE WHEN event_id % 13 < 9 THEN CAST(json_object('controller', event_type) AS VARCHAR) WHEN event_id % 13 = 12 THEN CAST(json_object('controller', repeat('x', 64)) AS VARCHAR) ELSE '{}' END AS tags_json, "
    "CAST(CASE WHEN event_id % 13 = 11 THEN 1 ELSE 0 END AS BIGINT) AS invalid_tags FROM events",
)


def _recorded_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is recorded of utilities, failures, unknown statements and parallel workers (A3, P2, P4), before and from 17."""
    seq = F.col("seq")
    df = _events(spark, sf_dir).withColumns({
        "command_tag": F.element_at(F.array(*map(F.lit, _KINDS)), (seq % 5 + 1).cast("int")), "is_utility": seq % 5 != 0, "status": F.when(seq % 7 == 0, "error").otherwise("ok"),
        "queryid": F.when(seq % 11 == 0, 0).otherwise(F.col("queryid")), "is_parallel_worker": seq % 13 == 0, "tags_json": F.lit("{}"),
    })
    s = Settings(**BASE, untagged="record", track_utility=True)
    counts = [F.sum(executions.recorded(s.but(server_major=v)).cast("long")).alias(f"recorded_{v}") for v in (16, 18)]
    return df.groupBy("command_tag").agg(*counts, F.sum(executions.utility_missing_queryid(s)).alias("missing_queryid"))


_KINDS = ("SELECT", "EXECUTE", "PREPARE", "DEALLOCATE", "CREATE TABLE")
_GOOD = "event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0"
_add(
    "recorded_kinds", _recorded_kinds,
    f"SELECT {list(_KINDS)!r}[event_id % 5 + 1] AS command_tag, count(*) FILTER ({_GOOD} AND event_id % 5 IN (0, 4)) AS recorded_16, count(*) FILTER ({_GOOD} AND event_id % 5 IN (0, 3, 4)) AS recorded_18, "
    "count(*) FILTER (event_id % 11 = 0 AND event_id % 5 IN (3, 4)) AS missing_queryid FROM events GROUP BY 1",
)


def _merge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _events(spark, sf_dir).withColumn("query_string", F.concat("query_string", F.lit(" /*job:nightly*/")))
    return extract.with_tags(df, Settings(**BASE, extractors="sqlcommenter, marginalia(merge=on)")).select("seq", "tags_json")


_add("chain_merge", _merge_chain, "WITH " + _EX.replace("%TAGS%", "o.own_tags") + " SELECT seq, CASE WHEN m IN (1, 2) THEN CAST(json_object('action', 'show', 'controller', e, 'job', 'nightly') AS VARCHAR) WHEN m = 3 THEN CAST(json_object('controller', e, 'job', 'nightly') AS VARCHAR) ELSE '{\"job\":\"nightly\"}' END AS tags_json FROM tg")


def _footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _events(spark, sf_dir).withColumn("query_string", F.concat(F.lit("SELECT 1; SELECT 2; /*controller:"), F.col("seq").cast("string"), F.lit("*/")))
    df = df.withColumn("stmt_location", F.lit(9)).withColumn("stmt_len", F.lit(9))
    return extract.with_tags(df, Settings(**BASE)).select("seq", "tags_json", "footer")


_add("footer_fallback", _footer, "SELECT event_id AS seq, '{\"controller\":\"' || event_id || '\"}' AS tags_json, true AS footer FROM events")


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.with_tags_distinct(_events(spark, sf_dir), Settings(**BASE)).select("seq", "tags_json")


_add("extract_by_distinct_text", _distinct, "WITH " + _EX.replace("%TAGS%", "o.own_tags") + " SELECT seq, own_tags AS tags_json FROM tg")


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of four statements, each run by the next."""
    df = _events(spark, sf_dir).withColumn("parent_seq", F.when(F.col("seq") % 4 != 3, F.col("seq") + 1))
    top = df.agg(F.max("seq")).first()[0]
    df = df.withColumn("parent_seq", F.when(F.col("parent_seq") <= top, F.col("parent_seq")))
    return nesting.resolve_roots(df).select("seq", "root_seq")


_add("resolve_roots", _roots, "SELECT event_id AS seq, least(event_id + 3 - event_id % 4, (SELECT max(event_id) FROM events)) AS root_seq FROM events")


# ---- offline statistics (2.L) ----
def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.col("event_type").alias("scenario"), F.unix_micros(F.col("ts").cast("timestamp")).alias("end_us"), F.round(F.col("value") * 1000).cast("long").alias("latency_us"))


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = benchstats.latency_summary(_log(spark, sf_dir), "scenario")
    return df.withColumn("avg_ms", F.round("avg_ms", 6))


_LOG = "lg AS (SELECT event_id, event_type AS scenario, epoch_us(ts) AS end_us, CAST(round(value * 1000) AS BIGINT) AS latency_us FROM events)"
_add("latency_percentiles", _latency, f"WITH {_LOG} SELECT scenario, count(*) AS n, quantile_disc(latency_us, 0.5) / 1000 AS p50_ms, quantile_disc(latency_us, 0.95) / 1000 AS p95_ms, quantile_disc(latency_us, 0.99) / 1000 AS p99_ms, round(avg(latency_us) / 1000, 6) AS avg_ms, max(latency_us) / 1000 AS max_ms FROM lg GROUP BY 1")
_add("median_and_spread", lambda spark, d: benchstats.spread(_log(spark, d), "latency_us", "scenario").withColumn("spread_pct", F.round("spread_pct", 6)), f"WITH {_LOG} SELECT scenario, median(latency_us) AS median, round((max(latency_us) - min(latency_us)) / median(latency_us) * 100, 6) AS spread_pct FROM lg GROUP BY 1")
_add(
    "boundary_split", lambda spark, d: benchstats.boundary_split(_log(spark, d), 3_600_000_000, 60_000_000).withColumn("avg_us", F.round("avg_us", 4)),
    f"WITH {_LOG}, b AS (SELECT *, CAST(ceil((end_us - latency_us - 60000000 - 946684800000000) / 3600000000.0) AS BIGINT) * 3600000000 + 946684800000000 AS first FROM lg) "
    "SELECT first <= end_us + 60000000 AS near, count(*) AS n, round(avg(latency_us), 4) AS avg_us, max(latency_us) AS max_us, "
    "(SELECT (max(end_us) - 946684800000000) // 3600000000 - min(end_us - latency_us - 946684800000000) // 3600000000 FROM lg) AS boundaries FROM b GROUP BY 1",
)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _log(spark, sf_dir).withColumn("block", (F.col("event_id") % 10).cast("int")).withColumn("config", F.when(F.floor(F.col("event_id") / 10) % 2 == 0, "ext").otherwise("base"))
    runs = e.groupBy("scenario", "block", "config").agg(F.avg("latency_us").alias("us"))
    return runs.withColumn("baseline", F.when(F.col("config") == "ext", "base"))


def _ci(log: bool) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return benchstats.intervals(benchstats.paired(_runs(spark, sf_dir), "us"), log=log).select("scenario", "config", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))

    return run


_PAIR = f"""WITH {_LOG}, r AS (SELECT scenario, event_id % 10 AS block, CASE WHEN event_id // 10 % 2 = 0 THEN 'ext' ELSE 'base' END AS config, avg(latency_us) AS us FROM lg GROUP BY ALL),
p AS (SELECT a.scenario, %X% AS x FROM r a JOIN r b ON a.scenario = b.scenario AND a.block = b.block WHERE a.config = 'ext' AND b.config = 'base'),
t AS (SELECT * FROM (VALUES {", ".join(f"({n}, {benchstats.t_quantile(0.95, n - 1)!r}::DOUBLE)" for n in range(2, 11))}) AS t(n, q)),
s AS (SELECT scenario, avg(x) AS mean, stddev_samp(x) AS sd, count(*) AS n FROM p GROUP BY 1)
SELECT scenario, 'ext' AS config, s.n, %F%"""
_add("paired_interval", _ci(False), _PAIR.replace("%X%", "a.us - b.us").replace("%F%", "round(mean, 6) AS mean, round(mean - q * sd / sqrt(s.n), 6) AS low, round(mean + q * sd / sqrt(s.n), 6) AS high FROM s LEFT JOIN t USING (n)"))
_add("paired_ratio", _ci(True), _PAIR.replace("%X%", "ln(a.us / b.us)").replace("%F%", "round(exp(mean), 6) AS mean, round(exp(mean - q * sd / sqrt(s.n)), 6) AS low, round(exp(mean + q * sd / sqrt(s.n)), 6) AS high FROM s LEFT JOIN t USING (n)"))
_add("absolute_medians", lambda spark, d: benchstats.absolute(_runs(spark, d), "us").withColumn("us", F.round("us", 6)), f"WITH {_LOG}, r AS (SELECT scenario, event_id % 10 AS block, CASE WHEN event_id // 10 % 2 = 0 THEN 'ext' ELSE 'base' END AS config, avg(latency_us) AS us FROM lg GROUP BY ALL) SELECT scenario, config, round(median(us), 6) AS us FROM r GROUP BY 1, 2")


def _exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = QUERIES["rate_last_bucket"](spark, sf_dir).withColumn("calls_per_second", F.col("calls_per_second").cast("decimal(20,6)")).where("controller is not null")
    return reports.exposition(df, "tags", ["controller"])


_add("exposition_lines", _exposition, _sql(f"SELECT 'tags_calls_per_second{{controller=\"' || {_j('controller')} || '\"}} ' || CAST(CAST(round(sum(calls) / 86400.0, 6) AS DECIMAL(20, 6)) AS VARCHAR) AS line FROM lastb WHERE toplevel AND {_j('controller')} IS NOT NULL GROUP BY {_j('controller')}"))
