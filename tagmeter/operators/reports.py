"""Report queries over the views (K1-K18), joins (I1-I10) and exporter metrics
(A10, A11).  Each takes views as DataFrames and is plain SQL, so Catalyst
plans it; small dimensions are broadcast by their measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TAG = "get_json_object({0}, '$.{1}')"


def _tag(key: str, column: str = "tags_json") -> str:
    return f"from_json({column}, 'map<string,string>')['{key}']"


_LABELS = ", ".join(f"coalesce({_tag(k, 'c.tags_json')}, '') AS tag_{k}" for k in ("controller", "action", "job"))
_NAMES = "tag_controller, tag_action, tag_job"

REPORTS: dict[str, str] = {
    # K1
    "by_bucket": f"SELECT bucket_start, {_tag('controller')} AS controller, sum(calls) AS calls, round(sum(total_exec_time), 2) AS ms FROM {{context}} WHERE toplevel GROUP BY 1, 2",
    # K2, I1, J2
    "top_contexts": f"SELECT {_tag('controller', 'c.tags_json')} AS controller, {_tag('action', 'c.tags_json')} AS action, sum(c.calls) AS calls, round(sum(c.total_exec_time), 4) AS ms, left(s.query, 80) AS query "
    "FROM {totals} c LEFT JOIN {statements} s USING (userid, dbid, queryid, toplevel) WHERE c.toplevel GROUP BY 1, 2, s.query ORDER BY ms DESC, query, controller, action LIMIT 20",
    # K3, I2
    "apportion": "SELECT c.userid, c.dbid, c.queryid, c.tags_json, s.query, round(s.shared_blks_read * c.total_exec_time / nullif(s.total_exec_time, 0), 4) AS est_shared_blks_read "
    "FROM {totals} c JOIN {statements} s USING (userid, dbid, queryid, toplevel) WHERE c.toplevel",
    # K4, F7
    "by_controller": f"SELECT {_tag('controller')} AS controller, sum(calls) AS calls, round(sum(total_exec_time), 4) AS ms FROM {{totals}} WHERE toplevel GROUP BY 1",
    # K5, I3
    "active_sessions": f"SELECT a.pid, s.usename, a.state, {_tag('controller', 'a.tags_json')} AS controller, a.queryid FROM {{activity}} a JOIN {{sessions}} s USING (pid)",
    # K6, I6
    "distinct_values": "SELECT t.key AS tag, count(DISTINCT t.value) AS distinct_values FROM {totals} LATERAL VIEW explode(from_json(tags_json, 'map<string,string>')) t AS key, value GROUP BY 1",
    # K7
    "tag_sets": "SELECT queryid, count(DISTINCT tags_json) AS tag_sets, sum(calls) AS calls FROM {totals} GROUP BY 1 ORDER BY tag_sets DESC, queryid LIMIT 20",
    # K8, P8
    "capped_rows": "SELECT userid, dbid, queryid, toplevel, tags_json, calls FROM {totals} WHERE exists(map_values(from_json(tags_json, 'map<string,string>')), v -> v IS NULL)",
    # K9
    "rate_last_bucket": f"SELECT {_tag('controller')} AS controller, round(sum(calls) / double({{seconds}}), 6) AS calls_per_second FROM {{last}} WHERE toplevel GROUP BY 1",
    # K10, J4, I4, I5
    "metric_tag": f"WITH c AS (SELECT dbid, toplevel, tags_json, calls, total_exec_time FROM {{last}} UNION ALL SELECT dbid, toplevel, tags_json, 0, 0 FROM {{totals}}) "
    f"SELECT coalesce(d.datname, cast(c.dbid AS string)) AS datname, cast(c.toplevel AS string) AS toplevel, {_LABELS}, "
    "round(sum(c.calls) / double({seconds}), 6) AS calls_per_second, round(sum(c.total_exec_time) / 1000 / double({seconds}), 6) AS exec_seconds_per_second "
    "FROM c LEFT JOIN {databases} d ON d.oid = c.dbid WHERE c.tags_json IS NOT NULL GROUP BY 1, 2, 3, 4, 5",
    # K11, J1
    "metric_query": f"WITH q AS (SELECT coalesce(d.datname, cast(c.dbid AS string)) AS datname, cast(c.toplevel AS string) AS toplevel, cast(c.queryid AS string) AS queryid, {_LABELS}, "
    "round(sum(c.calls) / double({seconds}), 6) AS calls_per_second, round(sum(c.total_exec_time) / 1000 / double({seconds}), 6) AS exec_seconds_per_second "
    "FROM {last} c LEFT JOIN {databases} d ON d.oid = c.dbid WHERE c.tags_json IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6) "
    f"SELECT datname, toplevel, queryid, {_NAMES}, calls_per_second, exec_seconds_per_second FROM (SELECT q.*, row_number() OVER (PARTITION BY datname, toplevel, {_NAMES} ORDER BY exec_seconds_per_second DESC, queryid) AS rank FROM q) r "
    f"WHERE rank <= 5 ORDER BY exec_seconds_per_second DESC, queryid, datname, toplevel, {_NAMES} LIMIT 500",
    # K12
    "metric_info": "SELECT cast(i.entries AS double) AS entries, cast(i.max_entries AS double) AS max_entries, cast(l.live_entries AS double) AS live_entries, cast(i.buckets AS double) AS buckets, "
    "cast(i.bucket_seconds AS double) AS bucket_interval_seconds, cast(unix_micros(i.last_closed_bucket_start) / 1000000 AS double) AS last_closed_bucket_timestamp_seconds, "
    "cast(({now_us} - unix_micros(l.oldest_bucket)) / 1000000 AS double) AS oldest_bucket_age_seconds, cast(i.shmem_bytes AS double) AS shmem_bytes, cast(i.dropped_tags AS double) AS dropped_tags_total, "
    "cast(i.invalid_tags AS double) AS invalid_tags_total, cast(i.capped_tags AS double) AS capped_tags_total "
    "FROM {counters} i CROSS JOIN (SELECT count(*) AS live_entries, min(bucket_start) AS oldest_bucket FROM {totals}) l",
    # K13
    "entry_counters": "SELECT userid, dbid, queryid, toplevel, tags_json, calls_total, round(exec_time_total, 4) AS exec_time_total, unix_micros(stats_since) AS stats_since_us FROM {totals}",
    # K14
    "capped_labels": f"SELECT CASE WHEN map_contains_key(from_json(tags_json, 'map<string,string>'), 'controller') THEN coalesce({_tag('controller')}, '(capped)') ELSE '' END AS tag_controller, sum(calls) AS calls FROM {{totals}} GROUP BY 1",
    # K15
    "eviction_status": "SELECT entries, max_entries, round(entries * 100.0D / max_entries, 4) AS percent_full, evicted_entries, reclaimed_entries FROM {counters}",
    # K16
    "row_counts": "SELECT count(*) AS rows, count_if(tags_json <> '{{}}') AS rows_with_tags, count(DISTINCT userid) AS roles FROM {context}",
    # K17
    "quick_start": f"SELECT {_tag('controller')} AS controller, {_tag('action')} AS action, sum(calls) AS calls, round(sum(total_exec_time), 4) AS ms FROM {{totals}} GROUP BY 1, 2",
    # A gauge of calls per second, summed over scrapes and multiplied by their interval
    "integrated_calls": f"SELECT {_tag('controller')} AS controller, round(sum(calls / double({{seconds}})) * double({{seconds}}), 4) AS calls FROM {{context}} WHERE toplevel GROUP BY 1",
    # I8
    "semi_join": "SELECT userid, dbid, queryid, toplevel, tags_json, calls FROM {totals} WHERE queryid IN (SELECT queryid FROM {statements} WHERE shared_blks_read > 100)",
    # I9
    "parity": "SELECT coalesce(c.userid, s.userid) AS userid, coalesce(c.dbid, s.dbid) AS dbid, coalesce(c.queryid, s.queryid) AS queryid, coalesce(c.calls, 0) - coalesce(s.calls, 0) AS calls_diff "
    "FROM (SELECT userid, dbid, queryid, toplevel, sum(calls) AS calls FROM {totals} GROUP BY ALL) c FULL OUTER JOIN {statements} s ON c.userid = s.userid AND c.dbid = s.dbid AND c.queryid = s.queryid AND c.toplevel = s.toplevel",
}


def report(spark: SparkSession, name: str, store=None, **more) -> DataFrame:
    """A report by name.  *more*: DataFrames (statements, databases, sessions)
    or values (now_us) that the report names."""
    args = dict(more)
    if store is not None:
        text = REPORTS[name]
        makers = {"context": store.stats, "totals": store.totals, "last": store.last_bucket, "activity": store.activity, "counters": store.counters, "info": store.info}
        args |= {k: make() for k, make in makers.items() if f"{{{k}}}" in text}
        args["seconds"] = float(store.settings.bucket_interval)
    return spark.sql(REPORTS[name], **args)


def exposition(df: DataFrame, metric: str, labels: list[str]) -> DataFrame:
    """One line of text for each value of a metric query (A10); with labels
    escaped as the exposition format wants."""
    from pyspark.sql import functions as F

    def escaped(c: str):
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")

    own = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels))
    values = [c for c in df.columns if c not in labels]
    lines = F.array(*(F.concat(F.lit(f"{metric}_{c}{{"), own, F.lit("} "), F.col(c).cast("string")) for c in values))
    return df.select(F.explode(lines).alias("line"))


def with_start_time(df: DataFrame, counters: DataFrame) -> DataFrame:
    """The metric rows with the counters' start in nanoseconds."""
    return df.crossJoin(counters.selectExpr("stats_reset_epoch * 1000000000 AS start_time_unix_nano"))
