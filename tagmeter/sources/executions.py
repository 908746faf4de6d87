"""The fact stream: one row for each completed statement (A1-A5), and the
predicates that decide what is recorded (P1-P4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of an execution and their types.
SCHEMA = (
    "seq long, end_ts timestamp, start_ts timestamp, dbid long, userid long, queryid long, nesting_level int, parent_seq long, root_seq long, "
    "is_utility boolean, is_parallel_worker boolean, during_planning boolean, command_tag string, query_string string, stmt_location int, stmt_len int, "
    "scs boolean, application_name string, tags_override string, elapsed_ms double, status string, pid int"
)


def from_events(events: DataFrame) -> DataFrame:
    """Executions derived from an ``events`` table by arithmetic alone, so
    that any engine can derive the same."""
    e, n = F.col("event_type"), (F.col("event_id") % 23 + 1).cast("string")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    shape = F.col("event_id") % 6
    text = (
        F.when(shape == 0, F.concat(F.lit("SELECT "), n))
        .when(shape == 1, F.concat(F.lit("SELECT "), n, F.lit(" /*controller='"), e, F.lit("',action='show'*/")))
        .when(shape == 2, F.concat(F.lit("SELECT "), n, F.lit(" /*controller:"), e, F.lit(",action:show,line:a.rb:12*/")))
        .when(shape == 3, F.concat(F.lit("SELECT "), n, F.lit(" /*controller='"), e, F.lit("',route='%2Fusers%2F"), k, F.lit("',traceparent='00-"), F.col("event_id").cast("string"), F.lit("-01'*/")))
        .when(shape == 4, F.concat(F.lit("SELECT ' /*controller:fake*/ ' /*job='"), e, F.lit("'*/;")))
        .otherwise(F.concat(F.lit("/*controller:"), e, F.lit("*/ SELECT "), n))
    )
    nested = F.col("event_id") % 4 == 0
    return events.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("end_ts"), F.col("ts").cast("timestamp").alias("start_ts"),
        (F.col("user_id") % 3).alias("dbid"), (F.col("user_id") % 5).alias("userid"), (F.col("event_id") % 23 + 1).alias("queryid"),
        F.when(nested, 1).otherwise(0).alias("nesting_level"), F.when(nested, F.col("event_id") + 1).alias("parent_seq"),
        F.when(nested, F.col("event_id") + 1).otherwise(F.col("event_id")).alias("root_seq"),
        F.lit(False).alias("is_utility"), F.lit(False).alias("is_parallel_worker"), F.lit(False).alias("during_planning"), F.lit("SELECT").alias("command_tag"),
        text.alias("query_string"), F.lit(-1).alias("stmt_location"), F.lit(0).alias("stmt_len"), F.lit(True).alias("scs"),
        F.lit(None).cast("string").alias("application_name"), F.lit(None).cast("string").alias("tags_override"),
        F.col("value").alias("elapsed_ms"), F.lit("ok").alias("status"), (F.col("user_id") % 17).cast("int").alias("pid"),
    )


def toplevel() -> Column:
    return F.col("nesting_level") == 0


def recorded(settings) -> Column:
    """P1 to P3 of one execution that has ``tags_json``: enabled, completed,
    known, tracked, and tagged unless untagged ones are recorded."""
    if not settings.enabled or settings.track == "none":
        return F.lit(False)
    out = (F.col("status") == "ok") & ~F.col("is_parallel_worker") & (F.col("queryid") != 0)
    if settings.track == "top":
        out &= toplevel()
    if settings.track_utility:
        never = ["EXECUTE", "PREPARE"] + (["DEALLOCATE"] if settings.server_major < 17 else [])
        out &= ~F.col("is_utility") | ~F.col("command_tag").isin(never)
    else:
        out &= ~F.col("is_utility")
    if settings.untagged == "skip":
        out &= F.col("tags_json") != "{}"
    return out


def utility_missing_queryid(settings) -> Column:
    """A tracked utility statement without a query id, 1 or 0."""
    never = ["EXECUTE", "PREPARE"] + (["DEALLOCATE"] if settings.server_major < 17 else [])
    return (F.col("is_utility") & (F.col("queryid") == 0) & F.lit(settings.track_utility) & ~F.col("command_tag").isin(never)).cast("long")


def nesting_level(flags: str = "parents", server_major: int = 18) -> Column:
    """Nesting from the statements around one (F4, F5): *flags* is an array of
    (command_tag, is_utility) of the enclosing statements.  EXECUTE and PREPARE
    don't nest; other utilities nest from 17 on; planning counts from 17 on."""
    nests = F.size(F.filter(flags, lambda p: ~p["command_tag"].isin("EXECUTE", "PREPARE") & (~p["is_utility"] | F.lit(server_major >= 17))))
    return nests + (F.col("during_planning").cast("int") if server_major >= 17 else F.lit(0))
