"""Tags of executions: built-in expressions where the text is plain, an Arrow
UDF with the exact lexer elsewhere."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tagset import Pipeline, to_json

COUNTS = ("invalid_tags", "dropped_tags", "heuristic_scans", "normalized_tags", "normalize_failures", "capped_tags", "exemplar_values_dropped")
RESULT = "struct<tags_json:string,exemplars_json:string,candidates_json:string,footer:boolean,heuristic:boolean," + ",".join(f"{c}:long" for c in COUNTS) + ">"
#: Results that a worker remembers by text; prepared statements repeat theirs.
MEMO = 50_000


def exact_udf(settings):
    """A UDF from (text, location, length, scs, appname, override, since) to RESULT."""
    pipeline, memo = Pipeline(settings), {}

    def one(text, location, length, scs, appname, override, since) -> tuple:
        raw = text.encode() if isinstance(text, str) else bytes(text)
        r = pipeline.extract(raw, int(location), int(length), bool(scs), appname.encode() if appname else None, override.encode() if override else None, since=int(since))
        return (
            to_json(r.tags), json.dumps(dict(sorted(r.exemplars.items())), ensure_ascii=False, separators=(",", ":")), json.dumps(r.candidates, ensure_ascii=False),
            r.footer, r.heuristic, *(r.counts.get(c, 0) for c in COUNTS),
        )

    names = ["tags_json", "exemplars_json", "candidates_json", "footer", "heuristic", *COUNTS]
    none = (None, None, None, None, None, *(None for _ in COUNTS))

    def run(text, location, length, scs, appname, override, since):
        out = []
        for row in zip(text, location, length, scs, appname, override, since, strict=True):
            if row[0] is None:
                out.append(none)
                continue
            if row not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[row] = one(*row)
            out.append(memo[row])
        return pd.DataFrame(out, columns=names)

    run.__annotations__ = {n: pd.Series for n in ("text", "location", "length", "scs", "appname", "override", "since")} | {"return": pd.DataFrame}
    return F.pandas_udf(run, RESULT)


def plain_settings(s) -> bool:
    """Whether the built-in expressions cover a configuration."""
    p = s.parsed
    simple = all(e.name in ("sqlcommenter", "marginalia") and e.position == "append" and not (e.merge or e.keys or e.rename or e.appname) and e.url_decode and e.kv_sep == b":" and e.pair_sep == b"," for e in p["extractors"])
    return simple and p["tags"] != ("*",) and not p["normalize"] and not p["exemplars"] and len(p["tags"]) <= s.max_tags and all(k.isidentifier() for k in p["tags"])


_WORD = "[A-Za-z0-9_.-]"
_SQLC = f"{_WORD}+='[A-Za-z0-9_. -]*'"
_MARG = f"{_WORD}+:[A-Za-z0-9_.: -]*"


def plain_tags(s, text: str = "query_string") -> Column:
    """tags_json of texts that hold one trailing comment without escapes and
    nothing before it that could hide one; null for all other texts."""
    names = [e.name for e in s.parsed["extractors"]]
    body = F.regexp_extract(text, r"^[^'\"$/\-]*/\*([^*/]*)\*/[; ]*$", 1)
    whole = (F.col("stmt_location") < 0) & (F.octet_length(text) <= s.scan_window) & F.col("application_name").isNull() & F.col("tags_override").isNull()
    fits = F.octet_length(body) <= min(s.max_tag_value_len, s.max_tagset_bytes - 8 * s.max_tags)
    keys = sorted(s.parsed["tags"])

    def tags(pair) -> Column:
        items = []
        for k in keys:
            p = f"(?:^|,){pair(k)}"
            items += [F.lit(k), F.when(body.rlike(p), F.trim(F.regexp_extract(body, p, 1)))]
        return F.to_json(F.map_filter(F.create_map(*items), lambda _, v: v.isNotNull()))

    out = F.when(~F.col(text).contains("/*") & ~F.col(text).contains("--"), F.lit("{}"))
    if "sqlcommenter" in names:
        out = out.when(fits & body.rlike(f"^{_SQLC}(,{_SQLC})*$"), tags(lambda k: f"{k}='([^']*)'"))
    if "marginalia" in names:
        out = out.when(fits & body.rlike(f"^{_MARG}(,{_MARG})*$"), tags(lambda k: f"{k}:([^,]*)"))
    return F.when(whole, out)


def with_tags(df: DataFrame, settings, fast: bool = True) -> DataFrame:
    """*df* (executions) with tags_json, exemplars_json, candidates_json,
    footer, heuristic and the counters.  *fast*: rows that the built-in
    expressions cover don't enter the UDF."""
    udf = exact_udf(settings)
    use = fast and plain_settings(settings)
    plain = plain_tags(settings) if use else F.lit(None).cast("string")
    left = df.withColumn("_plain", plain)
    text = F.when(F.col("_plain").isNull(), F.col("query_string"))
    since = F.col("since") if "since" in df.columns else F.lit(0)
    left = left.withColumn("_x", udf(text, "stmt_location", "stmt_len", "scs", "application_name", "tags_override", since))
    zero = [F.coalesce(F.col(f"_x.{c}"), F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return left.select(
        *df.columns, F.coalesce("_plain", "_x.tags_json").alias("tags_json"), F.coalesce("_x.exemplars_json", F.lit("{}")).alias("exemplars_json"),
        F.col("_x.candidates_json").alias("candidates_json"), F.coalesce("_x.footer", F.lit(False)).alias("footer"), F.coalesce("_x.heuristic", F.lit(False)).alias("heuristic"), *zero,
    )


def with_tags_distinct(df: DataFrame, settings) -> DataFrame:
    """As with_tags, but each distinct text goes through the lexer once, for
    logs in which few long texts repeat."""
    keys = ["query_string", "stmt_location", "stmt_len", "scs", "application_name", "tags_override"]
    once = with_tags(df.select(*keys).distinct(), settings)
    same = None
    for k in keys:
        c = df[k].eqNullSafe(once[k])
        same = c if same is None else same & c
    return df.join(once, same).select(df["*"], *(once[c] for c in once.columns if c not in keys))


def with_since(df: DataFrame) -> DataFrame:
    """*df* with ``since``: where the statement before this one in the same
    string of the same session ends (B18), so that a long string of statements
    is lexed once in all."""
    before = Window.partitionBy("pid", "query_string").orderBy("stmt_location")
    end = F.lag(F.col("stmt_location") + F.col("stmt_len")).over(before)
    return df.withColumn("since", F.coalesce(end, F.lit(0)))


def with_appname_and_override(df: DataFrame, appname: str | None, override: str | None) -> DataFrame:
    return df.withColumn("application_name", F.lit(appname).cast("string")).withColumn("tags_override", F.lit(override).cast("string"))


def extract(settings, query: str | bytes | None, location: int = -1, length: int = 0, **more) -> dict | None:
    """The debug function: tags and diagnostics of one text."""
    if query is None:
        return None
    raw = query.encode() if isinstance(query, str) else query
    if location != -1 and not 0 <= location <= len(raw):
        raise ValueError(f"stmt_location {location} is out of range: -1, or 0 to {len(raw)}")
    if location >= 0 and not 0 <= length <= len(raw) - location:
        raise ValueError(f"stmt_len {length} is out of range")
    p = Pipeline(settings)
    return p.diagnostics(p.extract(raw, location, length, **more))


def register(spark: SparkSession, settings, name: str = "extract_tags") -> None:
    """Make the debug function a SQL function: name(query, location, length) gives JSON."""

    def run(query: pd.Series, location: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([None if q is None else json.dumps(extract(settings, q, int(a), int(b))) for q, a, b in zip(query, location, length, strict=True)])

    spark.udf.register(name, F.pandas_udf(run, "string"))


def register_table_function(spark: SparkSession, settings, name: str = "tags_of") -> None:
    """Make a SQL table function: name(query) gives a row (key, value) for each
    tag; a capped value is null."""

    @F.udtf(returnType="key: string, value: string")
    class TagsOf:
        def eval(self, query: str):
            if query is not None:
                yield from extract(settings, query)["tags"].items()

    spark.udtf.register(name, TagsOf)
