"""Tags of nested statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a nested statement takes from its root, and what it has without one.
TAGS = {"tags_json": "{}", "exemplars_json": "{}", "candidates_json": "[]"}


def resolve_roots(df: DataFrame, rounds: int = 32) -> DataFrame:
    """*df* with root_seq from parent_seq, by pointer jumping: each round
    doubles the depth that is resolved, and ends when nothing moves."""
    roots = df.select("seq", F.coalesce("parent_seq", "seq").alias("up"))
    last = None
    for _ in range(rounds):
        above = roots.select(F.col("seq").alias("_s"), F.col("up").alias("_u"))
        new = roots.join(above, roots["up"] == above["_s"], "left").select("seq", "up", F.coalesce("_u", "up").alias("next"))
        new = new.cache()
        moved = new.where("next <> up").count() > 0  # fills the cache, so the last round's can go
        if last is not None:
            last.unpersist()
        last = new
        roots = new.select("seq", F.col("next").alias("up"))
        if not moved:
            break
    return df.drop("root_seq").join(roots.withColumnRenamed("up", "root_seq"), "seq")


def with_nesting(df: DataFrame, mode: str = "inherit") -> DataFrame:
    """*df* with the tags that nested statements get: ``inherit`` those of the
    statement that runs them, ``scan`` their own, ``none`` none.  Statements
    run while another is planned have no active one and keep their own."""
    if mode == "scan":
        return df
    own = [c for c in TAGS if c in df.columns]
    nested = F.coalesce((F.col("nesting_level") > 0) & ~F.col("during_planning"), F.lit(False))
    if mode == "none":
        return df.withColumns({c: F.when(nested, F.lit(TAGS[c])).otherwise(F.col(c)) for c in own})
    # only nested statements are joined, and only to roots that they name: the
    # others, without a key to join by, would all meet in one task
    inner = df.where(nested)
    wanted = inner.select(F.col("root_seq").alias("_w")).where("_w is not null").distinct()
    roots = df.join(wanted, df["seq"] == F.col("_w"), "left_semi").select(F.col("seq").alias("_root"), *(F.col(c).alias(f"_{c}") for c in own))
    # one without a root joins by its own seq, so that those don't meet either
    named = F.col("root_seq").isNotNull()
    joined = inner.withColumn("_named", named).withColumn("_key", F.coalesce("root_seq", "seq")).join(roots, (F.col("_key") == F.col("_root")) & F.col("_named"), "left")
    # a root whose tags were read plainly has no candidates of its own
    taken = {c: F.when(F.col("_root").isNull(), F.lit(TAGS[c])).otherwise(F.col(f"_{c}")) for c in own}
    return df.where(~nested).unionByName(joined.select(*(taken[c].alias(c) if c in own else F.col(c) for c in df.columns)))
