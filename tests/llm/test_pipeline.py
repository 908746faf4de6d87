"""The pipeline stage by stage, and the registered queries beside their SQL."""

import duckdb
import pytest

import corpus_pipeline
from tagmeter.llm import registry

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns[: len(names)] == names and 0 < len(after) <= len(before)
        if name == "line_dedup":
            gone = brute.lines(before)
            for doc, text in before:
                want = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(doc, ()))
                left, whole = len(want.encode().split()), len(text.encode().split())
                assert after.get(doc) == (want if doc not in gone or left and 4 * left >= whole else None)
        if name == "near_duplicates":
            assert set(after) == {c for _, n, c in brute.jaccard(before) if n} | {d for d, n, _ in brute.jaccard(before) if not n}
        if name == "benchmark_decontamination":
            dirty = {r[0] for r in brute.decontaminate(before, items) if r[-1]}
            assert set(after) == {d for d, _ in before} - dirty
        assert i or len(after) >= 0.97 * len(before)
    assert docs.columns[len(names) :] == ["size", "target", "taken", "position"]
    assert docs.where("taken <= 0 or taken > 2 * size").count() == 0


def test_run(spark):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = c.sql(registry.oracles()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[x]) for x in order) for r in df.collect())
    assert got == sorted(tuple(show(r[want.columns.index(x)]) for x in order) for r in want.fetchall())
