"""The queries with a DuckDB twin, and the pipeline."""

import glob
import os
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from growmap.llm import outliers, registry
from growmap.llm.common import table
from tests.llm.test_small_cases import brute_fingerprint

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(registry.SQL[name])
    want = rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()
    assert sorted(rel.columns) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(want, key=repr)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def benchmark_windows(texts):
    items = [w for w in map(plain_words, texts) if w]
    return {tuple(w[k : k + 13]) for w in items for k in range(max(len(w) - 12, 1))}


def holds_a_window(text, windows):
    w = plain_words(text)
    return any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))


def brute_groups(rows):
    """Ids whose fingerprints are linked within 2 bits, over any number of links; all pairs are looked at."""
    fps = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    groups = [{i} for i, _ in rows]
    for a in range(len(rows)):
        for b in np.flatnonzero(np.bitwise_count(fps[:a] ^ fps[a]) <= 2).tolist():
            if groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for k in [k for k, g in enumerate(groups) if g is groups[b]]:
                    groups[k] = groups[a]
    return {id(g): g for g in groups}.values()


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        counts.append(len(rows))
        if k < 4:
            assert docs.columns == columns
        ids = {r.doc_id for r in rows}
        if name == "quality":
            kept = {r.doc_id for r in outliers.op8(spark, SF).filter("kept").collect()}
            assert ids == kept
        if name == "near_duplicates":
            groups = brute_groups([(r.doc_id, r.text) for r in before.collect()])
            assert ids == {min(g) for g in groups} and len(rows) == len(ids)
        if name == "decontamination":
            windows = benchmark_windows(r.text for r in table(spark, SF, "benchmark").collect())
            held = {r.doc_id for r in before.collect() if holds_a_window(r.text, windows)}
            assert held and ids == {r.doc_id for r in before.collect()} - held
        if name == "sharding":
            assert len(rows) == counts[-2] and {r.shard for r in rows} <= set(range(corpus_pipeline.SHARDS))
        if name == "mixing":
            words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rs)
            assert words(rows) == pytest.approx(1.5 * words(before.collect()), rel=0.05)


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    rel = con.sql(corpus_pipeline.ORACLE_SQL)
    out = corpus_pipeline.run(spark, sf)
    assert sorted(out.columns) == sorted(rel.columns)
    assert sorted(map(tuple, out.select(*rel.columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr)


ODD = [
    (1, "same words here " * 20, "en", "a", None, 1, "x"),
    (1, "same words here " * 20, "en", "a", None, 1, "x"),
    (None, None, None, None, None, None, None),
    (None, "", None, "a", 0, 2, "y"),
    (7, " ".join(f"word{k}" for k in range(60)), "de", None, 5, 3, "z"),
    (7, " ".join(f"word{k}" for k in range(60)), "de", None, 5, 3, "z"),
    (8, " ".join(f"term{k}" for k in range(70)), None, "b", 5, 3, "z"),
]


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, key string"
    bench = spark.createDataFrame([(1, " ".join(f"term{k}" for k in range(13))), (2, None)], "item_id bigint, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = spark.createDataFrame(ODD, schema)
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        left = []
        for step, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[: len(odd.columns)] == odd.columns
            out.write.parquet(f"{tmp_path}/{name}-{step}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{step}")
            left.append(sorted(r.doc_id for r in docs.collect()))
        if name == "odd":
            assert left[:3] == [[7, 7, 8], [7, 8], [7]]
            assert set(left[3]) <= {7} and left[4] == left[3]
        else:
            assert left == [[]] * 5
