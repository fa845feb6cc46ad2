"""The queries against their SQL, and the pipeline's stages against their operators' brute force."""

import duckdb
import pytest

from lexiloom.llm import decontaminate, jaccard_join, queries

pytest.importorskip("public_tokenizers")
TABLES = ("documents", "benchmark", "conversations")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, sf_dir)
    order = sorted(found.columns)
    assert order == sorted(want.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r[c] for c in order) for r in found.collect()) == key(want.select(*order).fetchall())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf_dir).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        rows[name] = {r.doc_id: r for r in out.collect()}
        at = out
    names = [n for n, _ in corpus_pipeline.STAGES]
    for before, after in zip(names, names[1:]):
        assert rows[after].keys() <= rows[before].keys()
    ruled = {r.doc_id for r in queries.op1_quality_rules(spark, sf_dir).collect() if r.kept}
    assert rows["quality_rules"].keys() == ruled and len(ruled) > len(texts) // 2
    kept = rows["near_duplicates"]
    sets = {i: set(jaccard_join.shingles(r.text).tolist()) for i, r in kept.items()}
    for a in sets:
        for b in sets:
            if a < b:
                assert len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b]) or not sets[a]
    matcher = decontaminate.Matcher(items, decontaminate.WINDOW)
    for i, r in kept.items():
        n, spans, _, _ = matcher.match(r.text)
        hit = sum(e - s for s, e in spans)
        assert (i in rows["decontaminate"]) == (not (hit and 20 * hit >= n))
    assert rows["encode"].keys() == rows["decontaminate"].keys()
