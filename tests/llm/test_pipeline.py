import corpus_pipeline
from conftest import SMALL
from oracle import connect, same_rows
from test_pipeline_near import brute_components

from tracemill.llm import queries


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen, names = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        seen.append((name, out.count()))
        if name != "packing":
            assert out.columns == names
        if name == "n-gram Jaccard join":
            found = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)  # five words, four fifths
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in found.items() if c == i}
        if name == "exact dedup":
            first = {}
            for r in sorted(docs.collect()):
                first.setdefault(" ".join(r.text.split()), r.doc_id)
            assert {r.doc_id for r in out.collect()} == set(first.values())
        docs = out
    assert len(seen) == 5 and corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_queries_match_sql(spark):
    con, found = connect(SMALL), queries.queries()
    for name, sql in queries.oracle_sql().items():
        same_rows(found[name](spark, SMALL), con, sql)
