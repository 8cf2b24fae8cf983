from conftest import SMALL

from tracemill.llm import queries, sharding
from tracemill.llm.common import shared_dir


def test_op1_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    folder = shared_dir(spark, "empty")
    docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    out = queries.op1_sharding(spark, folder)
    assert out.count() == 0
    assert out.dtypes == queries.op1_sharding(spark, SMALL).dtypes


def test_rows_after_an_empty_start(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    store = sharding.ShardStore(spark, shared_dir(spark, "store"))
    store.append(docs.limit(0))
    store.append(docs.limit(0))
    assert store.read().columns == docs.columns and store.read().count() == 0 and store.compact() is None
    for k in range(4):
        store.append(docs.filter(f"doc_id % 4 = {k}").coalesce(1))
    assert store.compact() == 7 and store.read(2).count() == 0
    assert sorted(map(tuple, store.read().select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
