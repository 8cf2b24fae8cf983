import pytest
from conftest import SMALL
from oracle import connect, same_rows

from tracemill.plans import boxes, jobs, more  # noqa: F401
from tracemill.plans import peaks as _peaks  # noqa: F401
from tracemill.plans import queries as plans
from tracemill.plans import whole as _whole  # noqa: F401


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, con, name):
    same_rows(plans.QUERIES[name](spark, SMALL), con, plans.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pairs_of_marked_rows_only(spark, monkeypatch, tmp_path):
    from tracemill.operators import range_join

    seen, plain = [], range_join.near_pairs
    monkeypatch.setattr(range_join, "near_pairs", lambda rows, *more: plain(seen.append(rows) or rows, *more))
    spark.read.parquet(f"{SMALL}/customer.parquet").write.parquet(f"file://{tmp_path}/customer.parquet")
    spark.read.parquet(f"{SMALL}/embeddings.parquet").filter("vec_id < 20").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    plans.QUERIES["J9_near_duplicates"](spark, f"file://{tmp_path}")
    assert {r.id for r in seen[0].collect()} == set(range(20))


@pytest.mark.parametrize("name", ["J9_near_duplicates", "J19_pairs_across_splits"])
def test_pairs_meet_no_table(spark, name):
    plan = plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.split("\n")) == 1  # that of the pairs; rows bring what is compared


@pytest.mark.parametrize("name", ["J9_near_duplicates", "J19_pairs_across_splits"])
def test_pairs_of_copies(spark, tmp_path, name):
    import duckdb

    of = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    rows = [(k, "n", (None, 1, 2)[k // 20], (None, 500.0, 500.5, -50.0)[k % 4], "s") for k in range(60)]
    spark.createDataFrame([*rows, rows[31], rows[46]], of).coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    vectors = [(k, [float((k // 15 * 7 + i * i * (k % 4 + 1)) % 11) for i in range(64)], None if k % 8 == 1 else k % 2) for k in range(55)]
    spark.createDataFrame([*vectors, (31, vectors[3][1], 1), (99, vectors[0][1], 0)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("customer", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert con.execute(f"SELECT count(*) FROM ({plans.SQL[name]})").fetchone()[0] > 30
    same_rows(plans.QUERIES[name](spark, f"file://{tmp_path}"), con, plans.SQL[name])
