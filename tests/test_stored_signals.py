import pytest
from pyspark.sql import functions as F

from tidemark.plans import queries
from tidemark.sources import star


class Stop(Exception):
    pass


@pytest.fixture
def tables(spark, tmp_path):
    day = "timestamp '1999-06-01' + make_interval(0, 0, 0, cast(id % 300 as int))"
    made = {
        "orders": spark.range(60).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "if(id % 2 = 0, '1-URGENT', '2-HIGH') as o_orderpriority", f"{day} as o_orderdate"),
        "customer": spark.range(7).selectExpr("id as c_custkey", "id % 3 as c_nationkey", "if(id < 3, 'MACHINERY', 'HOUSEHOLD') as c_mktsegment"),
        "nation": spark.range(3).selectExpr("id as n_nationkey", "concat('NATION_', id) as n_name"),
        "lineitem": spark.range(180).selectExpr(
            "id % 60 as l_orderkey", f"{day} as l_shipdate", "cast(id % 50 as double) as l_quantity",
            "if(id % 2 = 0, 'R', 'N') as l_returnflag", "'F' as l_linestatus", "cast(id % 8 as int) as l_linenumber",
        ),
        "documents": spark.range(11).selectExpr("id as doc_id", "if(id = 4, null, concat('text ', id)) as text"),
    }
    for name, rows in made.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", ["tree_signals", "fitted_ladder"])
def test_a_fit_reads_signals_that_are_stored(spark, tables, monkeypatch, query):
    read = []

    def stop(train, spec=None):
        read.extend(train.inputFiles())
        raise Stop

    monkeypatch.setattr(queries.trees, "fit_trees", stop)
    monkeypatch.setattr(queries.training, "fit_linear", stop)
    with pytest.raises(Stop):
        getattr(queries, query)(spark, tables)
    assert read and not [f for f in read if "lineitem" in f]


def test_texts_of_stored_issues_are_those_of_issues(spark, tables, tmp_path):
    star.issues(spark, tables).write.parquet(f"{tmp_path}/stored")
    got = star.with_body(spark, tables, spark.read.parquet(f"{tmp_path}/stored"))
    want = star.issues(spark, tables, body=True)
    assert got.columns == want.columns and want.where(F.col("body").isNotNull()).count() > 30
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
