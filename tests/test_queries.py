"""Every registered query against its SQL on the smallest tables, and basic checks of those without SQL."""

import __spark_entry__ as entry
import compare
import pytest

from tagweave.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note, _ = compare.check(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["product_sku", "good_type", "label", "prob", "rank"]
    assert df.limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    # Every tagging query but iterative and approximate ones has its SQL; those and the optional operators have tests of their own.
    assert set(ORACLES) == set(QUERIES) - compare.WITHOUT_SQL


def test_tasks_of_scores_grow_with_lines_and_labels(spark, tmp_path, monkeypatch):
    from tagweave.plans import fixtures

    names = ["red bolt", "old ring", "hot gear"]
    spark.createDataFrame([(i, n) for i, n in enumerate(names)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, f"{i % 4}-KIND") for i in range(300)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i // 2, i % 3, i % 2) for i in range(600)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(fixtures, "CELLS_PER_TASK", 100)
    v = fixtures.Views(spark, str(tmp_path))
    scores = v.scores()
    assert scores.rdd.getNumPartitions() == v.score_tasks == 36
    assert scores.count() == 300 * 6
    # Choosing tags and meeting the truth moves no scores.
    assert max(scores.rdd.glom().map(len).collect()) < 300


def test_rerank_apply_stores_no_scores(spark, tmp_path, monkeypatch):
    from tagweave.plans import registry

    names = ["red bolt", "old ring", "hot gear", "new rod"]
    spark.createDataFrame([(i, n) for i, n in enumerate(names)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, f"{i % 4}-KIND") for i in range(30)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i // 2, i % 4, i % 2) for i in range(60)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    kept, durable = [], registry.durable
    monkeypatch.setattr(registry, "durable", lambda df, *a: kept.append(durable(df, *a)) or kept[-1])
    rows = registry.QUERIES["rerank_apply"](spark, str(tmp_path)).collect()
    assert {r.product_sku for r in rows} == set(range(30))
    # 30 products times 8 labels are scored; what is written are replies' tags and small tables.
    assert max(df.count() for df in kept) < 30 * 8


def test_lines_and_orders_meet_in_tasks_that_grow_with_them(spark, tmp_path, monkeypatch):
    from tagweave.plans import fixtures

    spark.createDataFrame([(i, "red bolt") for i in range(3)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    orders = [(i, f"{i % 4}-KIND") for i in range(320)] + [(7, "1-KIND"), (None, "2-KIND")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(i // 2, i % 3, i % 2) for i in range(600)] + [(None, 1, 1), (1, None, 1), (999, 1, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(fixtures, "LINES_PER_TASK", 10)
    v = fixtures.Views(spark, str(tmp_path))
    # 603 lines; neither join broadcasts a table that grows with them, nor takes a default number of tasks.
    assert v.line_tasks == v.score_tasks == 61
    for made in (v.products(), v.tagged(), v.truth()):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan
        assert made.rdd.getNumPartitions() == 61
    # Order 7 is listed twice.
    assert v.products().count() == 301 and v.tagged().count() == 602
    assert v.truth().count() == 600 + 2
