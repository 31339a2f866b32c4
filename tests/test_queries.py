import pytest
from conftest import SF, rows_of

import __spark_entry__
from threadloom.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    assert rows_of(Q.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(Q.ORACLE_SQL[name]).fetchdf())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_summaries_hold_whole_texts(spark):
    texts = {str(r["doc_id"]): r["text"] for r in Q.table(spark, SF, "documents").collect()}
    assert {r["id"]: r["content"] for r in Q.summary_table(spark, SF).collect()} == texts


def test_filters_reach_the_scan(spark):
    plan = Q.table(spark, SF, "conversations").filter("role = 'user'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,user)" in plan
