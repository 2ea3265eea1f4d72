"""Values are grouped by document in tasks whose number follows the tables."""

from __future__ import annotations

import duckdb
import pytest

from lanthorn.plans import corpora
from lanthorn.plans.queries import QUERIES


@pytest.fixture
def tables(tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select 1::bigint as doc_id, 'mail a@b.de, A@b.de' as text union all select 1, 'mail a@b.de') to '{tmp_path}/documents.parquet' (format parquet)")
    con.execute(f"copy (select i as c_custkey from range(50) t(i)) to '{tmp_path}/customer.parquet' (format parquet)")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["findings_by_value", "pseudonym_map", "full_findings_by_value", "full_pseudonym_map"])
def test_no_table_of_values_before_the_shuffle(spark, tables, capsys, name):
    df = QUERIES[name](spark, tables)
    df.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(doc_id" in plan and plan.rindex("HashAggregate") < plan.index("hashpartitioning(doc_id")
    rows = [tuple(r) for r in df.where("doc_id = 1").collect()]
    assert len([r for r in rows if "EMAIL" in r]) == 1 and len(set(rows)) == len(rows)


def test_tasks_follow_the_rows(spark, tables, monkeypatch):
    few = corpora.tasks(corpora.table(spark, tables, "customer"))
    monkeypatch.setattr(corpora, "ROWS_A_TASK", 1)
    assert few == 16 and corpora.tasks(corpora.table(spark, tables, "customer")) == 50
    assert corpora.notes(spark, tables).rdd.getNumPartitions() == 50
