"""Registered queries against their SQL, and all queries for whole and well-formed results."""

import pytest
from compare import same

from lociloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, data, name):
    assert same(QUERIES[name](spark, data), duck.sql(ORACLE[name]).df())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op5_decontamination", "op9_chat_trees", "op11_turn_repair")])
def test_a_row_for_each_document(spark, data, tables, name):
    got = sorted(r["doc_id"] for r in QUERIES[name](spark, data).select("doc_id").collect())
    assert got == sorted(r["doc_id"] for r in tables["documents"].select("doc_id").collect())
