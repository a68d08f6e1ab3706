"""Queries that take a few documents of a corpus leave the rest of it where it is read."""

from evisparq.plans import catalog
from evisparq.sources import scratch

SF = "/root/testdata/sf0.001"


def planned(spark, name):
    """The plan of a query where no table counts as small by the size of its files, as with large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_of_a_run_are_found_without_exchanging_the_corpus(spark):
    for name in ("rank_fixed256", "full_document_fields", "full_abstract"):
        plan = planned(spark, name)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, name


def tables_written(spark, monkeypatch, name):
    """The names of the tables that a query writes on its way."""
    names, write = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name, rows=None: names.append(name) or write(df, name, rows))
    catalog.queries()[name](spark, SF).collect()
    return names


def test_both_orders_show_one_search(spark, monkeypatch):
    assert tables_written(spark, monkeypatch, "context_order_invariant").count("terms") == 1


def test_columns_of_the_error_audit_share_search_and_judgements(spark, monkeypatch):
    names = tables_written(spark, monkeypatch, "error_audit")
    assert names.count("terms") == names.count("pairs") == 1


def test_excerpts_are_taken_beside_the_seeds(spark, monkeypatch):
    assert tables_written(spark, monkeypatch, "two_round_expand").count("hits") == 1


def test_titles_and_annotated_texts_are_found_without_exchanging_the_corpus(spark):
    for name in ("pack_context", "frozen_snippets"):
        plan = planned(spark, name)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, name


def test_arms_share_the_judgements(spark, monkeypatch):
    assert tables_written(spark, monkeypatch, "oracle_arms").count("pairs") == 1
