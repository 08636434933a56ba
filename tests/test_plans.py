"""Plan shapes: no pairs of all rows, scans pruned and filtered."""

import re

import pytest

from cairnlight.plans import catalogue


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()






@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_cross_products(spark, sf, name):
    assert not re.search("CartesianProduct|NestedLoop", plan_of(catalogue.QUERIES[name](spark, sf))), name


def test_scans_are_pruned(spark, sf):
    plan = plan_of(catalogue.QUERIES["filtered_page_in_list"](spark, sf))
    assert "PushedFilters: [In(o_orderpriority" in plan
    assert "l_extendedprice" not in plan
    plan = plan_of(catalogue.QUERIES["tumbling_event_counts"](spark, sf))
    assert "props" not in plan


@pytest.mark.parametrize("name", ["prefilter_and_dispatch", "signal_score", "prefilter_pass", "prefilter_ignored", "matched_signals", "topic_cooccurrence", "trajectory_class", "concept_timeline_pivot", "signal_graph_nodes"])
def test_texts_are_prepared_once(spark, sf, name):
    """Two patterns a scan of documents, however many terms and filters read the prepared text."""
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2 * plan.count("Relation [doc_id"), plan.count("regexp_replace")


def test_row_rules_stay_in_generated_code(spark, sf):
    plan = plan_of(catalogue.QUERIES["signal_score"](spark, sf))
    assert "Python" not in plan and "Exchange" not in plan
    plan = plan_of(catalogue.QUERIES["topk_per_tier"](spark, sf))
    assert "WindowGroupLimit" in plan
