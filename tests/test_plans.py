"""No query plans a product of tables; filters and columns reach the scans."""

import pytest
from loomstone.operators import graph, search
from loomstone.operators.match import SearchSpec
from loomstone.plans import registry
from loomstone.runtime import table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["tier_concat", "join_enclosing", "join_position", "find_definition_at", "classify_root", "invalidate_referrers", "compact", "count_refs", "micro_macro_recall", "cascade_refresh", "p2_per_key", "snapshot_diff"])
def test_no_products(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_pruned_columns_and_pushed_filters(spark):
    text = plan(graph.hierarchy_edges(table(spark, SF, "edges")))
    assert "PushedFilters: [In(type" in text and "ReadSchema: struct<src:string,dst:string,type:string>" in text
    text = plan(search.symbol_hits(table(spark, SF, "symbols"), SearchSpec("add")))
    assert "GreaterThanOrEqual(file_id,0)" in text and "WindowGroupLimit" in text and "enclosing" not in text.split("ReadSchema")[-1]
