import pytest

pytest.importorskip("linkframe.llm")
from linkframe.llm.queries import QUERIES  # noqa: E402

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_products_and_no_row_functions(spark, name):
    text = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in FORBIDDEN if x in text]


def test_hot_group_of_copies_is_split(spark, skewed):
    from linkframe.llm.duplicates import collapse, link_key

    out = collapse(skewed, link_key(), "rawid")
    assert max(r.n_copies for r in out.collect()) == 66_667
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
