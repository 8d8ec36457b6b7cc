import re

import pytest

from quillstone.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_no_all_pairs_join_and_no_row_at_a_time_python(spark, data, name):
    p = plan(catalogue.queries()[name](spark, data))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", p)


def test_scans_read_only_what_is_used(spark, data):
    p = plan(catalogue.queries()["jurisdiction_alias"](spark, data))
    assert "ReadSchema: struct<candidate_id:bigint,jurisdiction:string>" in p
    p = plan(catalogue.queries()["html_text"](spark, data))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", p).group(1)
    assert all(f in pushed for f in ("IsNotNull(text)", "EqualTo(source,official_site)"))
