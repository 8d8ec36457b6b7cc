import re

import pytest

from quillstone.llm import queries
from tests.test_plans import plan


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_all_pairs_join_and_no_row_at_a_time_python(spark, data, name):
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan(queries.QUERIES[name](spark, data)))
