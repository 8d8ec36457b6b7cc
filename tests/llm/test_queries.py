import pytest

from quillstone.llm import queries
from tests.test_catalogue import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, data, name):
    compare(spark, data, queries.QUERIES[name], queries.ORACLE[name])


COLUMNS = {
    "p2_found": ["address_id_a", "address_id_b"], "p4_found": ["dup_group", "field_name", "candidate_id"], "p5_found": ["lei", "candidate_id"], "p7_found": ["node_id", "group_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, data, name):
    assert queries.QUERIES[name](spark, data).columns == COLUMNS[name]


def test_rates_follow_from_scores(spark, data):
    """The rates of each source are the means of the scores of its documents."""
    from quillstone.tables import table

    scored = {r["doc_id"]: r for r in queries.p10_scores(spark, data).collect()}
    by = {}
    for r in table(spark, data, "documents", "doc_id", "source").collect():
        by.setdefault(r["source"], []).append(scored[r["doc_id"]])
    for r in queries.p10_rates(spark, data).collect():
        mine = by.pop(r["source"])
        assert r["n_docs"] == len(mine) and r["n_abusive"] == sum(x["abusive"] for x in mine)
        assert abs(r["rate"] - r["n_abusive"] / r["n_docs"]) < 1e-9 and abs(r["mean_score"] - sum(x["score"] for x in mine) / len(mine)) < 1e-9
    assert not by


def test_fill_is_what_the_containers_hold(spark, data):
    from collections import Counter

    from quillstone.llm import packing
    from quillstone.tables import table

    capacity = packing.capacities_of(table(spark, data, "container_specs"))
    tokens, bins = Counter(), {}
    for r in queries.p9_containers(spark, data).collect():
        tokens[r["container_kind"]] += r["n_tokens"]
        bins.setdefault(r["container_kind"], Counter())[r["container_id"]] += r["n_tokens"]
    for r in queries.p9_fill(spark, data).collect():
        kind = r["container_kind"]
        assert (r["n_containers"], r["n_tokens"]) == (len(bins[kind]), tokens[kind]) and r["unused_tokens"] == len(bins[kind]) * capacity[kind] - tokens[kind]
        assert max(bins[kind].values()) <= capacity[kind]
