import random

from pyspark.sql import functions as F

from quillstone.llm import components as C
from quillstone.operators import hotkeys
from tests.conftest import rows

SCHEMA = "a string, b string"


def brute(links):
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in links:
        if a and b and a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return sorted((v, top(v)) for v in up)


def some_links(rng):
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [("hub", f"leaf{i}") for i in range(150)]
    links += [(f"r{rng.randrange(200)}", f"r{rng.randrange(200)}") for _ in range(130)]
    return [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links]


def test_components_are_brute_force(spark):
    assert not hasattr(C, "BASE_LINKS")  # no other way for few links
    rng = random.Random(2)
    links = some_links(rng)
    dirty = links + links[:40] + [("x", "x"), (None, "y"), ("z", None)]
    assert rows(C.connected_groups(spark.createDataFrame(dirty, SCHEMA), "a", "b")) == brute(links)


def test_hot_vertex_takes_the_other_join(spark, monkeypatch):
    monkeypatch.setattr(hotkeys, "HOT_ROWS", 50)
    monkeypatch.setattr(hotkeys, "HOT_KEYS", 10)
    links = some_links(random.Random(6))
    assert rows(C.connected_groups(spark.createDataFrame(links, SCHEMA), "a", "b")) == brute(links)


def test_empty_and_clashing_columns(spark):
    assert C.connected_groups(spark.createDataFrame([], SCHEMA), "a", "b").count() == 0
    assert C.connected_groups(spark.createDataFrame([("x", "x")], SCHEMA), "a", "b").count() == 0
    df = spark.createDataFrame([("2", "1", "q", 1)], "v string, label string, a string, centre int")
    assert rows(C.connected_groups(df, "v", "label")) == [("1", "1"), ("2", "1")]


def test_packets(spark):
    node = lambda x: (x, "n", "j")
    data = [("1", node(" A"), node("b"), (" accept ", None, 1.0)), ("2", node("B"), node("c "), ("ACCEPT", None, 1.0)), ("3", node("c"), node("d"), ("REVIEW", None, 1.0)), ("4", node("e"), node("E"), ("ACCEPT", None, 1.0)), ("5", None, node("f"), ("ACCEPT", None, 1.0)), ("6", node("g"), node("h"), None)]
    s = "struct<node_id string, canonical_name string, jurisdiction string>"
    df = spark.createDataFrame(data, f"packet_id string, candidate_a {s}, candidate_b {s}, deterministic_evaluation struct<decision string, resolution_reason string, score double>")
    assert rows(C.found_groups(df)) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_a_round_adds_one_join_to_the_plan(spark, monkeypatch):
    links = spark.createDataFrame(some_links(random.Random(4)), SCHEMA)
    for rounds in (3, 5):
        monkeypatch.setattr(C, "ROUNDS", rounds)
        plan = C._clusters(links, 0, 1)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") <= rounds


def test_nodes_of_one_number_stay_apart(spark, monkeypatch):
    """Hashes that two nodes share are never taken: another seed is, or in the end the node itself."""
    links = some_links(random.Random(8))
    number = C._number
    for good in (1, 99):
        monkeypatch.setattr(C, "_number", lambda c, seed: number(c, seed) if seed == good else F.pmod(number(c, seed), F.lit(5)))  # noqa: B023
        assert rows(C.connected_groups(spark.createDataFrame(links, SCHEMA), "a", "b")) == brute(links)


def test_levels_hold_numbers_for_long_names(spark, monkeypatch):
    kinds = []
    clusters = C._clusters
    monkeypatch.setattr(C, "_clusters", lambda links, *x: kinds.append(dict(links.dtypes)) or clusters(links, *x))
    links = [(f"{'long name ' * 20}{i}", f"{'long name ' * 20}{i + 1}") for i in range(20)]
    assert rows(C.connected_groups(spark.createDataFrame(links, SCHEMA), "a", "b")) == brute(links)
    assert kinds and all(k == {"a": "bigint", "b": "bigint"} for k in kinds)
