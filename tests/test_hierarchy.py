import random

from quillstone.operators import hierarchy as H
from quillstone.operators import hotkeys
from quillstone.session import Scratch
from tests.conftest import rows

SCHEMA = "child string, parent string"


def brute(links):
    up = {}
    for c, p in sorted(links, reverse=True):
        up[c] = p
    out = {}
    for v in {x for link in links for x in link}:
        path, seen = [v], {v}
        while path[-1] in up and up[path[-1]] not in seen:
            path.append(up[path[-1]])
            seen.add(path[-1])
        if path[-1] not in up:
            out[v] = ("TREE", path[-1], len(path) - 1, "/".join(reversed(path)))
        else:
            out[v] = ("CYCLE" if up[path[-1]] == v else "UNDER_CYCLE", "", -1, None)
    return out


def random_links(rng):
    n = 300
    links = [(f"n{i:03}", f"n{rng.randrange(max(0, i - rng.choice([1, 2, 40])), i):03}") for i in range(1, n) if i % 37]
    links += [(f"chain{i:03}", f"chain{i + 1:03}") for i in range(70)] + [(f"star{i}", "hub") for i in range(60)]
    links += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("u1", "c1"), ("u2", "u1"), ("u3", "u2"), ("self", "self"), ("under", "self")]
    return links


def test_nodes_paths_and_descendants_are_brute_force(spark):
    rng = random.Random(4)
    links = random_links(rng)
    want = brute(links)
    rng.shuffle(links)
    f = H.forest(spark.createDataFrame(links + links[:50] + [(None, "x"), ("y", None), (" ", "x")], SCHEMA))
    assert {r[0]: tuple(r[1:]) for r in H.node_table(f).collect()} == {v: w[:3] for v, w in want.items()}
    paths = {r["id"]: "/".join(r["path"]) for r in H.paths(f).collect()}
    assert paths == {v: w[3] for v, w in want.items() if w[0] == "TREE"}
    d = {r["id"]: r for r in H.descendant_intervals(f).collect()}
    for v, p in paths.items():
        under = {u for u, q in paths.items() if q.startswith(p + "/")}
        assert d[v]["n_descendants"] == len(under)
        got = {u for u, r in d.items() if r["root"] == d[v]["root"] and d[v]["entry"] < r["entry"] <= d[v]["last_entry"]}
        assert got == under


def test_empty_and_found_nodes(spark):
    f = H.forest(spark.createDataFrame([], SCHEMA))
    assert H.node_table(f).count() == H.paths(f).count() == H.descendant_intervals(f).count() == 0
    d = "IS_DIRECTLY_CONSOLIDATED_BY"
    df = spark.createDataFrame([("a ", "B", d, "ACTIVE", 1), ("A", "b", d, "active", 2), ("b", "z", d, None, 3), ("b", "z", d, "INACTIVE", 4), ("q", "z", "OTHER", "ACTIVE", 5)], "child_lei string, parent_lei string, relationship_type string, relationship_status string, id int")
    assert rows(H.found_nodes(df)) == [("A", "TREE", "B", 1), ("B", "TREE", "B", 0)]


def test_several_parents_follow_the_smallest(spark):
    f = H.forest(spark.createDataFrame([("a", "p2"), ("a", "p1")], SCHEMA))
    assert ("a", "TREE", "p1", 1) in rows(H.node_table(f))


def test_hot_keys_join_apart(spark, monkeypatch):
    monkeypatch.setattr(hotkeys, "HOT_ROWS", 10)
    monkeypatch.setattr(hotkeys, "HOT_KEYS", 20)
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, -1)], "k string, i int")
    right = spark.createDataFrame([("hot", "H")] + [(f"k{i}", "x") for i in range(0, 300, 6)], "k string, v string")
    for how in ("inner", "left"):
        assert rows(hotkeys.join_hot(left, right, "k", how)) == rows(left.join(right, "k", how))


def test_prefix_sum(spark):
    from pyspark.sql import functions as F

    df = spark.range(1_000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    got = sorted((r["g"], r["v"], r["before"]) for r in hotkeys.prefix_sum(df, ["g", "v"], F.col("v"), "before", Scratch(spark)).collect())
    total = 0
    for g, v, before in got:
        assert before == total
        total += v
    assert hotkeys.prefix_sum(df.where("v < 0"), ["g", "v"], F.col("v"), "before", Scratch(spark)).count() == 0
