import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import packing as P
from tests.conftest import rows


def naive(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits)[1]] -= s
        else:
            room.append(capacity - s)
    return sorted(room)


def filled(sizes, capacity, plan):
    order, room, at = sorted(sizes, reverse=True), {}, 0
    for first, n, each, container in plan:
        assert first == at
        for j in range(n):
            b = container + j // each
            room[b] = room.get(b, capacity) - order[at]
            at += 1
    assert at == len(order)
    return sorted(room.values())


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 70).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(0, c), max_size=80))))
def test_plan_is_item_by_item_best_fit_decreasing(case):
    capacity, sizes = case
    assert filled(sizes, capacity, P.best_fit_plan(Counter(sizes), capacity)) == naive(sizes, capacity)


def test_steps_stay_within_their_bound():
    rng = random.Random(1)
    for capacity in (64, 512):
        sizes = Counter(rng.choice([rng.randint(1, capacity), rng.randint(1, 9)]) for _ in range(50_000))
        assert len(P.best_fit_plan(sizes, capacity)) < 40 * capacity


def test_tree_finds_the_tightest():
    t, held = P.RemainingTree(37), Counter()
    rng = random.Random(3)
    for _ in range(500):
        r = rng.randint(0, 37)
        n = 1 if not held[r] or rng.random() < 0.6 else -1
        held[r] += n
        t.add(r, n)
        s = rng.randint(0, 40)
        assert t.tightest(s) == min((x for x in held if held[x] and x >= s), default=None)


def test_pack(spark):
    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 2, 5, 9, 10, 11, 25, 30]) for _ in range(300)]
    items = spark.createDataFrame([(i, n, 1, "k") for i, n in enumerate(sizes)] + [(None, 4, 1, "k"), (7, None, 1, "k"), (3, sizes[3], 1, "k")], "doc_id bigint, n_tokens int, number int, kind string")
    got = rows(P.pack(items, {"a": 10, "b": 25}))
    for kind, cap in (("a", 10), ("b", 25)):
        mine = [r for r in got if r[0] == kind]
        room = Counter()
        for _, container, doc, part, start, n in mine:
            room[container] += n
            assert n <= cap and start == part * cap
        assert max(room.values()) <= cap and set(room) == set(range(len(room)))
        assert sum(room.values()) == sum(sizes) + 4 + sizes[3]
        pieces = [min(cap, max(n - p * cap, 0)) for n in [*sizes, 4, 0, sizes[3]] for p in range(max(1, -(-n // cap)))]
        assert sorted(cap - v for v in room.values()) == naive(pieces, cap)
        assert all(len([1 for r in mine if r[2] == i]) == max(1, -(-n // cap)) for i, n in enumerate(sizes) if i not in (3, 7))
    assert rows(P.fill_report(P.pack(items, {"a": 10}), {"a": 10}))[0][0] == "a"


def test_empty_and_bad(spark):
    items = spark.createDataFrame([], "doc_id bigint, n_tokens int")
    assert P.pack(items, {"a": 4}).count() == 0 and P.pack(items, {}).count() == 0
    with pytest.raises(ValueError):
        P.pack(items, {"a": 0})


def test_capacities_are_whole_or_raise(spark, monkeypatch):
    specs = lambda *r: spark.createDataFrame(list(r), "container_kind string, capacity_tokens int")
    assert P.capacities_of(specs(("a", 4), ("a", 4), ("b", 5), (None, 3), ("c", None))) == {"a": 4, "b": 5}
    with pytest.raises(ValueError, match="more than one capacity for a"):
        P.capacities_of(specs(("a", 4), ("a", 5)))
    monkeypatch.setattr(P, "MAX_KINDS", 1)
    with pytest.raises(ValueError, match="more than 1 kinds"):
        P.capacities_of(specs(("a", 4), ("b", 5)))


def test_bounds_of_the_plan_raise(spark, monkeypatch):
    items = spark.createDataFrame([(1, 3)], "doc_id bigint, n_tokens int")
    with pytest.raises(ValueError):
        P.pack(items, {"a": P.MAX_CAPACITY, "b": 1})
    monkeypatch.setattr(P, "MAX_PLAN_BYTES", 1)
    with pytest.raises(ValueError, match="one by one"):
        P.pack(items, {"a": 4})
