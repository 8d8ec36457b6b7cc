import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.operators import intervals as I
from tests.conftest import rows

SCHEMA = "k string, s int, e int"


def brute(ivs):
    """Periods by days covered or touched."""
    out = []
    for s, e in sorted(set(ivs)):
        if out and s <= out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], e), True
        else:
            out.append([s, e, False])
    return [tuple(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 15)), max_size=25), st.randoms())
def test_map_is_brute_force_in_any_order(items, rng):
    ivs = [(s, s + n) for s, n in items]
    rng.shuffle(ivs)
    m = I.IntervalMap()
    for iv in ivs:
        m.insert(*iv)
    assert list(m.periods()) == brute(ivs)
    assert list(m.gaps()) == [(a[1], b[0]) for a, b in zip(brute(ivs), brute(ivs)[1:])]


def test_fusing_partial_maps_is_the_same():
    rng = random.Random(5)
    ivs = [(s := rng.randrange(300), s + rng.randrange(1, 9)) for _ in range(60)]
    total = I.IntervalMap()
    for part in (ivs[:20], ivs[20:41], ivs[41:]):
        m = I.IntervalMap()
        for iv in part:
            m.insert(*iv)
        for p in m.periods():
            total.insert(*p)
    assert list(total.periods()) == brute(ivs)


def test_periods_gaps_and_a_hot_key(spark):
    rng = random.Random(1)
    data = [("a", 0, 10), ("a", 5, 12), ("a", 12, 15), ("a", 20, 30), ("b", 1, 2), ("b", 1, 2), (None, 1, 2), ("c", 5, 5), ("c", None, 9), ("c", 3, None)]
    hot = [("h", s := rng.randrange(40_000), s + rng.randrange(1, 4)) for _ in range(20_000)]
    got = rows(I.periods_and_gaps(spark.createDataFrame(data + hot, SCHEMA), "k", "s", "e"))
    small = [r for r in got if r[0] != "h"]
    assert small == [("a", "GAP", 15, 20, None), ("a", "PERIOD", 0, 15, True), ("a", "PERIOD", 20, 30, False), ("b", "PERIOD", 1, 2, False)]
    assert sorted((r[2], r[3], r[4]) for r in got if r[0] == "h" and r[1] == "PERIOD") == brute([x[1:] for x in hot])


def test_empty_and_clashing_columns(spark):
    assert I.periods_and_gaps(spark.createDataFrame([], SCHEMA), "k", "s", "e").count() == 0
    df = spark.createDataFrame([("a", 1, 3, "x", 7, True)], "k string, s int, e int, key string, start int, many boolean")
    assert rows(I.periods_and_gaps(df, "k", "s", "e")) == [("a", "PERIOD", 1, 3, False)]


def test_found_periods_reads_dates_as_written(spark):
    r = "IS_DIRECTLY_CONSOLIDATED_BY"
    df = spark.createDataFrame(
        [(" abc", r, "2010-01-01", "2012-01-01T00:00:00Z"), ("ABC", r, "20110601", "2013-01-01 "), ("abc ", r, "March 1, 2015", None), ("ABC", r, "01-Feb-2016", "9999-12-31"), ("ABC", "OTHER", "1990-01-01", None), ("ABC", r, "nonsense", None), ("ABC", r, None, "2020-01-01"), ("D", r, "2013-02-30", "2014-01-01"), ("E", r, "2014-01-01", " ")],
        "child_lei string, relationship_type string, relationship_start string, relationship_end string",
    )
    assert rows(I.found_periods(df)) == [("ABC", "GAP", "2013-01-01", "2015-03-01"), ("ABC", "PERIOD", "2010-01-01", "2013-01-01"), ("ABC", "PERIOD", "2015-03-01", "9999-12-31")]
