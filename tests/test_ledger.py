import random

from quillstone.operators import ledger as L
from tests.conftest import rows

SCHEMA = "entity_id string, attribute_name string, value string, valid_day int, instant bigint, recorded_us bigint, ident string"


def brute(updates):
    """Rows on record of one key by replaying everything that was recorded up to each time."""
    times = sorted({u[3] for u in updates})
    snaps = []
    for t in times:
        day = {}
        for v, d, i, r, x in updates:
            if r <= t and (d not in day or (i, r, x) > day[d][0]):
                day[d] = ((i, r, x), v)
        days = sorted(day)
        snaps.append({(d, days[k + 1] if k + 1 < len(days) else L.OPEN_END, L_key(day[d][1])) for k, d in enumerate(days)})
    return times, snaps


def L_key(v):
    return "".join(v.split()).upper().lower()


def test_ledger_at_every_recording_time_is_brute_force(spark):
    rng = random.Random(3)
    data, want = [], {}
    for k in range(12):
        ups = [(rng.choice(["A", "a ", "B", "C"]), rng.randrange(0, 9_000), rng.randrange(3), rng.randrange(1, 40), str(n)) for n in range(rng.randrange(1, 25))]
        want[f"e{k}"] = brute(ups)
        data += [(f"e{k}", "name", v, d, i, r, x) for v, d, i, r, x in ups]
    got = rows(L.ledger(spark.createDataFrame(data, SCHEMA)))
    for e, (times, snaps) in want.items():
        mine = [r for r in got if r[0] == e]
        for t, snap in zip(times, snaps):
            assert {(r[4], r[5], r[3]) for r in mine if r[6] <= t < r[7]} == snap
            assert len([1 for r in mine if r[6] <= t < r[7]]) == len(snap)


def test_versions(spark):
    data = [
        ("x", "n", "Old", 10, 1, 5, "1"), ("x", "n", "OLD ", 20, 1, 6, "2"), ("x", "n", "New", 30, 1, 7, "3"), ("x", "n", "Old", 40, 1, 8, "4"), ("x", "n", "Late", 15, 1, 99, "5"), ("x", "n", None, 50, 1, 9, "6"), ("x", "n", " ", 60, 1, 9, "7"), ("x", "n", "Undated", None, 1, 9, "8"),
        (None, "n", "v", 1, 1, 1, "9"), ("y", "n", "one", 1, 1, 1, "a"), ("y", "n", "one", 1, 1, 1, "a"), ("z", None, "v", 1, None, None, None), ("w", "n", "a", 5, None, None, None), ("w", "n", "b", 5, 7, None, None), ("w", "n", "c", 9, None, 3, None),
    ]
    got = rows(L.versions(L.sweep(spark.createDataFrame(data, SCHEMA))))
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [("w", "b", 5, 9), ("w", "c", 9, L.OPEN_END), ("x", "Late", 15, 20), ("x", "New", 30, 40), ("x", "OLD ", 20, 30), ("x", "Old", 10, 15), ("x", "Old", 40, L.OPEN_END), ("y", "one", 1, L.OPEN_END)]


def test_empty_and_extra_columns(spark):
    assert L.ledger(spark.createDataFrame([], SCHEMA)).count() == 0
    assert L.versions(L.sweep(spark.createDataFrame([], SCHEMA))).count() == 0
    df = spark.createDataFrame([("x", "n", "v", 3, 1, 1, "i", "clash", 4)], SCHEMA + ", value_key string, stretch int")
    assert L.sweep(df).count() == 2  # the row and the stretch's first day


def test_found_versions_takes_days_in_utc_and_as_written(spark):
    import datetime as dt

    t = dt.datetime(2020, 1, 1)
    lei = spark.createDataFrame([(1, t, " l1", "N", "ACTIVE", "Rom", "2019-12-31T23:30:00-02:00"), (2, t, "L1", "M", "Active", "ROM", "2020-02-01 10:00:00"), (3, t, "L1", None, None, None, "n/a")], "record_id bigint, delivered_at timestamp, lei string, legal_name string, entity_status string, legal_address_city string, last_update_date string")
    states = spark.createDataFrame([("e1", " N1", "FORM", "May 5, 2001", ("a", "AG"), t), ("e2", "n1", "FORM", "2002-01-01T23:00:00-05:00", ("a", "KG"), t), ("e3", "n1", "FORM", "undated", ("a", "XX"), t)], "source_event_id string, node_id string, state_type string, effective_date string, state_value struct<from_value string, to_value string>, recorded_at timestamp")
    assert rows(L.found_versions(lei, states)) == [("L1", "legal_name", "2020-01-01", "2020-02-01"), ("L1", "legal_name", "2020-02-01", "9999-12-31"), ("n1", "FORM", "2001-05-05", "2002-01-01"), ("n1", "FORM", "2002-01-01", "9999-12-31")]
