import random

from quillstone.llm import survivor as S
from tests.conftest import rows

RECORD = "candidate_id bigint, provider string, last_update_date string, legal_name string, registration_id string, entity_status string, legal_form string, entity_creation_date string"
TRUST = [("best", 1), ("good", 2), ("poor", 3)]


def run(spark, groups, records, trust=TRUST):
    return S.ranked_members(spark.createDataFrame(groups, "dup_group string, candidate_id bigint"), spark.createDataFrame(records, RECORD), spark.createDataFrame(trust, "provider string, trust_rank int"))


def test_found_origins_are_brute_force(spark):
    rng = random.Random(8)
    records, groups = [], []
    for i in range(400):
        v = lambda: rng.choice(["x", "y", None, "N/A", " ", "0000000", "tbd"])
        records.append((i, rng.choice(["BEST", "good ", "p-o-o-r", "nobody", None]), rng.choice(["2020-01-01", "20200102", "March 3, 2021", None, "n/a"]), v(), v(), v(), v(), rng.choice(["2001-01-01", "0000-00-00", None, "unknown"])))
        groups += [(f"g{rng.randrange(90)}", i)] * rng.choice([1, 1, 2])
    rank = {"best": 1, "good": 2, "poor": 3}
    day = {"2020-01-01": 1, "20200102": 2, "March 3, 2021": 3}
    ok = lambda v: v in ("x", "y", "2001-01-01")
    want = []
    for g in {g for g, _ in groups}:
        ids = {i for h, i in groups if h == g}
        for k, f in enumerate(S.FIELDS):
            have = [(day.get(r[2], 0), rank.get("".join(c for c in (r[1] or "").lower() if c.isalpha()), 99), r[0]) for r in records if r[0] in ids and ok(r[3 + k])]
            if len(have) >= 2:
                top = max(have)
                if [h[0] for h in have].count(top[0]) == 1 and top[1] <= min(h[1] for h in have):
                    want.append((g, f, top[2]))
    members = run(spark, groups, records)
    got = rows(members.transform(lambda m: S.field_survivors(m).where("n >= 2 and latest").select("dup_group", "field_name", "candidate_id")))
    assert got == sorted(want)


def test_survivors_take_each_field_from_the_most_trusted(spark):
    records = [(1, "good", "2022-01-01", "Full Name", "12345", "ACTIVE", None, None), (2, "best", "2020-01-01", "Name", None, "n.a.", "Ltd", "2000-01-01"), (3, "poor", None, None, None, None, None, None)]
    r = S.survivors(run(spark, [("g", 1), ("g", 2), ("g", 2), ("g", 3), ("h", 3), (None, 1), ("i", 99)], records)).where("dup_group = 'g'").first()
    assert (r["base_candidate_id"], r["n_records"], r["legal_name"], r["legal_name_from"], r["registration_id"], r["entity_status_from"], r["legal_form_from"]) == (2, 3, "Name", 2, "12345", 1, 2)
    empty = S.survivors(run(spark, [("h", 3)], records)).first()
    assert (empty["base_candidate_id"], empty["legal_name"]) == (3, None)


def test_ties_go_to_the_smaller_id_and_empty_tables(spark):
    same = [(i, "best", "2020-01-01", "N", None, None, None, None) for i in (7, 5)]
    r = S.field_survivors(run(spark, [("g", 7), ("g", 5)], same)).first()
    assert r["candidate_id"] == 5 and not r["latest"]
    assert S.survivors(run(spark, [], same)).count() == 0 and S.field_survivors(run(spark, [("g", 7)], [])).count() == 0
    assert S.field_survivors(run(spark, [("g", 7), ("g", 5)], same, [])).count() == 1
