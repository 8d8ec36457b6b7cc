import random

import numpy as np
import pytest

from quillstone.llm import linkage as L
from quillstone.llm.names import parse_name, place_code, registration_key
from quillstone.session import Scratch
from tests.conftest import rows

LEI = "lei string, legal_name string, legal_jurisdiction string, legal_address_city string, registration_number string"
ADDR = "struct<lines array<string>, city string, region string, country string, postal_code string>"
CAND = f"candidate_id bigint, legal_name string, other_names array<string>, legal_address {ADDR}, jurisdiction string, registration_id string"


@pytest.mark.parametrize(
    "name, parsed",
    [
        ("Alpha Beta Technologies Gesellschaft mit beschraenkter Haftung", (("alpha", "beta"), "technologies", "", "gmbh")), ("The ALPHA-BETA Svcs Inc. /DE/", (("alpha", "beta"), "services", "", "inc")), ("Alpha Beta Finance Nr. 3, S.à r.l.", (("alpha", "beta"), "finance", "3", "sarl")),
        ("Alpha Beta Holdings II AB (publ)", (("alpha", "beta"), "holdings", "2", "ab")), ("Alpha Beta R&D Co., Ltd.", (("alpha", "beta"), "rnd", "", "coltd")), ("Alpha Beta R.E. LLC - Main", (("alpha", "beta"), "realestate", "", "llc")), ("", ((), "", "", "")),
    ],
)
def test_names(name, parsed):
    assert parse_name(name) == parsed


def test_codes():
    assert [place_code(x) for x in ("Deutschland", "Delaware, U.S.A.", "CA", "US-NY", None, "Atlantis")] == ["DE", "US-DE", "CA?", "US-NY", "", ""]
    assert [registration_key(x) for x in ("No. HRB 106 553", "hrb-106553", "0000000", "N/A", None, "001234567", "1234567")] == ["HRB106553", "HRB106553", "", "", "", "1234567", "1234567"]


def test_links(spark):
    at = lambda city: (["1 Main Street"], city, None, None, None)
    lei = [
        ("L1", "Alpha Beta Media GmbH", "DE", "Berlin", "HRB 123456"), (" l1 ", "Old Name Media GmbH", "DE", "Berlin", "HRB 123456"), ("L2", "Alpha Beta Pharma GmbH", "DE", "Berlin", "HRB 777777"), ("L3", "Alpha Beta Media S.A.", "ES", "Madrid", None),
        ("L4", "Gamma Delta Marine Ltd", "GB", "Leeds", None), ("L5", "Twin Star Foods Inc.", "US-NY", "Albany", None), ("L6", "Twin Star Foods Inc.", "US-CA", "Fresno", None), (None, "Nobody Special Ltd", "GB", "York", None), ("L7", None, None, None, None),
    ]
    cand = [
        (1, "ALPHA BETA MEDIA G.m.b.H.", [], at("Berlin"), "Germany", "hrb-123456"), (2, "Old Name Media", [], None, "DE", None), (3, "Alhpa Beta Media GmbH", None, at("Berlin"), "Deutschland", None), (4, "Gamma-Delta Marine Limited", [], None, "UK", None), (5, "Alpha Beta Media GmbH", [], at("Wien"), "DE", "HRB 555123"),
        (6, "not available", [], at("BERLIN"), "DE", "No. HRB 123456"), (7, "Alpha Beta Media Sociedad Anonima", [], None, "Spain", "n/a"), (8, None, None, None, None, None), (9, "Twin Star Foods Inc", [], at("Fresno"), "US", None), (10, "Gamma Delta Marine Ltd", [], None, "IE", None), (11, "New Brand Media GmbH", ["Alpha Beta Media GmbH"], at("Berlin"), "DE", None),
        (4, "Gamma-Delta Marine Limited", [], None, "UK", None),
    ]
    got = rows(L.found_links(spark.createDataFrame(lei, LEI), spark.createDataFrame(cand, CAND)))
    assert got == [("L1", 1), ("L1", 11), ("L1", 2), ("L1", 3), ("L1", 6), ("L3", 7), ("L4", 4), ("L6", 9)]


def test_confidence_is_a_share_and_exclusive(spark):
    lei = [("A", "Same Name Foods Ltd", "GB", None, None), ("B", "Same Name Foods Ltd", "GB", None, None)]
    got = L.link(spark.createDataFrame(lei, LEI), spark.createDataFrame([(1, "Same Name Foods Ltd", [], None, "GB", None)], CAND)).collect()
    assert len(got) == 2 and all(0 <= r["confidence"] <= 1 for r in got) and abs(got[0]["confidence"] - got[1]["confidence"]) < 1e-9
    alone = L.link(spark.createDataFrame(lei[:1], LEI), spark.createDataFrame([(1, "Same Name Foods Ltd", [], None, "GB", None)], CAND)).first()
    assert alone["confidence"] > got[0]["confidence"]


def test_empty(spark):
    assert L.link(spark.createDataFrame([], LEI), spark.createDataFrame([], CAND)).count() == 0


def _some_rules(n_records=400, n_leis=60):
    rng = random.Random(5)
    out = {}
    for c in range(n_records):
        for _ in range(rng.randrange(1, 5)):
            out[f"L{rng.randrange(n_leis)}", c] = (f"L{rng.randrange(n_leis)}", c, c % 37, *(round(rng.random(), 3) for _ in range(2)), *(rng.choice([0.0, 0.0, 0.3, 1.0]) for _ in range(3)))
    return list({r[:2]: r for r in out.values()}.values())


def _total(rows_, z):
    """The sum of all rules."""
    per = sum(L.W_NAME * max(r[3] - z[r[:2]], 0) ** 2 + L.W_NUMBER * max(r[4] - z[r[:2]], 0) ** 2 + sum(w * max(z[r[:2]] - 1 + d, 0) ** 2 for w, d in zip((L.W_PLACE_NOT, L.W_NUMBER_NOT, L.W_NAME_NOT), r[5:])) + L.W_PRIOR * z[r[:2]] ** 2 for r in rows_)
    by, sets = {}, {}
    for r in rows_:
        by.setdefault(r[1], []).append(z[r[:2]])
        sets.setdefault((r[0], r[2]), []).append(z[r[:2]])
    return per + sum(L.W_EXCLUSIVE * max(sum(v) - 1, 0) ** 2 for v in by.values()) + sum(L.W_TRANSITIVE * sum((x - sum(v) / len(v)) ** 2 for x in v) for v in sets.values())


def test_both_ways_reach_the_minimum(spark, monkeypatch):
    data = _some_rules()
    df = spark.createDataFrame(data, "lei string, candidate_id bigint, like bigint, " + ", ".join(f"{r} double" for r in L._RULES))
    found = []
    for large in (L.LARGE, 0):
        monkeypatch.setattr(L, "LARGE", large)
        monkeypatch.setattr(L, "PAIRS_AT_ONCE", 50)
        found.append({(r["lei"], r["candidate_id"]): r["confidence"] for r in L.infer(df, Scratch(spark)).collect()})
    assert found[0].keys() == found[1].keys() == {r[:2] for r in data}
    assert max(abs(found[0][k] - found[1][k]) for k in found[0]) < 4 * L.RESIDUAL
    least = _total(data, found[0])
    rng = random.Random(8)
    for k in rng.sample(sorted(found[0]), 150):  # no pair moved by itself is better
        for step in (0.02, -0.02):
            moved = found[0] | {k: min(1.0, max(0.0, found[0][k] + step))}
            assert _total(data, moved) > least - 1e-3
    assert all(0 <= v <= 1 for v in found[0].values())


def test_rounds_without_an_end_raise(monkeypatch):
    monkeypatch.setattr(L, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="not settled after 1 rounds"):
        L.solve(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), [np.array(x) for x in ([0.9, 0.2, 0.8, 0.7], [0.0] * 4, [0.0] * 4, [0.0] * 4, [0.1] * 4)])
