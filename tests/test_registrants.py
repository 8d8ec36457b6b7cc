from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillstone.operators import registrants as R
from quillstone.plans import decision_queries

LEFT, RIGHT = "resource string, names array<string>, address string, country string", "entity_id string, names array<string>, address string, jurisdiction string"


def test_ratio_depends_on_the_order(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x"), ("", "x"), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(R.sequence_ratio(F.col("a"), F.col("b"))).collect()] == [0.25, 0.5, 0.0, 0.0, 1.0]


@pytest.mark.parametrize(
    "names, address, country, decision, evidence",
    [
        (["Acme Works Inc."], None, "US", "strong_candidate", ["RDAP_ATTRIBUTION_MATCH"]), (["Acme Works"], None, "FR", "reject", ["RDAP_ATTRIBUTION_CONFLICT"]), (["ACME Works, LLC"], "1 Long Street, Town", None, "strong_candidate", []),
        (["Acme Works"], None, None, "review", []), (["Acme Words of Art"], None, None, "weak_candidate", []), (["Acme and a very much longer name"], None, None, "reject", []),
    ],
)
def test_decisions(spark, names, address, country, decision, evidence):
    m = R.match(spark.createDataFrame([("d", names, address, country)], LEFT), spark.createDataFrame([("e", ["Acme Works Inc", None], "1 Long St Town", "US-DE")], RIGHT))
    assert [r["decision"] for r in m.collect()] == [decision]
    assert [r["evidence_type"] for r in R.attribution_evidence(m).collect()] == evidence


def test_best_and_empty(spark):
    left = spark.createDataFrame([("d", ["Acme Works"], None, None), ("x", None, None, None)], LEFT)
    right = spark.createDataFrame([(f"e{i}", [f"Acme Works {i}"], None, None) for i in range(5)] + [("f", None, None, None)], RIGHT)
    assert [r["entity_id"] for r in R.match(left, right, 2).collect()] == ["e0", "e1"]
    assert R.match(left.limit(0), right).count() == 0


def exchanged(df) -> int:
    """Rows that the exchanges of the plan wrote, once it has run."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            n += p.metrics().apply("shuffleRecordsWritten").value()
        below = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        todo += below
    return n


def many(spark, n, m):
    """Registrants and entities that all share two words in a row, and some their first."""
    left = [(f"d{i}", [f"Word{i % 7} Research and Development Inc", f"Other{i}"], f"{i} Long Street", ("US", "FR", None)[i % 3]) for i in range(n)]
    right = [(f"e{i}", [f"Word{i % 9} Place{i} Research and Development", None], f"{i} Long St", ("US-DE", "FR", "")[i % 3]) for i in range(m)]
    return spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)


def saved(spark, at, n, m):
    """Tables of the queries with n registrants and m entities of one key."""
    address = "struct<lines: array<string>, city: string>"
    spark.createDataFrame([(i, "rdap", f"Word{i} Real Estate", [], (["1 Long St"], "Town"), ("US", "FR", None)[i % 3]) for i in range(n)], f"candidate_id bigint, provider string, legal_name string, other_names array<string>, legal_address {address}, jurisdiction string").write.parquet(f"{at}/entity_candidates.parquet")
    spark.createDataFrame([(i, f"LEI{i:05}", f"Wards{i} Real Estate", ("US", "FR")[i % 2], "ACTIVE") for i in range(m)], "record_id bigint, lei string, legal_name string, legal_jurisdiction string, entity_status string").write.parquet(f"{at}/lei_entities.parquet")
    return str(at)


def brute(a, b):
    return max(SequenceMatcher(None, x, y).ratio() for x in a for y in b)


def test_evidence_exchanges_names_not_pairs(spark, tmp_path):
    d = saved(spark, tmp_path, 60, 100)
    df = decision_queries.registrant_evidence(spark, d)
    assert exchanged(df) < 60 * 100 / 3
    conflicts = sum(brute([f"word{i} real estate"], [f"wards{j} real estate"]) >= 0.65 for i in range(60) for j in range(100) if i % 3 < 2 and i % 3 != j % 2)
    matches = sum(brute([f"word{i} real estate"], [f"wards{j} real estate"]) >= 0.9 for i in range(60) for j in range(100) if i % 3 == j % 2)
    assert {tuple(r) for r in df.collect()} == {("RDAP_ATTRIBUTION_CONFLICT", False, conflicts), ("RDAP_ATTRIBUTION_MATCH", True, matches)} and matches


def test_matches_exchange_names_not_pairs(spark, tmp_path):
    df = decision_queries.registrant_matches(spark, saved(spark, tmp_path, 60, 100))
    assert exchanged(df) < 60 * 100 / 3
    score = {(str(i), f"LEI{j:05}"): brute([f"word{i} real estate"], [f"wards{j} real estate"]) for i in range(60) for j in range(100) if i % 3 == 2 or i % 3 == j % 2}
    assert {(r["resource"], r["entity_id"]): r["name_score"] for r in df.collect()} == {k: round(v, 6) for k, v in score.items() if v >= 0.65}


def test_all_pairs_once_however_they_are_dealt(spark, monkeypatch):
    left, right = many(spark, 40, 60)
    whole = R.match(left, right)
    want = sorted(map(tuple, whole.collect()), key=str)
    assert len(want) == len({w[:2] for w in want}) == 40 * 60
    name = lambda i: [f"word{i % 7} research and development", f"other{i}"]
    assert all(w[2] == brute(name(int(w[0][1:])), [f"word{int(w[1][1:]) % 9} place{w[1][1:]} research and development"]) for w in want)
    assert {w[4] for w in want} == {None, 0.0, 1.0} and all((w[3] == 1) == (w[0][1:] == w[1][1:]) for w in want)
    monkeypatch.setattr(R, "HOT_ROWS", 7)
    monkeypatch.setattr(R, "CHUNK", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        assert sorted(map(tuple, R.match(left, right).collect()), key=str) == want
        least = {1.0: 0.8, 0.0: 0.85}
        assert sorted(map(tuple, R.match(left, right, least=least).collect()), key=str) == [w for w in want if w[4] in least and w[2] >= least[w[4]]]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_and_unnamed_rows(spark):
    left = spark.createDataFrame([("d", ["Acme Works"], None, None), ("d", ["Acme Wares"], None, None), (None, ["Acme Works"], None, None)], LEFT)
    right = spark.createDataFrame([("e", ["Acme Wares Ltd"], None, None), (None, ["Acme Works"], None, None)], RIGHT)
    assert [tuple(r)[:3] for r in R.match(left, right).collect()] == [("d", "e", 1.0)]
