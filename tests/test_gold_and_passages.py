import random

from pyspark.sql import functions as F

from quillstone.operators import gold as G
from quillstone.operators import passages as P
from tests.conftest import rows

EVENT = "company string, counterparty string, event_type string, status string, seq bigint"


def brute(gold, system):
    left, out = list(system), []
    for g in sorted(gold, key=lambda r: r[4]):
        mine = sorted((s for s in left if s[0] == g[0] and s[1] == g[1]), key=lambda r: r[4])
        typed = [s for s in mine if s[2] in G.ALIKE_TYPES.get(g[2], (g[2],))]
        exact = [s for s in typed if s[3] == g[3]]
        pick = (exact or typed or mine or [None])[0]
        out.append((g[0], g[5], g[4], "NOT_DISCOVERED" if not mine else "EVENT_TYPE_MISMATCH" if not typed else "STATUS_MISMATCH" if not exact else "NONE", pick and pick[4]))
        if pick:
            left.remove(pick)
    return sorted(out), sorted(left)


def test_matching_uses_events_up(spark):
    rng = random.Random(1)
    some = lambda i: (rng.choice("ab"), rng.choice(["acme", "beta", "gamma"]), rng.choice(["ACQUIRED", "MERGED_INTO", "RENAMED_TO"]), rng.choice(["COMPLETED", "PROPOSED"]), i)
    gold, system = [(*some(i), f"g{i}") for i in range(40)], [some(i) for i in range(45)]
    matched, unused = G.match_events(spark.createDataFrame(gold, EVENT + ", gold_id string"), spark.createDataFrame(system, EVENT))
    want, left = brute(gold, system)
    assert sorted(tuple(r) for r in matched.collect()) == want and sorted(tuple(r[c] for c in ("company", "counterparty", "event_type", "status", "seq")) for r in unused.collect()) == left
    assert {r["stage"]: r["n"] for r in G.recall(matched).collect()} == {s: sum(1 for x in want if x[3] == s) for s in {x[3] for x in want}}
    none = spark.createDataFrame([], EVENT)
    assert {r["stage"] for r in G.match_events(spark.createDataFrame(gold, EVENT + ", gold_id string"), none)[0].collect()} == {"NOT_DISCOVERED"}


def test_a_company_under_all_its_names(spark):
    events = spark.createDataFrame([("Acme Inc", "Beta", "ACQUIRED", "COMPLETED"), ("Gamma", "ACME Corporation", "MERGED_INTO", "COMPLETED"), ("Old Acme Ltd", "beta inc", "ACQUIRED", "COMPLETED"), ("Acme", "Old Acme", "RENAMED_TO", "COMPLETED"), ("x", "y", "ACQUIRED", "COMPLETED")], "subject string, object string, event_type string, status string")
    names = spark.createDataFrame([("c", "Acme"), ("c", "Old Acme"), ("c", "Acme Inc.")], "company string, name string")
    assert rows(G.by_pivot(events, names)) == [("c", "Beta", "ACQUIRED", "COMPLETED"), ("c", "Gamma", "MERGED_INTO", "COMPLETED")]


def test_funnel(spark):
    gold = spark.createDataFrame([("c", "1", ["Beta Works"], "ACQUIRED", "COMPLETED"), ("c", "2", ["Gamma"], "ACQUIRED", "COMPLETED"), ("c", "3", ["Nowhere"], None, None), ("d", "4", ["Beta Works"], "ACQUIRED", None)], "company string, gold_id string, names array<string>, event_type string, status string")
    texts = spark.createDataFrame([("c", "we bought BETA WORKS and Gamma"), ("c", None)], "company string, text string")
    sections = spark.createDataFrame([("c", "we bought beta works")], "company string, text string")
    orgs = spark.createDataFrame([("c", "Beta Works, Inc.")], "company string, name string")
    events = spark.createDataFrame([("c", "x", "Beta Works", "acquired", "completed")], "company string, subject string, object string, event_type string, status string")
    got = {r["gold_id"]: (r["deepest_stage"], r["failure"]) for r in G.funnel(gold, texts, sections, orgs, events, spark.createDataFrame([], "company string, name string")).collect()}
    assert got == {"1": ("EVENT_EXTRACTED", "CANDIDATE_EMISSION_MISS"), "2": ("RELEVANT_TEXT_PRESENT", "LOCATOR_MISS"), "3": ("FILINGS_RETRIEVED", "DISCLOSURE_NOT_IN_RETRIEVED_CORPUS"), "4": ("CIK_RESOLVED", "DISCLOSURE_NOT_IN_RETRIEVED_CORPUS")}


def test_loose_identity(spark):
    df = spark.createDataFrame([("sgnl", "SGNL AI, Inc."), ("sgnl ai", "sgnl"), ("sgnlx", "sgnl"), ("", "sgnl"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(G.loosely_same(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, False]


def test_passages_around_names_and_terms(spark):
    text = "One. Two names Acme here. Three. Four. Five has acme too. Six. Seven. Eight. Acme (again)."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    names = spark.createDataFrame([(1, "n", "ACME"), (1, "m", "absent"), (3, "n", "acme"), (1, "o", " ")], "doc_id bigint, name_id string, name string")
    assert [(r["first"], r["last"], r["passage"]) for r in P.name_passages(docs, "text", names).orderBy("first").collect()] == [(1, 6, "One. Two names Acme here. Three. Four. Five has acme too. Six."), (8, 9, "Eight. Acme (again).")]
    terms = spark.createDataFrame([(1, "acme"), (1, "Five, has"), (1, "nam"), (1, "..")], "doc_id bigint, term string")
    assert [(r["term"], text[r["start"] : r["end"]]) for r in P.term_hits(docs, "text", terms).orderBy("start").collect()] == [("acme", "Acme"), ("Five, has", "Five has"), ("acme", "acme"), ("acme", "Acme")]
    got = P.term_passages(docs, "text", terms, 10).orderBy("start").collect()
    assert [(r["start"], r["end"], r["terms"]) for r in got] == [(5, 29, ["acme"]), (29, 67, ["Five, has", "acme"]), (67, 91, ["acme"])][: len(got)] or all(text[r["start"] : r["end"]].strip() == r["passage"] for r in got)
    regions = spark.createDataFrame([(1, "xx one.  TWO names acme here. three. four. five has acme too. six. yy")], "doc_id bigint, region string")
    assert [r["in_region"] for r in P.in_region(P.name_passages(docs, "text", names), regions).orderBy("first").collect()] == [True, False]


def test_shells_and_their_parents(spark):
    text = "Merger Sub Inc., a wholly owned subsidiary of Big Parent, Inc. and others, met Target LLC. It will become a subsidiary of Big Parent, Inc. later."
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    names = spark.createDataFrame([(1, x) for x in ("Merger Sub Inc.", "Target LLC", "Big Parent", "Big Parent, Inc.")], "doc_id bigint, name string")
    got = P.ordered_names(docs, "text", names.where("name <> 'Big Parent'"))
    assert [(r["name"], r["is_shell"]) for r in got.orderBy("position").collect()] == [("Merger Sub Inc.", True), ("Big Parent, Inc.", False), ("Target LLC", False)]
    shells = got.withColumn("context", F.when(F.col("is_shell"), F.lit(", a wholly owned subsidiary of Big Parent, Inc. and others")).otherwise(F.col("context")))
    assert rows(P.parents_named(shells, names)) == [(1, "Merger Sub Inc.", "Big Parent, Inc.")]


def test_survivors_get_their_short_names_round_by_round(spark):
    text = 'Alpha continuing as the surviving corporation (the "Beta"), then Beta continuing as the surviving company (the “Gamma”). Nobody continuing as the surviving company (the "Lost").'
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    known = spark.createDataFrame([(1, "Alpha", "Alpha Works Inc.")], "doc_id bigint, alias string, name string")
    assert rows(P.survivor_aliases(docs, "text", known)) == [(1, "Alpha", "Alpha Works Inc."), (1, "Beta", "Alpha Works Inc."), (1, "Gamma", "Alpha Works Inc.")]


def test_explicit_merger(spark):
    docs = spark.createDataFrame([(1, "In short, Old Works was merged with and into New Works LLC effective March 3, 2020."), (2, "Old Works was merged into someone.")], "doc_id bigint, text string")
    subjects = spark.createDataFrame([(1, "old works"), (1, "other"), (2, "old works")], "doc_id bigint, subject string")
    assert [(r["subject"], r["survivor"], r["event_day"]) for r in P.explicit_mergers(docs, "text", subjects).collect()] == [("old works", "New Works LLC", "2020-03-03")]


def test_verdicts(spark):
    df = spark.createDataFrame([(False, 1, 2.0, 1, True, 1, True), (True, 0, 0.0, 0, False, 0, False), (True, 2, 1.75, 2, False, 0, False), (True, 1, 0.5, 1, False, 0, False), (True, 1, 2.0, 1, True, 0, False), (True, 1, 2.0, 1, True, 1, False), (True, 1, 2.0, 1, True, 1, True)], "r boolean, s int, w double, p int, k boolean, e int, m boolean")
    got = [r[0] for r in df.select(P.verdict(F.col("r"), F.col("s"), F.col("w"), 1.5, F.col("p"), F.col("k"), F.col("e"), F.col("m"))).collect()]
    assert got == ["NOT_IN_REGION", "ENTITY_NOT_SEEN", "ENTITY_SPLIT_VOTE", "ENTITY_BELOW_THRESHOLD", "EVENT_GRAMMAR_MISS", "EVENT_TYPE_MISMATCH", "FOUND"]
