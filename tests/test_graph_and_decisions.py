import pytest
from pyspark.sql import functions as F

from quillstone.operators import adjudicate as A
from quillstone.operators import disclosure as D
from quillstone.operators import evidence as V
from quillstone.operators import expansion as X
from quillstone.operators import registry as R
from quillstone.operators import temporal as G
from quillstone.session import Scratch
from tests.conftest import rows

NODE = "struct<name string, base string, place string, ids array<string>, aliases array<string>, addresses array<string>>"


def test_upward_walk_bounds_cycles_and_finds_ends(spark):
    edges = spark.createDataFrame([("a", "b", True, False), ("b", "c", True, True), ("a", "c", False, True), ("x", "y", True, False), ("y", "x", True, False)], "child string, parent string, direct boolean, ultimate boolean")
    start = spark.createDataFrame([(1, "a"), (2, "x"), (3, "lonely")], "query_id int, seed string")
    got = {(r["query_id"], r["node"]): (r["depth"], r["direct"], r["ultimate"], r["terminal"]) for r in R.walk_upward(start, edges, Scratch(spark)).collect()}
    assert got == {(1, "a"): (0, False, False, False), (1, "b"): (1, True, False, False), (1, "c"): (1, True, True, True), (2, "x"): (0, True, False, False), (2, "y"): (1, True, False, False), (3, "lonely"): (0, False, False, True)}


def resolve(spark, names, links, query):
    known = spark.createDataFrame([(k, n, n.lower(), s) for k, n, s in names], "lei string, legal_name string, name string, entity_status string")
    q = spark.createDataFrame([(1, query)], "query_id int, query string")
    found = R.seeds(known, q)
    edges = spark.createDataFrame(links, "child string, parent string, direct boolean, ultimate boolean")
    walks = R.walk_upward(found.select("query_id", F.col("lei").alias("seed")), edges, Scratch(spark))
    return R.decide_roots(R.root_scores(walks, known, q), found).first()


def test_roots(spark):
    names = [("G", "Acme Group", "ACTIVE"), ("a", "Acme One", "ACTIVE"), ("b", "Acme Two", "ACTIVE"), ("c", "Acmeist", "ACTIVE")]
    got = resolve(spark, names, [("a", "G", True, True), ("b", "G", True, True)], "acme")
    assert (got["lei"], got["status"], got["confidence"]) == ("G", "AUTO_RESOLVED", "HIGH")
    got = resolve(spark, [("h", "Hawkeye Innovations Ltd", "ACTIVE")], [], "hawkeye innovations")
    assert (got["lei"], got["status"], got["confidence"]) == ("h", "AUTO_RESOLVED", "MEDIUM")
    got = resolve(spark, [("h", "Hawk One", "ACTIVE"), ("i", "Hawk Two", "ACTIVE")], [], "hawk")
    assert (got["status"], got["confidence"]) == ("REVIEW_REQUIRED", "LOW")


def test_upsert_keeps_nulls_of_the_last_row(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, None), ("k", 2, "b"), (None, 4, "c")], "k string, p int, v string")
    assert rows(R.upsert_last(df, ["k"], "p")) == [("k", 3, None)]


def test_snapshots(spark):
    a, b = (spark.createDataFrame(x, "k string, v string") for x in ([("1", "x"), ("2", "x"), ("3", None)], [("2", "y"), ("3", None), ("4", "x")]))
    assert [(r[0], r[3]) for r in rows(R.compare_snapshots(a, b, "k", "v"))] == [("1", "REMOVED"), ("2", "CHANGED"), ("3", "SAME"), ("4", "ADDED")]


@pytest.mark.parametrize(
    "left, right, decision, reason",
    [
        (("acme", "acme", "US", ["1"], [], []), ("acme inc", "acme", "US", ["1"], [], []), "ACCEPT", "EXPLICIT_CONTINUITY_OR_IDENTIFIER"),
        (("acme", "acme", "US", ["1"], [], []), ("acme", "acme", "US", ["2"], [], []), "REJECT", "HARD_IDENTIFIER_CONFLICT"),
        (("acme", "acme", "US", [], ["old acme"], []), ("old acme", "old acme", "GB", [], [], []), "ACCEPT", "EXPLICIT_CONTINUITY_OR_IDENTIFIER"),
        (("acme", "acme", "US", [], [], []), ("acme", "acme", "GB", [], [], []), "REJECT", "DISTINCT_BY_JURISDICTION"),
        (("acme", "acme", "US", [], [], ["x"]), ("acme", "acme", "US", [], [], ["x"]), "ACCEPT", "SUFFICIENT_SIGNAL_AGREEMENT"),
        (("acme one", "acme one", "US", [], [], ["x"]), ("acme two", "acme two", "US", [], [], ["x"]), "REJECT", "INSUFFICIENT_IDENTITY_EVIDENCE"),
        (("acme", "acme", None, [], [], []), ("acme", "acme", None, [], [], []), "REVIEW", "AMBIGUOUS_SIGNAL_AGREEMENT"),
        ((None, None, None, None, None, None), ("acme", "acme", "US", ["1"], [], []), "REJECT", "INSUFFICIENT_IDENTITY_EVIDENCE"),
    ],
)
def test_decisions(spark, left, right, decision, reason):
    df = spark.createDataFrame([(left, right)], f"l {NODE}, r {NODE}")
    got = df.select(*(c.alias(n) for n, c in A.decide(A.policy("same_entity"), A.signals("l", "r")).items())).first()
    assert (got["decision"], got["reason"]) == (decision, reason)


def test_unknown_policy():
    with pytest.raises(KeyError):
        A.policy("nothing")


E = "entity string, domain string, provider string, evidence_type string, reference string, observed_value string, supports boolean"


@pytest.mark.parametrize(
    "kinds, confidence, disposition",
    [([("OFFICIAL_WEBSITE", True)], "HIGH", "AUTO"), ([("OFFICIAL_WEBSITE", True), ("RDAP_ORG", False)], "HIGH", "REJECT"), ([("RDAP_ORG", True), ("ASN_OWNERSHIP", True)], "MEDIUM", "REVIEW"), ([("RDAP_ORG", True), ("RDAP_ORG", True)], "LOW", "REVIEW"), ([("RDAP_ORG", None)], "UNKNOWN", "REVIEW"), ([("CONTRADICTORY_OWNERSHIP", None)], "HIGH", "REJECT")],
)
def test_evidence_policy(spark, kinds, confidence, disposition):
    df = spark.createDataFrame([("e", "d", "p", k, None, None, s) for k, s in kinds], E)
    got = V.evaluate(df).first()
    assert (got["confidence"], got["disposition"]) == (confidence, disposition)


def test_shared_domains_and_gaps(spark):
    c = spark.createDataFrame([("a", "d", "d", "HIGH", "AUTO"), ("b", "d", "d", "HIGH", "AUTO"), ("a", "f", "f", "HIGH", "AUTO")], "entity string, domain string, registrable string, confidence string, disposition string")
    assert [(r[0], r[1], r[3], r[4]) for r in rows(V.shared_domain_conflicts(c))] == [("a", "d", "MEDIUM", "REVIEW"), ("a", "f", "HIGH", "AUTO"), ("b", "d", "MEDIUM", "REVIEW")]
    o = spark.createDataFrame([("e", "d", "RDAP_WHOIS", "PROVIDED"), ("e", "d", "IP_ASN_OWNERSHIP", "INCONCLUSIVE"), ("e", "d", "TLS_CERTIFICATE", "MISSING")], "entity string, domain string, capability string, availability string")
    assert [(r[2], r[3], r[4]) for r in rows(V.gaps(o))] == [("HTTP_LEGAL_PRIVACY", 4, "NOT_PROVIDED"), ("IP_ASN_OWNERSHIP", 2, "INCONCLUSIVE"), ("TLS_CERTIFICATE", 3, "MARKED_MISSING")]


EVENTS = "event_id string, event_type string, day string, acquirer string, target string, subject string, object_entity string, result_entity string"


def test_agreement_closed_by_acquisition(spark):
    ev = spark.createDataFrame([("1", "AGREED_TO_ACQUIRE", "2022-05-26", "B", "V", None, None, None), ("2", "ACQUIRED", "2023-11-22", "B", "V", None, None, None), ("3", "MERGED_INTO", "2023-11-22", None, None, "V", "S", None)], EVENTS)
    e = {(r["edge_type"], r["edge_class"]): (r["day"], r["end_day"]) for r in G.edges(ev).collect()}
    assert e[("AGREED_TO_ACQUIRE", "EVENT")] == ("2022-05-26", "2023-11-22") and e[("CORPORATE_OWNS", "STATE")] == ("2023-11-22", None)
    n = {r["canonical_name"]: r for r in G.nodes(ev).collect()}
    assert n["V"]["observed_from"] == "2022-05-26" and n["V"]["existence_end"] == "2023-11-22" and n["V"]["role"] == "COMPANY" and n["S"]["role"] == "ENTITY"
    status = lambda day: {r["canonical_name"]: r["status"] for r in G.existence_as_of(G.nodes(ev), day).collect()}
    assert status("2023-11-21")["V"] == "UNKNOWN_START" and status("2023-11-22")["V"] == "ENDED"
    kinds = lambda day: {r["edge_type"] for r in G.edges_as_of(G.edges(ev), day).collect()}
    assert kinds("2023-01-01") == {"AGREED_TO_ACQUIRE"} and "CORPORATE_OWNS" in kinds("2024-01-01")


def test_disclosure_changes(spark):
    df = spark.createDataFrame([("c", "a1", "2001-01-01", "X Ltd", "GB"), ("c", "a1", "2001-01-01", "Y", "US"), ("c", "a2", "20020101", "X LTD.", "IE"), ("c", "a3", "January 1, 2003", "X Ltd", "IE"), ("c", "a3", "2003-01-01", "Y", "US"), ("c", "a3", None, "Z", "US"), (None, "a4", "2003-01-01", "Q", "US")], "cik string, accession string, filing_date string, subsidiary_name string, country string")
    a = D.appearances(df)
    assert [(r[1], r[2], r[4]) for r in rows(D.changes(a))] == [("x ltd", "2001-01-01", "JURISDICTION_TEXT_CHANGED"), ("x ltd", "2001-01-01", "NAME_TEXT_CHANGED"), ("x ltd", "2002-01-01", "NAME_TEXT_CHANGED"), ("y", "2001-01-01", "DISAPPEARED_FROM_DISCLOSURE"), ("y", "2002-01-01", "REAPPEARED_IN_DISCLOSURE")]
    t = {r["identity"]: r for r in D.timeline(a).collect()}
    assert t["y"]["n_missed"] == 1 and t["y"]["current"] and t["x ltd"]["n_missed"] == 0


def fact(kind, value, status="ACCEPTED", confidence="HIGH", pivot=True, seq=1, ident=None, subject=None, source="s"):
    return (kind, value, ident, subject, source, confidence, status, pivot, seq)


def test_rejection_stays_only_when_first(spark):
    df = spark.createDataFrame([fact("domain", "A.com", "REJECTED", seq=1), fact("DOMAIN", "a.com ", "ACCEPTED", seq=2), fact("domain", "b.com", "REVIEW", "LOW", seq=1), fact("domain", "b.com", "REJECTED", "HIGH", seq=2)], X.FACT)
    got = {r["value"].strip().lower(): (r["status"], r["confidence"], r["flagged"]) for r in X.merge(df).collect()}
    assert got == {"a.com": ("REJECTED", "HIGH", True), "b.com": ("REVIEW", "HIGH", False)}


def test_expansion_stops_and_isolates_errors(spark):
    edges = spark.createDataFrame([("B", "A", True, False), ("C", "B", True, False), ("D", "B", False, True)], "child string, parent string, direct boolean, ultimate boolean")
    seed = spark.createDataFrame([fact("ENTITY", "A", ident="A")], X.FACT)

    def broken(frontier, n):
        raise ValueError("no answer")

    facts, rounds, why = X.expand(seed, {"registry": X.related_entities(edges), "broken": broken})
    assert {(r["identifier"], r["status"]) for r in facts.collect()} == {("A", "ACCEPTED"), ("B", "ACCEPTED"), ("C", "ACCEPTED"), ("D", "REVIEW")}
    assert why == "NO_NEW_TRUSTED_PIVOTS" and all(r["errors"][0]["provider"] == "broken" for r in rounds)
    assert X.expand(seed, {"registry": X.related_entities(edges)}, 1)[2] == "MAX_ITERATIONS_REACHED"
    assert X.expand(spark.createDataFrame([fact("ENTITY", "A", "REVIEW")], X.FACT), {})[2] == "NO_PIVOT_ELIGIBLE_SEEDS"


def test_shared_domain_facts(spark):
    df = spark.createDataFrame([fact("DOMAIN", "a.com", ident="1"), fact("DOMAIN", "A.com", ident="2"), fact("DOMAIN", "b.com", ident="1")], X.FACT)
    assert [(r[1], r[6], r[7]) for r in rows(X.shared_domains(df))] == [("A.com", "REVIEW", False), ("a.com", "REVIEW", False), ("b.com", "ACCEPTED", True)]
