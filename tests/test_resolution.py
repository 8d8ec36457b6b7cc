import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import bridges as B
from quillstone.operators import expansion as X
from quillstone.operators import resolution as R
from quillstone.operators import temporal as G
from tests.conftest import rows

RECORD = "pos bigint, node_id string, name string, name_normalized string, jurisdiction string, aliases array<string>, provider_id string, is_root boolean"


def groups_by_hand(records):
    """First positions of what exact names and former names in one place join, by repeated union."""
    up = {r[0]: r[0] for r in records}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a in records:
        for b in records:
            if a[4] == b[4] and (a[3] == b[3] or b[3] in a[5] or a[3] in b[5]):
                x, y = sorted((top(a[0]), top(b[0])))
                up[y] = x
    return {v: top(v) for v in up}


def test_records_merge_as_unions_do(spark):
    rng = random.Random(2)
    data = [(i, f"n{i}", f"N{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.choice(["DE", "US", None]), [f"n{rng.randrange(40)}" for _ in range(rng.randrange(3))], f"p{i}", i == 0) for i in range(60)]
    df = spark.createDataFrame(data, RECORD)
    merged = R.merge_records(df)
    want = groups_by_hand(data)
    assert {r["pos"]: r["into"] for r in merged.collect()} == want
    nodes = R.resolved_nodes(df, merged)
    assert nodes.count() == len(set(want.values())) and nodes.agg(F.sum("n_records")).first()[0] == 60
    assert R.merge_records(df.where("pos < 0")).count() == 0


def test_no_place_is_a_place_and_two_former_names_are_no_match(spark):
    data = [(1, "a", "A", "acme", None, [], "p", True), (2, "b", "A", "acme", None, [], "q", False), (3, "c", "A", "acme", "", [], "r", False), (4, "d", "X", "x", "DE", ["old"], "s", False), (5, "e", "Y", "y", "DE", ["old"], "t", False), (6, "f", "Old", "old", "US", [], "u", False)]
    got = {r["pos"]: (r["into"], r["reason"]) for r in R.merge_records(spark.createDataFrame(data, RECORD)).collect()}
    assert got == {1: (1, None), 2: (1, "exact_identity"), 3: (3, None), 4: (4, None), 5: (5, None), 6: (6, None)}


def test_resolution_links_seeds_and_packets(spark):
    data = [(1, "root", "Acme Inc", "acme inc", "US", [], "p1", True), (2, "k1", "Acme One Ltd", "acme one ltd", "GB", ["acme uno"], "p2", False), (3, "k2", "Acme Uno", "acme uno", "GB", [], "p3", False), (4, "k3", "Acme One LLC", "acme one llc", "US", [], "p4", False)]
    links = spark.createDataFrame([("root", "HAS_SUBSIDIARY", "k1", "edgar", "d1"), ("k2", "SUBSIDIARY_OF", "root", "gleif", "d1"), ("k3", "IS_DIRECTLY_CONSOLIDATED_BY", "root", "gleif", "d2"), ("root", "SELF_OR_ULTIMATE_PARENT", "root", "edgar", "d1")], "subject string, predicate string, object string, provider string, source string")
    nodes, edges, review, counts = R.resolve(spark.createDataFrame(data, RECORD), links)
    assert counts == {"nodes": 3, "links": 3, "merged": 1, "review": 2}
    assert sorted((r["subject"], r["predicate"], r["object"]) for r in edges.collect()) == [("k1", "SUBSIDIARY_OF", "root"), ("k1", "SUBSIDIARY_OF", "root"), ("k3", "IS_DIRECTLY_CONSOLIDATED_BY", "root")]
    standing = edges.withColumns({"subject_standing": F.when(F.col("provider") == "gleif", F.when(F.col("subject") == "k1", "UNRESOLVED_RETRY").otherwise("RESOLVED")), "object_standing": F.lit(None).cast("string")})
    got = {r["node_id"]: (r["providers"], r["worst"], r["disposition"], r["n_links"]) for r in R.seeds(nodes, standing).collect()}
    assert got == {"k1": (["edgar", "gleif"], "UNRESOLVED_RETRY", "REVIEW_REQUIRED", 2), "k3": (["gleif"], "RESOLVED", "SAFE_WITH_CONTEXT", 1)}
    pairs = spark.createDataFrame([("SAME_ENTITY", "k1", "k3", "REVIEW", "x"), ("SAME_ENTITY", "k1", "gone", "REVIEW", "x")], "policy string, left_id string, right_id string, decision string, reason string")
    one, other = R.packets(pairs, nodes, edges.select("subject", "predicate", "object", "source")).orderBy(F.desc("both_have_parents")).collect()
    assert (one["shared_parents"], one["same_source"], one["both_have_parents"], len(one["evidence"])) == (["root"], False, True, 4) and len({e["evidence_id"] for e in one["evidence"]}) == 4
    assert other["right"] is None and other["shared_parents"] == []
    again = R.packets(pairs, nodes, edges.select("subject", "predicate", "object", "source")).where("both_have_parents").first()
    assert again["packet_id"] == one["packet_id"] and again["evidence"] == one["evidence"]


def test_only_match_raises(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("a", 1)], "k string, v int")
    ask = lambda *k: R.only_match(spark.createDataFrame([(x,) for x in k], "k string"), known, "k", "v").collect()
    assert [tuple(r) for r in ask("a")] == [("a", 1)]
    for bad, why in (("c", "unknown: c"), ("b", "ambiguous: b"), (None, "unknown: null")):
        with pytest.raises(Exception, match=why):
            ask("a", bad)


FACT = "fact_type string, value string, identifier string, subject string, source string, confidence string, status string, pivot_eligible boolean, seq bigint"


def test_providers_feed_the_expansion(spark):
    seeds = spark.createDataFrame([("COMPANY", "Acme Inc", None, "Acme", "study", "HIGH", "ACCEPTED", True, 1)], FACT)
    events = spark.createDataFrame([("Acme Inc.", "REGISTRANT_SELF_REFERENCE", "Beta LLC", "ACQUIRED", "COMPLETED", "R", "d1"), ("Acme, Inc", "BETA", "Acme Inc", "MERGED_INTO", "COMPLETED", "R", "d2"), ("Acme Inc", "Gamma", "Delta", "ACQUIRED", "COMPLETED", "R", "d3"), ("Other", "Other", "Zeta", "ACQUIRED", "COMPLETED", "R", "d4")], "company string, subject string, object string, event_type string, status string, rule string, document string")
    roots = spark.createDataFrame([("acme inc", "LEI1", "Acme Inc.", "AUTO_RESOLVED", "HIGH"), ("beta llc", "LEI2", "Beta", "REVIEW_REQUIRED", "LOW")], "query string, lei string, legal_name string, status string, confidence string")
    domains = spark.createDataFrame([("lei1", "Acme", "acme.com", "HIGH", "AUTO"), ("LEI1", "Acme", "acme.net", "MEDIUM", "REVIEW"), ("LEI9", "Zed", "zed.com", "HIGH", "AUTO")], "entity string, entity_name string, domain string, confidence string, disposition string")
    facts, rounds, why = X.expand(seeds, {"events": B.event_provider(events), "identity": B.identity_provider(roots), "domains": B.candidate_provider(domains)})
    got = {(r["fact_type"], r["value"], r["status"], r["pivot_eligible"]) for r in facts.collect()}
    assert got == {("COMPANY", "Acme Inc", "ACCEPTED", True), ("LEGAL_ENTITY", "Beta LLC", "REVIEW", False), ("LEGAL_ENTITY", "Acme Inc.", "ACCEPTED", True), ("DOMAIN", "acme.com", "ACCEPTED", True), ("DOMAIN", "acme.net", "REVIEW", False)}
    assert why == "NO_NEW_TRUSTED_PIVOTS" and not any(r["errors"] for r in rounds)
    told = B.event_facts(events.withColumnRenamed("company", "pivot"), lambda: F.col("event_type") == "MERGED_INTO")
    assert {(r["value"], r["status"], r["pivot_eligible"]) for r in told.collect()} == {("BETA", "ACCEPTED", True), ("Beta LLC", "REVIEW", False), ("Zeta", "REVIEW", False)}


def test_discovery_keeps_what_failed(spark):
    entities = spark.createDataFrame([("e1", "Acme"), ("e2", "Beta"), ("e3", "Gamma"), ("e4", "Delta")], "entity string, entity_name string")
    page = "entity string, provider string, rank int, ok boolean, error string, results array<struct<url string, title string, domain string>>"
    pages = spark.createDataFrame([("e1", "p", 1, False, "timeout", []), ("e1", "q", 2, True, None, [("https://a.com/x", "A", "a.com"), ("https://a.com/b", "B", "a.com")]), ("e2", "p", 1, False, "timeout", None), ("e2", "q", 2, False, None, None), ("e3", "p", 1, True, None, [])], page)
    seeds, errors = B.discovered(entities, pages)
    assert [tuple(r) for r in seeds.collect()] == [("e1", "Acme", "a.com", "q", "https://a.com/b", "B")]
    assert rows(errors) == [("e2", "p", "timeout"), ("e2", "q", "no answer"), ("e4", None, "not asked")]


def test_canonical_events(spark):
    c = spark.createDataFrame([("ACQUIRED", "2020-01-01", "A", "B", None, None, None, "acc", "HIGH"), ("ACQUIRED", "2020-01-01", "A", "B", None, None, None, "acc", "HIGH"), ("M&A_CANDIDATE", None, None, None, "S", None, None, "acc", "LOW"), ("OTHER", None, None, None, None, None, None, None, None)], "event_type string, event_date string, acquirer string, target string, subject string, object_entity string, result_entity string, accession string, confidence string")
    assert [(r["event_type"], r["status"], len(r["event_id"])) for r in B.canonical_events(c).orderBy("event_type").collect()] == [("ACQUIRED", "ASSERTED_FROM_FILING", 24), ("M&A_CANDIDATE", "CANDIDATE", 24)]


EVENTS = "event_id string, event_type string, day string, acquirer string, target string, subject string, object_entity string, result_entity string, to_form string"


def test_graph_over_time(spark):
    e = spark.createDataFrame([("1", "MERGED_INTO", "2020-05-01", None, None, "Old Co", "New Co", None, None), ("2", "CONVERTED_TO", "2019-01-01", None, None, "New Co", None, "New Co", "LLC"), ("3", "ACQUIRED", "2021-01-01", "New Co", "Third", None, None, None, None)], EVENTS)
    log = {r["entity_key"]: [tuple(x) for x in r["log"]] for r in G.state_log(G.states(e)).collect()}
    assert log == {"old co": [("2020-05-01", "LEGAL_STATUS", "MERGED_OUT")], "new co": [("2019-01-01", "LEGAL_FORM", "LLC"), ("2020-05-01", "LEGAL_STATUS", "SURVIVING_ENTITY")]}
    df = spark.createDataFrame([("2000-01-01", None), ("2030-01-01", None), (None, "2010-01-01"), (None, None), ("2000-01-01", "2015-01-01")], "s string, e string")
    assert [r[0] for r in df.select(G.existence(F.col("s"), F.col("e"), "2015-01-01")).collect()] == ["EXISTING", "NOT_YET_EXISTING", "ENDED", "UNKNOWN_START", "ENDED"]
    view = G.entity_view(G.states(e), G.edges(e), "2020-12-31").where("entity_key = 'new co'")
    assert {(r["kind"], r["what"], r["other"]) for r in view.collect()} == {("STATE", "LEGAL_FORM", "LLC"), ("STATE", "LEGAL_STATUS", "SURVIVING_ENTITY"), ("EVENT", "MERGED_INTO", "Old Co")}
    nodes = spark.createDataFrame([("a", "Acme"), ("b", "Acme One"), ("c", "Zeta Two"), ("d", None)], "node_id string, canonical_name string")
    q = spark.createDataFrame([(1, "ACME "), (2, "cme"), (3, "eta t"), (4, "x"), (5, ""), (6, "wo")], "query_id int, query string")
    assert rows(G.find_nodes(nodes, q)) == [(1, "a"), (3, "c"), (6, "c")]
    act = G.activity(spark.createDataFrame([("a", "2001"), ("a", "2005"), ("b", None)], "entity_key string, day string"))
    assert rows(act) == [("a", "2001", "2005"), ("b", None, None)] and rows(G.active_as_of(act, "2005").select("entity_key")) == [("b",)] and G.active_as_of(act, "2003").count() == 2


def test_registrable_domains_by_a_table_of_suffixes(spark):
    suffixes = spark.createDataFrame([(x,) for x in ("com", "uk", "co.uk", "*.ck", "!www.ck", "github.io", "io")], "suffix string")
    want = {"a.b.example.co.uk": "example.co.uk", "example.com": "example.com", "com": "com", "x.y.foo.ck": "y.foo.ck", "a.www.ck": "www.ck", "www.ck": "www.ck", "me.github.io": "me.github.io", "a.me.github.io": "me.github.io", "a.b.unknown": "b.unknown", "localhost": "localhost"}
    got = {r["host"]: r["domain"] for r in R.registrable(spark.createDataFrame([(h,) for h in [*want, None, "com"]], "host string"), suffixes).collect()}
    assert got == want


def test_hosts_of_other_scripts(spark):
    from quillstone.functions import text as T

    df = spark.createDataFrame([("https://Bücher.example/x",), ("www.Example.com",), ("http://\u00ad..",), (None,)], "u string")
    assert [r[0] for r in df.select(T.idna_host(F.col("u"))).collect()] == ["xn--bcher-kva.example", "www.example.com", None, None]
