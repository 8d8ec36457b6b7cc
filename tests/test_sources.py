import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.sources import filings as L
from quillstone.sources import observations as O
from quillstone.sources import registry_files as G
from quillstone.sources import sinks
from tests.conftest import rows


def wrap(v):
    return {"$": v}


def entity(lei, name, **more):
    return {"LEI": wrap(lei), "Entity": {"LegalName": wrap(name), "LegalJurisdiction": wrap("GB"), "EntityStatus": wrap("ACTIVE"), "LegalAddress": {"City": wrap(" Oslo "), "Country": wrap("NO")}, "OtherEntityNames": {"OtherEntityName": [wrap("Old")]}} | more, "Registration": {"LastUpdateDate": wrap("2020-01-01")}}


def test_level1_lines_and_documents(spark, tmp_path):
    recs = [entity("L1", 'A "quoted, }{" name'), entity("L2", " "), {"LEI": wrap(""), "Entity": {}}]
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(r) for r in recs))
    got = G.level1(G.json_lines(spark, str(tmp_path / "x.jsonl"))).orderBy("lei").collect()
    assert [(r["lei"], r["legal_name"], r["legal_address_city"], r["other_names"], r["repaired"]) for r in got] == [("L1", 'A "quoted, }{" name', "Oslo", ["Old"], False), ("L2", None, "Oslo", ["Old"], False)]
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc" / "all.json").write_text(json.dumps({"records": recs, "info": {"n": 3}}))
    with zipfile.ZipFile(tmp_path / "doc" / "z.zip", "w") as z:
        z.writestr("in.json", json.dumps([entity("L3", "C")]))
    whole = G.whole_files(spark, str(tmp_path / "doc"))
    assert [r["lei"] for r in G.level1(whole).orderBy("lei").collect()] == ["L1", "L2", "L3"]
    assert rows(G.first_of(spark.createDataFrame([("a", 2, "x"), ("a", 1, "y")], "k string, position int, v string"), "k")) == [("a", 1, "y")]


def test_slip_of_syntax_is_repaired(spark):
    df = spark.createDataFrame([(1, json.dumps(entity("L1", "A")).replace('}, "Reg', '},. "Reg'))], "position bigint, record string")
    r = G.level1(df).first()
    assert r["repaired"] and r["last_update_date"] == "2020-01-01"


def test_level2_periods(spark):
    period = lambda k, s, e: {"StartDate": wrap(s), "EndDate": wrap(e), "PeriodType": wrap(k)}
    rel = lambda periods: {"RelationshipRecord": {"Relationship": {"StartNode": {"NodeID": wrap("C")}, "EndNode": {"NodeID": wrap("P")}, "RelationshipType": wrap("T"), "RelationshipStatus": wrap("ACTIVE"), "RelationshipPeriods": {"RelationshipPeriod": periods}}, "Registration": {"RegistrationStatus": wrap("PUBLISHED")}}}
    data = [(1, json.dumps(rel([period("RELATIONSHIP_PERIOD", "a", "b"), period("ACCOUNTING_PERIOD", "c", "d"), period("RELATIONSHIP_PERIOD", "e", "f")]))), (2, json.dumps(rel(period("RELATIONSHIP_PERIOD", "g", "h")))), (3, json.dumps(rel([])))]
    got = G.level2(spark.createDataFrame(data, "position bigint, record string")).orderBy("position").collect()
    assert [(r["child_lei"], r["relationship_start"], r["relationship_end"], r["accounting_start"]) for r in got] == [("C", "e", "f", "c"), ("C", "g", "h", None), ("C", None, None, None)]


def test_summary_links(spark):
    rec = json.dumps({"resolved_lei": "R", "direct_parent": {"type": "lei", "entity": {"lei": "P", "legal_name": "Pa"}}, "ultimate_parent": {"type": "exception", "reason": "x"}, "direct_children": [{"lei": "C", "legal_name": "Ch"}] * 2})
    assert rows(G.summary_links(spark.createDataFrame([(rec,)], "record string"))) == [("R", "C", "Ch", "DIRECT_CHILD"), ("R", "P", "Pa", "DIRECT_PARENT")]


def test_filings(spark):
    recent = {"accessionNumber": ["1", "2"], "filingDate": ["2020-01-01", "2021-01-01"], "form": ["8-K", "10-K"], "items": ["1.01", ""]}
    page = {"accessionNumber": ["2", "3"], "filingDate": ["2021-01-01", "2010-01-01"], "form": ["X", "20-F"], "items": ["", ""], "primaryDocument": ["a", "b"]}
    subs = spark.createDataFrame([(json.dumps({"cik": "7", "filings": {"recent": recent}}),)], "record string")
    pages = spark.createDataFrame([("7", "2009-01-01", "2011-01-01", json.dumps(page)), ("7", "1999-01-01", "2000-01-01", "broken")], "cik string, filingFrom string, filingTo string, record string")
    got = L.filings(subs, pages, "2005", "2022")
    assert [(r["accessionNumber"], r["form"], r["primaryDocument"]) for r in got.orderBy("accessionNumber").collect()] == [("1", "8-K", ""), ("2", "10-K", ""), ("3", "20-F", "b")]
    assert [r["accessionNumber"] for r in L.event_filings(got).collect()] == ["3", "1", "2"]
    assert [r["accessionNumber"] for r in L.annual_filings(got).collect()] == ["2", "3"]


@pytest.mark.parametrize("name, yes", [("ex-21.htm", True), ("exhibit21.1.htm", True), ("tgt-20250201xexhibit211.htm", True), ("ex-10.htm", False)])
def test_exhibit_names(spark, name, yes):
    assert spark.createDataFrame([(name,)], "n string").select(L.is_subsidiary_exhibit(F.col("n"))).first()[0] is yes


def test_issuers(spark):
    t = spark.createDataFrame([("0000000007", "AA", "Alpha Corp"), ("0000000007", "AB", "Alpha Corp"), ("0000000008", "BB", "Beta Alpha Group")], "cik string, ticker string, title string")
    q = spark.createDataFrame([("7",), ("bb",), ("alpha corp",), ("alpha",), ("none",)], "query string")
    assert rows(L.find_issuer(q, t)) == [("7", 1, "0000000007", "AA,AB"), ("alpha", 5, "0000000007", "AA,AB"), ("alpha", 5, "0000000008", "BB"), ("alpha corp", 4, "0000000007", "AA,AB"), ("bb", 2, "0000000008", "BB")]


def test_tables_and_subsidiaries(spark):
    flat = "<p>LIST OF SUBSIDIARIES</p><p>(As of 2020)</p><p>Alpha Ltd (UK)</p><div>Beta (fka Gamma) LLC (MN) a</div><p>Pursuant to item</p><p>Zeta (US)</p>"
    nested = "<table><tr><th>Company Name</th><th>Country of Incorporation</th><th>Ownership</th></tr><tr><td>Alpha <table><tr><td>in</td></tr></table>Ltd</td><td>Japan</td><td>100%</td></tr><tr><td>Beta Inc (Dormant)</td><td>US</td><td>51.5</td></tr></table>"
    pages = spark.createDataFrame([(1, flat), (2, nested), (3, None), (4, "<p>nothing</p>")], "page_id bigint, html string")
    subs = L.subsidiaries_of_pages(pages)
    assert [r["cells"] for r in subs.where("page_id = 1").orderBy("row_index").collect()][1:] == [["Alpha Ltd", "UK"], ["Beta (fka Gamma) LLC", "MN"]]
    got = {r["name"]: r for r in L.disclosed_entities(subs).collect()}
    assert got["Beta LLC"]["former_name"] == "Gamma" and got["Beta Inc"]["status"] == "DORMANT" and got["Beta Inc"]["ownership"] == 51.5 and got["Beta Inc"]["jurisdiction"] == "US"
    t = L.tables_of_pages(pages)
    assert t.where("page_id = 2").count() == 3 and rows(L.best_tables(t))[0][:2] == (2, 0)


def test_csv_and_json_evidence(spark, tmp_path):
    (tmp_path / "e.csv").write_text("domain,capability,entity_lei,supports_attribution\nA.com,rdap_whois,L1,yes\n,dns,L1,\nb.com,dns,L1,perhaps\n")
    good, bad = O.csv_evidence(spark, str(tmp_path / "e.csv"))
    assert [(r["domain"], r["capability"], r["supports"]) for r in good.collect()] == [("a.com", "RDAP_WHOIS", True)]
    assert sorted(r["error"] for r in bad.collect()) == ["domain missing", "supports_attribution unreadable"]
    (tmp_path / "f.csv").write_text("domain\nx\n")
    with pytest.raises(ValueError):
        O.csv_evidence(spark, str(tmp_path / "f.csv"))
    doc = json.dumps({"subjects": [{"entity_lei": "L", "domain": "X.com", "observations": [{"capability": "dns", "source": "s", "value": "v"}]}]})
    r = O.json_evidence(spark.createDataFrame([(doc,)], "record string")).first()
    assert (r["entity"], r["domain"], r["provider"], r["capability"], r["availability"], r["observed_value"]) == ("L", "x.com", "s", "DNS", "PROVIDED", "v")


def test_vendor_records(spark):
    recs = [{"domain": "A.com", "ip": "1.2.3.4", "asn": "as 13335", "asn_org": "Acme Inc", "tls.subject_org": "Redacted for privacy"}, {"domain": "b.com", "tls": {"subject_org": "Other"}}]
    got = O.vendor_records(spark.createDataFrame([(json.dumps(r),) for r in recs], "record string"), expected="ACME")
    assert [(r["domain"], r["capability"], r["availability"], r["supports"]) for r in got.orderBy("domain", "capability").collect()] == [("a.com", "IP_ASN_OWNERSHIP", "PROVIDED", True), ("a.com", "TLS_CERTIFICATE", "INCONCLUSIVE", False), ("b.com", "TLS_CERTIFICATE", "PROVIDED", False)]


def test_whois_and_registrations(spark):
    t = spark.createDataFrame([("A.com", "Registrant Organization: Acme Inc\nx"), ("b.com", "Registrant Organization: REDACTED FOR PRIVACY"), ("c.com", "nothing"), ("d.com", "Registrant Org: -\nRegistrant Name: Bob")], "domain string, text string")
    assert [(r[0], r[1], r[2]) for r in rows(O.whois(t))] == [("a.com", "PROVIDED", "Acme Inc"), ("b.com", "INCONCLUSIVE", None), ("c.com", "MISSING", None), ("d.com", "PROVIDED", "Bob")]
    card = lambda *items: ["vcard", [["version", {}, "text", "4.0"], *items]]
    doc = {"ldhName": "Acme.COM.", "entities": [{"roles": ["registrar"], "vcardArray": card(["fn", {}, "text", "Reg"])}, {"roles": ["registrant"], "vcardArray": card(["org", {}, "text", "Acme Inc"], ["adr", {}, "text", ["", "1 Road", "Town"]])}], "events": [{"eventAction": "registration", "eventDate": "2001"}]}
    got = O.registrations(spark.createDataFrame([(json.dumps(doc),), ("broken",), (None,), (json.dumps({"ldhName": "x.com"}),)], "record string"))
    assert rows(got) == [("acme.com", "Acme Inc", "1 Road Town", "2001", None, "PROVIDED"), ("x.com", None, None, None, None, "MISSING")]


def test_search_and_sites(spark):
    html = '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Facme.com%2F">Acme <b>Inc</b></a><a class="result__a" href="javascript:x">no</a>'
    rss = "<rss><item><title>Two</title><link>https://two.org/a?b=1&amp;c=2</link></item></rss>"
    got = O.search_results(spark.createDataFrame([("q", html), ("r", rss), ("s", None)], "query string, body string"))
    assert rows(got) == [("q", 1, "https://acme.com/", "acme.com", "Acme Inc"), ("r", 1, "https://two.org/a?b=1&c=2", "two.org", "Two")]
    p = spark.createDataFrame([("https://acme.com/legal", "Copyright 2020 ACME, Inc. All rights reserved", "Acme Inc."), ("https://en.wikipedia.org/x", "Copyright ACME Inc", "Acme Inc"), ("https://z.com", "Acme Inc " + "x " * 400 + "copyright", "Acme Inc")], "url string, text string, legal_name string")
    assert [r["declared"] for r in O.official_site(p).collect()] == [True, False, False]


def test_addresses_of_networks(spark):
    df = spark.createDataFrame([("2001:DB8::0001", "AS0042"), ("1.2.3.4 ", "x"), ("300.1.1.1", None)], "ip string, asn string")
    assert [tuple(r) for r in df.select(O.ip_address(F.col("ip")), O.asn_number(F.col("asn"))).collect()] == [("2001:db8::1", "AS42"), ("1.2.3.4", None), (None, None)]


def test_sinks(spark, tmp_path):
    t, s = str(tmp_path / "t"), "k string, p int, v string"
    sinks.upsert_parquet(spark, t, spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], s), ["k"], "p")
    for _ in range(2):  # a batch that runs again changes nothing
        sinks.upsert_parquet(spark, t, spark.createDataFrame([("a", 2, "z")], s), ["k"], "p")
    assert rows(spark.read.parquet(t)) == [("a", 2, "z"), ("b", 1, "y")]
    q, done = str(tmp_path / "q"), str(tmp_path / "d")
    packets = spark.createDataFrame([("p1", 1), ("p2", 2), ("p1", 1)], "packet_id string, n int")
    assert sinks.append_new_json(spark, q, packets, "packet_id") == 2 and sinks.append_new_json(spark, q, packets, "packet_id") == 0
    sinks.move(spark, q, done, spark.createDataFrame([("p1", "ACCEPT")], "packet_id string, decision string"), "packet_id")
    assert [r["packet_id"] for r in spark.read.json(q).collect()] == ["p2"] and [r["decision"] for r in spark.read.json(done).collect()] == ["ACCEPT"]
    assert sinks.report(packets.limit(1), "T").splitlines()[0] == "# T"
