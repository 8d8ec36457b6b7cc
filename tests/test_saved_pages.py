import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.sources import registry_files as G
from quillstone.sources import saved_pages as S
from quillstone.sources import sinks
from tests.conftest import rows


def docs(spark, *records, **more):
    return spark.createDataFrame([(r if isinstance(r, str) or r is None else json.dumps(r),) for r in records], "record string")


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1 << 20])
def test_records_are_cut_from_a_stream(chunk):
    made = [{"a": "x{[\"}\\", "b": {"c": [1, {"d": "]"}]}}, {"e": "é \\\" }"}, {}]
    for text in (json.dumps(made), json.dumps({"meta": {"k": "["}, "records": made}, ensure_ascii=False)):
        assert [json.loads(r) for r in G.json_records(text.encode(), chunk)] == made
    assert list(G.json_records(b"[]", chunk)) == [] == list(G.json_records(b"", chunk))


def test_whole_files_and_archives_are_streamed(spark, tmp_path):
    made = [{"LEI": {"$": f"L{i}"}} for i in range(25_000)]
    (tmp_path / "a.json").write_text(json.dumps(made))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x.json", json.dumps({"records": made[:3]}))
        z.writestr("notes.txt", "[{}]")
    got = G.whole_files(spark, str(tmp_path))
    assert got.groupBy(F.regexp_extract("path", r"([^/]+)$", 1)).agg(F.count("*"), F.max("position")).orderBy("count(1)").collect() == [("b.zip", 3, 2), ("a.json", 25_000, 24_999)]


def test_rich_level1(spark):
    leaf = lambda v: {"$": v}
    full = {"LEI": leaf(" L1 "), "Entity": {"OtherEntityNames": {"OtherEntityName": [leaf("Old"), leaf("Old"), leaf(" ")]}, "TransliteratedOtherEntityNames": {"TransliteratedOtherEntityName": leaf("Staryi")}, "SuccessorEntity": {"SuccessorLEI": leaf("L2"), "SuccessorEntityName": leaf("New")}, "LegalEntityEvents": {"LegalEntityEvent": {"LegalEntityEventType": leaf("CHANGE_LEGAL_NAME"), "LegalEntityEventEffectiveDate": leaf("2020-01-01"), "@event_status": "COMPLETED", "AffectedFields": {"AffectedField": [leaf("LegalName")]}}}}, "Extension": {"ConformityFlag": leaf("CONFORMING")}}
    df = spark.createDataFrame([(0, json.dumps(full)), (1, json.dumps({"LEI": leaf("L3")})), (2, "{}"), (3, "broken")], "position bigint, record string")
    a, b = G.level1_rich(df).orderBy("position").collect()
    assert (a["lei"], a["other_names"], a["transliterated_names"], a["successor_leis"], a["successor_names"], a["conformity"]) == ("L1", ["Old"], ["Staryi"], ["L2"], ["New"], "CONFORMING")
    assert [(e["type"], e["effective"], e["status"], e["fields"]) for e in a["events"]] == [("CHANGE_LEGAL_NAME", "2020-01-01", "COMPLETED", ["LegalName"])]
    assert (b["lei"], b["other_names"], b["events"], b["conformity"]) == ("L3", [], [], None)


def test_objects_with_a_key_however_deep(spark):
    got = docs(spark, {"a": [{"LEI": 1, "x": {"LEI": 2}}], "b": 3}, "not json", None, [[{"LEI": 3}]]).select(S.records_with(F.col("record"), "LEI").alias("r")).collect()
    assert [[json.loads(x)["LEI"] for x in r["r"]] for r in got] == [[1, 2], [], [], [3]]


def test_registry_answers(spark):
    page = lambda n, *es: {"data": [{"id": i, "attributes": {"lei": i, "entity": {"legalName": {"name": f"{i} p{n}"}, "status": "ACTIVE"}}} for i in es], "meta": {"pagination": {"currentPage": n, "lastPage": 2}}}
    assert [(r["lei"], r["legal_name"], r["page"]) for r in S.registry_pages(docs(spark, page(2, "b", "c"), page(1, "a", "b"), "broken")).orderBy("lei").collect()] == [("A", "a p1", 1), ("B", "b p1", 1), ("C", "c p2", 2)]
    answers = spark.createDataFrame([("x", "direct", json.dumps({"data": {"id": "p1", "type": "lei-records", "attributes": {"lei": "p1"}}})), ("x", "ultimate", json.dumps({"data": {"type": "reporting-exceptions", "attributes": {"reason": "NO_LEI"}}})), ("y", "direct", None)], "lei string, kind string, record string")
    assert rows(S.parent_answers(answers)) == [("x", "direct", "P1", None), ("x", "ultimate", None, "NO_LEI"), ("y", "direct", None, None)]


def test_company_search_tells_what_lacks(spark):
    page = lambda n, of, *cs: json.dumps({"results": {"companies": [{"company": {"name": c, "company_number": c, "jurisdiction_code": "gb"}} for c in cs], "page": n, "total_pages": of}})
    df = spark.createDataFrame([("acme", page(1, 3, "1", "2")), ("acme", page(3, 3, "2", "4")), ("none", page(1, 0)), ("bad", None)], "query string, record string")
    found, lacking = S.company_search(df)
    assert [r["company_number"] for r in found.orderBy("company_number").collect()] == ["1", "2", "4"] and rows(lacking) == [("acme", 2)]


def test_tolerant_loading(spark):
    df = docs(spark, [{"lei": "l1", "name": "A"}], {"entities": [{"entity_lei": "L2", "legal_name": "B"}, {"name": " "}]}, {"seeds": [{"entity_name": "C", "identifier": "l3"}]}, {"other": []}, "broken", None)
    assert rows(S.tolerant_entities(df)) == [("L1", "A"), ("L2", "B"), ("L3", "C")]


def test_network_identities(spark):
    card = ["vcard", [["version", {}, "text", "4.0"], ["fn", {}, "text", "Jo"], ["org", {}, "text", "Acme Inc"], ["adr", {}, "text", ["", "", "1 Main St", "Town", "", "12345", "US"]]]]
    df = docs(spark, {"ldhName": "ACME.com", "entities": [{"roles": ["registrant"], "vcardArray": card}]}, {"ldhName": "x.com", "entities": []}, "broken", None)
    got = S.network_identities(df).collect()
    assert len(got) == 1 and got[0]["resource"] == "acme.com" and "Acme Inc" in got[0]["names"] and got[0]["country"] == "US"


def test_structure_evidence_keeps_errors(spark):
    changes = spark.createDataFrame([("c1", "1", "2020-01-01", "2021-01-01", ["Old Works"]), ("c2", "2", "2020-01-01", "2021-01-01", ["x"])], "change_id string, cik string, previous_day string, current_day string, terms array<string>")
    filings = spark.createDataFrame([("1", "a1", "20200601"), ("1", "a2", "2021-01-01"), ("1", "a3", "2020-01-01"), ("1", "a4", "2021-06-01")], "cik string, accession string, filing_date string")
    texts = spark.createDataFrame([("a1", "then OLD WORKS merged away"), ("a3", "old works"), ("a4", "old works")], "accession string, text string")
    found, errors = S.structure_evidence(changes, filings, texts)
    assert [(r["change_id"], r["accession"], r["terms"], r["passage"]) for r in found.collect()] == [("c1", "a1", ["Old Works"], "then OLD WORKS merged away")]
    assert rows(errors) == [("c1", "a2", "no text"), ("c2", None, "no filing between the disclosures")]


def test_results_that_do_not_hold(spark):
    evidence = spark.createDataFrame([("p", "e1", "it was merged into B"), ("p", "e2", "other"), ("q", "e1", "x"), ("q", "e1", "y")], "packet_id string, evidence_id string, text string")
    results = spark.createDataFrame([("p", "MERGED", ["e1"], "merged into B", "2020-01-31"), ("q", "MERGED", ["e1"], "x", None), ("p", "MAYBE", ["e9"], "never said", "2020-02-31")], "packet_id string, decision string, cited array<string>, excerpt string, event_date string")
    got = S.packet_errors(evidence, results.where("decision = 'MERGED'"), ("MERGED",)).collect()
    assert [(r["packet_id"], r["errors"]) for r in got] == [("q", ["repeated evidence id"])]
    assert [r["errors"] for r in S.packet_errors(evidence, results.where("decision = 'MAYBE'"), ("MERGED",)).collect()] == [["unknown decision", "unknown evidence id", "excerpt not in the cited evidence", "no day"]]


def test_queue_goes_on_after_a_crash(spark, tmp_path):
    pending, done = f"{tmp_path}/pending", f"{tmp_path}/done"
    sinks.append_new_json(spark, pending, spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "id string, v int"), "id")
    assert rows(spark.read.schema("id string, v int").json(pending)) == [("a", 1), ("b", 1)]
    (tmp_path / "pending").rename(tmp_path / "pending.old")  # as a crash between the two renamings leaves it
    sinks.move(spark, pending, done, spark.createDataFrame([("a", "yes")], "id string, decision string"), "id")
    assert [r["id"] for r in spark.read.json(pending).collect()] == ["b"] and [(r["id"], r["decision"]) for r in spark.read.json(done).collect()] == [("a", "yes")]
