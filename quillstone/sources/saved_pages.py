"""Answers of registries' and search interfaces, saved as files: nothing is fetched. What is missing or failed comes out as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillstone.functions.dates import calendar_day
from quillstone.operators.passages import term_passages
from quillstone.sources.observations import _card


def records_with(text: Column, key: str) -> Column:
    """All objects of a JSON text that have ``key``, however deep, in the order of the text, as JSON with sorted keys; none for what isn't JSON. In Arrow batches."""

    def inside(node) -> Iterator[dict]:
        if isinstance(node, dict):
            if key in node:
                yield node
            for v in node.values():
                yield from inside(v)
        elif isinstance(node, list):
            for v in node:
                yield from inside(v)

    @F.pandas_udf(ArrayType(StringType()))
    def find(s: pd.Series) -> pd.Series:
        def one(v):
            try:
                return [json.dumps(r, sort_keys=True, ensure_ascii=False) for r in inside(json.loads(v))]
            except (TypeError, ValueError, RecursionError):
                return []

        return s.map(one)

    return find(text)


def registry_pages(pages: DataFrame) -> DataFrame:
    """(lei, legal_name, jurisdiction, entity_status, page, last_page) of saved pages (record) of the registry's list of entities, each LEI once, from its first page."""
    shape = "STRUCT<data: ARRAY<STRUCT<id: STRING, attributes: STRUCT<lei: STRING, entity: STRUCT<legalName: STRUCT<name: STRING>, jurisdiction: STRING, status: STRING>>>>, meta: STRUCT<pagination: STRUCT<currentPage: INT, lastPage: INT>>>"
    r = pages.select(F.from_json("record", shape).alias("r")).select(F.explode("r.data").alias("x"), F.coalesce("r.meta.pagination.currentPage", F.lit(1)).alias("page"), F.col("r.meta.pagination.lastPage").alias("last_page"))
    rows = r.select(F.upper(F.trim(F.coalesce("x.attributes.lei", "x.id"))).alias("lei"), F.trim("x.attributes.entity.legalName.name").alias("legal_name"), F.col("x.attributes.entity.jurisdiction").alias("jurisdiction"), F.col("x.attributes.entity.status").alias("entity_status"), "page", "last_page")
    return rows.where("lei <> ''").groupBy("lei").agg(F.min_by(F.struct("legal_name", "jurisdiction", "entity_status", "page", "last_page"), "page").alias("r")).select("lei", "r.*")


def parent_answers(answers: DataFrame) -> DataFrame:
    """(lei, kind, parent_lei, reason) of saved answers (lei, kind, record): a parent, an exception with its reason, or neither."""
    return answers.select("lei", "kind", F.upper(F.coalesce(F.get_json_object("record", "$.data.attributes.lei"), F.when(F.get_json_object("record", "$.data.type") != "reporting-exceptions", F.get_json_object("record", "$.data.id")))).alias("parent_lei"), F.coalesce(F.get_json_object("record", "$.data.attributes.reason"), F.get_json_object("record", "$.data.attributes.exceptionReason")).alias("reason"))


def company_search(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query, company_number, jurisdiction, name, incorporated), (query, page) that lack) of saved pages (query, record) of a company search; a company once a query."""
    shape = "STRUCT<results: STRUCT<companies: ARRAY<STRUCT<company: STRUCT<name: STRING, company_number: STRING, jurisdiction_code: STRING, incorporation_date: STRING>>>, page: INT, total_pages: INT>>"
    r = pages.select("query", F.from_json("record", shape)["results"].alias("r"))
    c = r.select("query", F.explode("r.companies").alias("x")).select("query", "x.company.company_number", F.col("x.company.jurisdiction_code").alias("jurisdiction"), F.trim("x.company.name").alias("name"), F.col("x.company.incorporation_date").alias("incorporated"))
    found = c.where("company_number is not null").groupBy("query", "company_number", "jurisdiction").agg(F.min("name").alias("name"), F.min("incorporated").alias("incorporated"))
    had = r.select("query", F.col("r.page").alias("page"), F.col("r.total_pages").alias("n")).where("page is not null")
    wanted = had.groupBy("query").agg(F.max("n").alias("n")).where("n >= 1").select("query", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"))
    return found, wanted.join(had.select("query", "page"), ["query", "page"], "left_anti")


def tolerant_entities(documents: DataFrame) -> DataFrame:
    """(entity_lei, entity_name) of JSON documents (record) that hold their entities as a list of their own or under one of several names; each once, those without a name left out.

    Seeds, candidates and entities call their fields differently; the first that is there counts.
    """
    item = "ARRAY<STRUCT<entity_lei: STRING, lei: STRING, identifier: STRING, entity_name: STRING, legal_name: STRING, name: STRING>>"
    lists = [F.when(F.ltrim("record").startswith("["), F.from_json("record", item)), *(F.from_json(F.get_json_object("record", f"$.{k}"), item) for k in ("entities", "seeds", "candidates", "nodes"))]
    x = documents.select(F.explode(F.coalesce(*lists)).alias("x"))
    some = lambda *names: F.coalesce(*(F.nullif(F.trim(f"x.{n}"), F.lit("")) for n in names))
    return x.select(F.upper(some("entity_lei", "lei", "identifier")).alias("entity_lei"), some("entity_name", "legal_name", "name").alias("entity_name")).where("entity_name is not null").distinct()


def network_identities(documents: DataFrame) -> DataFrame:
    """(resource, names, address, country) of registration documents (record): who is named as registrant, else as administrator."""
    schema = "resource string, names array<string>, address string, country string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for v in f["record"]:
                try:
                    d = json.loads(v)
                    ents = [e for e in d.get("entities") or [] if isinstance(e, dict)]
                except (TypeError, ValueError, AttributeError):
                    continue
                for role in ("registrant", "administrative"):
                    who = [e for e in ents if role in (e.get("roles") or [])]
                    if who:
                        card = _card(who[0])
                        country = next((str(p[3][-1]).strip() for p in (who[0].get("vcardArray") or [None, []])[1] if p[0] == "adr" and isinstance(p[3], list) and p[3]), "")  # an address ends with it
                        names = list(dict.fromkeys(str(n).strip() for k in ("org", "fn") for n in card.get(k, []) if str(n or "").strip()))
                        out.append((str(d.get("ldhName") or d.get("handle") or "").lower() or None, names, ", ".join(card.get("adr", [])) or None, country or None))
                        break
            yield pd.DataFrame(out, columns=["resource", "names", "address", "country"])

    return documents.select("record").mapInPandas(run, schema).where("resource is not null")


def structure_evidence(changes: DataFrame, filings: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((change_id, accession, start, end, terms, passage), (change_id, accession, error)): passages on a change from the filings between its two disclosures.

    ``changes``: (change_id, cik, previous_day, current_day, terms array); ``filings``: (cik, accession, filing_date);
    ``documents``: (accession, text). A filing without a text, and a change without any filing, are errors that stay.
    """
    f = filings.select("cik", "accession", F.date_format(calendar_day(F.col("filing_date")), "yyyy-MM-dd").alias("day")).distinct()
    met = changes.join(f, "cik").where("day > previous_day and day <= current_day").select("change_id", "accession", "terms").distinct()
    both = met.join(documents.select("accession", "text"), "accession", "left").withColumn("doc_id", F.xxhash64("change_id", "accession"))
    found = term_passages(both.select("doc_id", "text").dropDuplicates(["doc_id"]), "text", both.where("text is not null").select("doc_id", F.explode("terms").alias("term")).distinct())
    out = found.withColumnRenamed("terms", "found").join(both.select("doc_id", "change_id", "accession").distinct(), "doc_id").select("change_id", "accession", "start", "end", F.col("found").alias("terms"), "passage")
    lacking = both.groupBy("change_id", "accession").agg(F.bool_or(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).alias("ok")).where("not ok").select("change_id", "accession", F.lit("no text").alias("error"))
    none = changes.join(met.select("change_id").distinct(), "change_id", "left_anti").select("change_id", F.lit(None).cast("string").alias("accession"), F.lit("no filing between the disclosures").alias("error"))
    return out, lacking.unionByName(none)


def packet_errors(evidence: DataFrame, results: DataFrame, decisions: tuple[str, ...]) -> DataFrame:
    """(packet_id, errors array<string>) of results that don't hold: sound ones are left out.

    ``evidence``: (packet_id, evidence_id, text); ``results``: (packet_id, decision, cited array, excerpt, event_date). Checked: a
    known decision, unique ids of the evidence, cited ids that exist, an excerpt that a cited text has word for word, a real day.
    """
    per = evidence.groupBy("packet_id").agg(F.collect_set("evidence_id").alias("ids"), F.count(F.lit(1)).alias("n"))
    quoted = results.select("packet_id", F.explode("cited").alias("evidence_id"), "excerpt").join(evidence, ["packet_id", "evidence_id"]).where(F.contains("text", F.col("excerpt"))).select("packet_id").distinct().withColumn("quoted", F.lit(True))
    both = results.join(per, "packet_id", "left").join(quoted, "packet_id", "left")
    none = F.array().cast("array<string>")
    cited, ids = F.coalesce("cited", none), F.coalesce("ids", none)
    tests = {
        "unknown decision": ~F.coalesce(F.col("decision").isin(*decisions), F.lit(False)), "repeated evidence id": F.coalesce(F.col("n") > F.size(ids), F.lit(False)), "unknown evidence id": F.size(F.array_except(cited, ids)) > 0,
        "excerpt not in the cited evidence": (F.trim(F.coalesce("excerpt", F.lit(""))) != "") & F.col("quoted").isNull(), "no day": F.col("event_date").isNotNull() & (~F.col("event_date").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date("event_date", "yyyy-MM-dd").isNull()),
    }
    errors = F.array_compact(F.array(*(F.when(test, text) for text, test in tests.items())))
    return both.select("packet_id", errors.alias("errors")).where(F.size("errors") > 0)
