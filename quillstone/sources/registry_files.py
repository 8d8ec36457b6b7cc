"""Registry files: level-1 records, level-2 relationships, summaries of the registry's interface.

Leaves of the JSON are wrapped as ``{"$": value}``. JSON lines are read in splits of any size; a file that is one large JSON
document or a zip of one is streamed record by record in a single task, as neither can be split: convert it once.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LEAF = "STRUCT<`$`: STRING>"
_ADDRESS = f"STRUCT<FirstAddressLine: {_LEAF}, City: {_LEAF}, Region: {_LEAF}, Country: {_LEAF}, PostalCode: {_LEAF}>"
LEVEL1 = f"""STRUCT<LEI: {_LEAF}, Entity: STRUCT<LegalName: {_LEAF}, OtherEntityNames: STRUCT<OtherEntityName: ARRAY<{_LEAF}>>, LegalJurisdiction: {_LEAF}, EntityStatus: {_LEAF}, EntityCategory: {_LEAF}, LegalForm: STRUCT<EntityLegalFormCode: {_LEAF}, OtherLegalForm: {_LEAF}>,
 LegalAddress: {_ADDRESS}, HeadquartersAddress: {_ADDRESS}, RegistrationAuthority: STRUCT<RegistrationAuthorityEntityID: {_LEAF}>>, Registration: STRUCT<RegistrationStatus: {_LEAF}, InitialRegistrationDate: {_LEAF}, LastUpdateDate: {_LEAF}, ManagingLOU: {_LEAF}, ValidationSources: {_LEAF}>>"""
_PERIOD = f"STRUCT<StartDate: {_LEAF}, EndDate: {_LEAF}, PeriodType: {_LEAF}>"
LEVEL2 = f"""STRUCT<Relationship: STRUCT<StartNode: STRUCT<NodeID: {_LEAF}>, EndNode: STRUCT<NodeID: {_LEAF}>, RelationshipType: {_LEAF}, RelationshipStatus: {_LEAF}, RelationshipPeriods: STRUCT<RelationshipPeriod: ARRAY<{_PERIOD}>>>,
 Registration: STRUCT<RegistrationStatus: {_LEAF}, LastUpdateDate: {_LEAF}, ManagingLOU: {_LEAF}, ValidationSources: {_LEAF}>>"""


def leaf(path: str) -> Column:
    """Value of a wrapped leaf without blanks at its ends; empty is null."""
    return F.nullif(F.trim(F.col(f"{path}.$")), F.lit(""))


def repaired(text: Column) -> Column:
    """The one known slip of syntax undone: ``},.`` for ``},``."""
    return F.replace(text, F.lit("},."), F.lit("},"))


_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}\[]|"', re.S)


def json_records(data: bytes | io.BufferedIOBase, chunk: int = 1 << 20) -> Iterator[str]:
    """Objects one level below the outermost array or object's array, as text: braces are counted from token to token, strings are skipped whole.

    No more than a record and a chunk is held; a string that a chunk cuts waits for the next one.
    """
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    depth, base, rest, held, inside = 0, None, b"", [], False
    while block := stream.read(chunk):
        block = rest + block
        start, upto = 0, len(block)
        for m in _TOKEN.finditer(block):
            token = m.group()
            if token == b'"':  # opens and doesn't end here
                upto = m.start()
                break
            if token == b"[":
                base = depth if base is None else base  # records are the objects of the first array
            elif token == b"{":
                if base is not None and depth == base:
                    start, inside = m.start(), True
                depth += 1
            elif token == b"}":
                depth -= 1
                if inside and depth == base:
                    yield (b"".join(held) + block[start : m.end()]).decode("utf-8")
                    held, inside = [], False
        if inside:
            held.append(block[start:upto])
        rest = block[upto:]


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, record) of files that each are one JSON document, or a zip of such; one task a file, of any size.

    Only the files' names pass through Spark; the task opens its file itself and reads it as a stream, so that neither the size
    limit of a value nor the memory bounds it.
    """
    files = spark.read.format("binaryFile").load(path).select("path").repartition("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                out: list[str] = []
                start = 0
                for record in _streamed(name):
                    out.append(record)
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array(range(start, start + len(out)), pa.int64()), pa.array(out)], ["path", "position", "record"])
                        start, out = start + len(out), []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array(range(start, start + len(out)), pa.int64()), pa.array(out)], ["path", "position", "record"])

    return files.mapInArrow(run, "path string, position bigint, record string")


def _streamed(path: str) -> Iterator[str]:
    """Records of a file on any file system that the name tells, without holding the file."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    with files.open_input_file(at) as f:
        if f.read(4) == b"PK\x03\x04":
            f.seek(0)
            with zipfile.ZipFile(f) as archive:
                for n in archive.namelist():
                    if n.endswith(".json"):
                        with archive.open(n) as s:
                            yield from json_records(s)
            return
        f.seek(0)
        yield from json_records(f)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, record) of JSON lines; positions grow along the file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("position"), F.rtrim(F.col("value")).alias("record"))
    return lines.where(F.col("record") != "")


def level1(records: DataFrame) -> DataFrame:
    """Flat level-1 rows with ``position`` and ``repaired``; records without a LEI are left out."""
    fixed = records.withColumn("text", repaired(F.col("record"))).withColumn("r", F.from_json("text", LEVEL1))
    e, g = "r.Entity", "r.Registration"
    return fixed.select(
        "position", (F.col("text") != F.col("record")).alias("repaired"), leaf("r.LEI").alias("lei"), leaf(f"{e}.LegalName").alias("legal_name"),
        F.filter(F.transform(f"{e}.OtherEntityNames.OtherEntityName", lambda x: F.trim(x["$"])), lambda x: x != "").alias("other_names"), leaf(f"{e}.LegalJurisdiction").alias("legal_jurisdiction"), leaf(f"{e}.EntityStatus").alias("entity_status"),
        leaf(f"{e}.EntityCategory").alias("entity_category"), leaf(f"{e}.LegalForm.EntityLegalFormCode").alias("legal_form_code"), leaf(f"{e}.LegalForm.OtherLegalForm").alias("other_legal_form"),
        *(leaf(f"{e}.{a}.{f}").alias(f"{p}_{f.lower()}") for a, p in (("LegalAddress", "legal_address"), ("HeadquartersAddress", "hq")) for f in ("Country", "Region", "City")),
        leaf(f"{e}.RegistrationAuthority.RegistrationAuthorityEntityID").alias("registration_number"), leaf(f"{g}.RegistrationStatus").alias("registration_status"), leaf(f"{g}.InitialRegistrationDate").alias("initial_registration_date"),
        leaf(f"{g}.LastUpdateDate").alias("last_update_date"), leaf(f"{g}.ManagingLOU").alias("managing_lou"), leaf(f"{g}.ValidationSources").alias("validation_sources"),
    ).where("lei is not null")


def level2(records: DataFrame) -> DataFrame:
    """Flat level-2 rows with the start and end of each kind of period; of several periods of a kind the last counts. A single period may stand without its array."""
    one = F.regexp_replace("record", r'"RelationshipPeriod"\s*:\s*(\{(?:[^{}]|\{[^{}]*\})*\})', '"RelationshipPeriod": [$1]')
    both = records.withColumn("r", F.from_json(F.get_json_object(repaired(one), "$.RelationshipRecord"), LEVEL2)).withColumn("r", F.coalesce("r", F.from_json(repaired(one), LEVEL2)))
    rel = "r.Relationship"
    last = lambda kind: F.element_at(F.filter(f"{rel}.RelationshipPeriods.RelationshipPeriod", lambda x: F.trim(x["PeriodType"]["$"]) == kind), -1)
    some = lambda kind: F.exists(f"{rel}.RelationshipPeriods.RelationshipPeriod", lambda x: F.trim(x["PeriodType"]["$"]) == kind)
    periods = [F.when(some(k), last(k))[f]["$"].alias(f"{n}_{s}") for k, n in (("RELATIONSHIP_PERIOD", "relationship"), ("ACCOUNTING_PERIOD", "accounting"), ("DOCUMENT_FILING_PERIOD", "document_filing")) for f, s in (("StartDate", "start"), ("EndDate", "end"))]
    return both.select("position", leaf(f"{rel}.StartNode.NodeID").alias("child_lei"), leaf(f"{rel}.EndNode.NodeID").alias("parent_lei"), leaf(f"{rel}.RelationshipType").alias("relationship_type"), leaf(f"{rel}.RelationshipStatus").alias("relationship_status"), *periods, leaf("r.Registration.RegistrationStatus").alias("registration_status"), leaf("r.Registration.LastUpdateDate").alias("last_update_date"))


def first_of(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: the first by position."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), "position").alias("_r")).select(key, "_r.*")


_NODE = "STRUCT<lei: STRING, legal_name: STRING, jurisdiction: STRING, status: STRING>"
SUMMARY = f"STRUCT<query_company: STRING, resolved_lei: STRING, entity: {_NODE}, direct_parent: STRUCT<type: STRING, reason: STRING, entity: {_NODE}>, ultimate_parent: STRUCT<type: STRING, reason: STRING, entity: {_NODE}>, direct_children: ARRAY<{_NODE}>, ultimate_children: ARRAY<{_NODE}>>"


def summary_links(records: DataFrame) -> DataFrame:
    """(root_lei, lei, legal_name, predicate) of saved interface summaries (column ``record``): parents and children; one row a pair and predicate."""
    s = records.select(F.from_json("record", SUMMARY).alias("s"))
    many = lambda f, p: F.transform(F.coalesce(F.col(f"s.{f}"), F.array().cast(f"ARRAY<{_NODE}>")), lambda x: F.struct(x["lei"].alias("lei"), x["legal_name"].alias("legal_name"), F.lit(p).alias("predicate")))
    one = lambda f, p: F.array(F.struct(F.col(f"s.{f}.entity.lei").alias("lei"), F.col(f"s.{f}.entity.legal_name").alias("legal_name"), F.lit(p).alias("predicate")))
    rows = s.select(F.col("s.resolved_lei").alias("root_lei"), F.explode(F.concat(one("direct_parent", "DIRECT_PARENT"), one("ultimate_parent", "ULTIMATE_PARENT"), many("direct_children", "DIRECT_CHILD"), many("ultimate_children", "ULTIMATE_CHILD"))).alias("x"))
    return rows.select("root_lei", "x.*").where("lei is not null").distinct()


def containing(rows: DataFrame, column: str, needles: list[str]) -> DataFrame:
    """Rows whose text holds one of the needles in any letter case."""
    return rows.where(F.exists(F.array(*(F.lit(n.lower()) for n in needles)), lambda n: F.contains(F.lower(F.col(column)), n)))


_NAMES = "ARRAY<STRUCT<`$`: STRING, `@type`: STRING>>"
RICH = f"""STRUCT<LEI: {_LEAF}, Entity: STRUCT<OtherEntityNames: STRUCT<OtherEntityName: {_NAMES}>, TransliteratedOtherEntityNames: STRUCT<TransliteratedOtherEntityName: {_NAMES}>,
 SuccessorEntity: ARRAY<STRUCT<SuccessorLEI: {_LEAF}, SuccessorEntityName: {_LEAF}>>,
 LegalEntityEvents: STRUCT<LegalEntityEvent: ARRAY<STRUCT<LegalEntityEventType: {_LEAF}, LegalEntityEventEffectiveDate: {_LEAF}, LegalEntityEventRecordedDate: {_LEAF}, `@event_status`: STRING, AffectedFields: STRUCT<AffectedField: ARRAY<{_LEAF}>>>>>>,
 Extension: STRUCT<ConformityFlag: {_LEAF}>>"""


def level1_rich(records: DataFrame) -> DataFrame:
    """(position, lei, other_names, transliterated_names, successor_leis, successor_names, events, conformity): what a level-1 record tells besides its flat row.

    A list of one that stands without its array counts as such. Names are each once, in order; empty ones are left out.
    """
    text = repaired(F.col("record"))
    for name in ("OtherEntityName", "TransliteratedOtherEntityName", "SuccessorEntity", "LegalEntityEvent", "AffectedField"):
        text = F.regexp_replace(text, rf'"{name}"\s*:\s*(\{{(?:[^{{}}]|\{{(?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*\}})*\}})', f'"{name}": [$1]')
    r = records.withColumn("r", F.from_json(text, RICH))
    said = lambda path, f: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(path), F.array()), lambda x: F.trim(f(x))), lambda v: v != ""))
    e = "r.Entity"
    event = lambda x: F.struct(F.trim(x["LegalEntityEventType"]["$"]).alias("type"), F.trim(x["LegalEntityEventEffectiveDate"]["$"]).alias("effective"), F.trim(x["LegalEntityEventRecordedDate"]["$"]).alias("recorded"), x["@event_status"].alias("status"), F.transform(x["AffectedFields"]["AffectedField"], lambda y: F.trim(y["$"])).alias("fields"))
    return r.select(
        "position", leaf("r.LEI").alias("lei"), said(f"{e}.OtherEntityNames.OtherEntityName", lambda x: x["$"]).alias("other_names"), said(f"{e}.TransliteratedOtherEntityNames.TransliteratedOtherEntityName", lambda x: x["$"]).alias("transliterated_names"),
        said(f"{e}.SuccessorEntity", lambda x: x["SuccessorLEI"]["$"]).alias("successor_leis"), said(f"{e}.SuccessorEntity", lambda x: x["SuccessorEntityName"]["$"]).alias("successor_names"),
        F.coalesce(F.transform(f"{e}.LegalEntityEvents.LegalEntityEvent", event), F.array()).alias("events"), leaf("r.Extension.ConformityFlag").alias("conformity"),
    ).where("lei is not null")
