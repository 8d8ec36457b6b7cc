"""Queries p2, p4, p5 and p7 to p10, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import abuse, addresses, bpe, components, linkage, packing, survivor
from quillstone.session import Scratch
from quillstone.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.found_pairs(table(spark, d, "entity_candidates", "address_id", "headquarters_address"), table(spark, d, "edgar_subsidiaries", "address_id", "legal_address"))


def _members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records = table(spark, d, "entity_candidates", "candidate_id", "provider", "last_update_date", *survivor.FIELDS)
    return table(spark, d, "candidate_groups"), records, table(spark, d, "provider_trust")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.found_origins(*_members(spark, d))


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(survivor.ranked_members(*_members(spark, d)))


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    registry = table(spark, d, "lei_entities", "lei", "legal_name", "legal_jurisdiction", "legal_address_city", "registration_number")
    return registry, table(spark, d, "entity_candidates", "candidate_id", "legal_name", "other_names", "legal_address", "jurisdiction", "registration_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.found_links(*_sources(spark, d))


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(*_sources(spark, d)).select("lei", "candidate_id", F.round("confidence", 6).alias("confidence"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return components.found_groups(table(spark, d, "eval_packets", "candidate_a", "candidate_b", "deterministic_evaluation"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents", "doc_id", "text"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    sizes = scratch.write(bpe.token_counts(table(spark, d, "documents", "doc_id", "text")))
    return packing.pack(sizes, packing.capacities_of(table(spark, d, "container_specs")), scratch)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, d), packing.capacities_of(table(spark, d, "container_specs")))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents", "doc_id", "text")
    return abuse.score(documents, abuse.fit_documents(documents, table(spark, d, "content_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("abusive").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(table(spark, d, "documents", "doc_id", "source"), _scored(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p4_survivors, p5_found, p5_confidence, p7_found, p8_ids, p9_containers, p9_fill, p10_found, p10_scores, p10_rates)}

_DAY = """CASE WHEN regexp_matches(trim({c}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?$') THEN try_cast(left(trim({c}), 10) AS DATE)
 WHEN regexp_matches(trim({c}), '^\\d{{8}}$') THEN try_cast(left(trim({c}), 4) || '-' || substr(trim({c}), 5, 2) || '-' || substr(trim({c}), 7, 2) AS DATE)
 WHEN regexp_matches(trim({c}), '^\\d{{1,2}}-[A-Za-z]{{3}}-\\d{{4}}$') THEN try_strptime(trim({c}), '%d-%b-%Y')::DATE
 WHEN regexp_matches(trim({c}), '^[A-Za-z]{{3,9}} \\d{{1,2}}, ?\\d{{4}}$') THEN coalesce(try_strptime(trim({c}), '%B %d, %Y'), try_strptime(trim({c}), '%b %d, %Y'))::DATE END"""

_VALUES = ", ".join(f"'{w}'" for w in survivor.STAND_INS)
_SAME_DIGIT = "|".join(f"{x}+" for x in range(10))
ORACLE = {
    "p4_found": f"""
WITH t AS (SELECT lower(regexp_replace(provider, '[^a-zA-Z]+', '', 'g')) AS p, min(trust_rank) AS rk FROM provider_trust GROUP BY 1),
r AS (SELECT c.candidate_id, coalesce(t.rk, 2147483647) AS rk, coalesce({_DAY.format(c="last_update_date")}, DATE '0001-01-01') AS dy,
  unnest(['legal_name', 'registration_id', 'entity_status', 'legal_form', 'entity_creation_date']) AS field_name, unnest([legal_name, registration_id, entity_status, legal_form, entity_creation_date]) AS v
 FROM entity_candidates c LEFT JOIN t ON t.p = lower(regexp_replace(c.provider, '[^a-zA-Z]+', '', 'g'))),
l AS (SELECT *, lower(regexp_replace(v, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS w FROM r WHERE v IS NOT NULL),
ok AS (SELECT * FROM l WHERE w <> '' AND w NOT IN ({_VALUES}) AND NOT regexp_matches(w, '^({_SAME_DIGIT})$')
  AND (field_name <> 'entity_creation_date' OR ({_DAY.format(c="v")} IS NOT NULL AND strftime({_DAY.format(c="v")}, '%Y-%m-%d') NOT IN ('9999-12-31', '9999-01-01', '0001-01-01', '1900-01-01', '1970-01-01')))),
m AS (SELECT g.dup_group, ok.* FROM (SELECT DISTINCT dup_group, candidate_id FROM candidate_groups) g JOIN ok USING (candidate_id)),
s AS (SELECT *, count(*) OVER w AS n, min(rk) OVER w AS best, max(dy) OVER w AS latest, count(*) OVER (PARTITION BY dup_group, field_name, dy) AS same FROM m WINDOW w AS (PARTITION BY dup_group, field_name))
SELECT dup_group, field_name, candidate_id FROM s WHERE n >= 2 AND dy = latest AND same = 1 AND rk = best""",
    "p4_survivors": f"""
WITH t AS (SELECT lower(regexp_replace(provider, '[^a-zA-Z]+', '', 'g')) AS p, min(trust_rank) AS rk FROM provider_trust GROUP BY 1),
r AS (SELECT c.candidate_id, coalesce(t.rk, 2147483647) AS rk, coalesce({_DAY.format(c="last_update_date")}, DATE '0001-01-01') AS dy,
  unnest(['legal_name', 'registration_id', 'entity_status', 'legal_form', 'entity_creation_date']) AS f, unnest([legal_name, registration_id, entity_status, legal_form, entity_creation_date]) AS v
 FROM entity_candidates c LEFT JOIN t ON t.p = lower(regexp_replace(c.provider, '[^a-zA-Z]+', '', 'g'))),
l AS (SELECT *, lower(regexp_replace(v, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS w FROM r),
x AS (SELECT *, coalesce(w <> '' AND w NOT IN ({_VALUES}) AND NOT regexp_matches(w, '^({_SAME_DIGIT})$')
  AND (f <> 'entity_creation_date' OR ({_DAY.format(c="v")} IS NOT NULL AND strftime({_DAY.format(c="v")}, '%Y-%m-%d') NOT IN ('9999-12-31', '9999-01-01', '0001-01-01', '1900-01-01', '1970-01-01'))), false) AS ok FROM l),
m AS (SELECT g.dup_group, x.*, count(*) FILTER (ok) OVER (PARTITION BY g.dup_group, x.candidate_id) AS full_ FROM (SELECT DISTINCT dup_group, candidate_id FROM candidate_groups WHERE dup_group IS NOT NULL) g JOIN x USING (candidate_id)),
b AS (SELECT dup_group, candidate_id AS base_candidate_id, count(*) OVER (PARTITION BY dup_group) AS n_records FROM m WHERE f = 'legal_name' QUALIFY row_number() OVER (PARTITION BY dup_group ORDER BY full_ DESC, rk, dy DESC, candidate_id) = 1),
k AS (SELECT dup_group, f, v, candidate_id AS c FROM m WHERE ok QUALIFY row_number() OVER (PARTITION BY dup_group, f ORDER BY rk, dy DESC, full_ DESC, candidate_id) = 1)
SELECT b.dup_group, base_candidate_id, n_records, {", ".join(f"max(CASE WHEN f = '{x}' THEN v END) AS {x}, max(CASE WHEN f = '{x}' THEN c END) AS {x}_from" for x in survivor.FIELDS)} FROM b LEFT JOIN k ON k.dup_group = b.dup_group GROUP BY 1, 2, 3""",
    "p7_found": """
WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(candidate_a.node_id)) AS a, lower(trim(candidate_b.node_id)) AS b FROM eval_packets
  WHERE upper(trim(deterministic_evaluation.decision)) = 'ACCEPT' AND trim(candidate_a.node_id) <> '' AND trim(candidate_b.node_id) <> '' AND lower(trim(candidate_a.node_id)) <> lower(trim(candidate_b.node_id))),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS other FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.other)
SELECT node AS node_id, min(other) AS group_id FROM r GROUP BY node""",
}
