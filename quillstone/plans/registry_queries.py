"""Registry upserts, joins, walks and root resolution over whole tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.dates import calendar_day
from quillstone.operators import registry as R
from quillstone.operators.intervals import lei
from quillstone.plans.data_queries import _DAY
from quillstone.plans.name_queries import sql_base, sql_fold
from quillstone.session import Scratch
from quillstone.tables import table


def _known(spark: SparkSession, d: str) -> DataFrame:
    return R.entities(table(spark, d, "lei_entities", "record_id", "lei", "legal_name", "legal_jurisdiction", "entity_status"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return R.links(table(spark, d, "relationships", "child_lei", "parent_lei", "relationship_type"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The first word of every studied company's name; for every fourth company its sector, which many names hold."""
    word = F.when(F.col("company_id") % 4 == 0, T.fold_name(F.col("sector"))).otherwise(F.split(T.fold_name(F.col("company")), " ")[0])
    return table(spark, d, "study_companies", "company_id", "company", "sector").select(F.col("company_id").alias("query_id"), word.alias("query"))


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "study_companies", "lei").select(lei("lei").alias("root")).distinct()


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).select("lei", "legal_name", "jurisdiction", "entity_status")


def relationship_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "relationships", "id", "child_lei", "parent_lei", "relationship_type", "relationship_status")
    rows = rows.where(F.trim("relationship_type").isin(R.DIRECT, R.ULTIMATE)).select(lei("child_lei").alias("child"), lei("parent_lei").alias("parent"), F.trim("relationship_type").alias("relationship_type"), "id", "relationship_status")
    return R.upsert_last(rows, ["child", "parent", "relationship_type"], "id")


def relationship_load_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "relationships", "child_lei", "parent_lei", "relationship_type")
    supported = F.coalesce(F.trim("relationship_type").isin(R.DIRECT, R.ULTIMATE), F.lit(False))
    complete = F.coalesce((F.trim("child_lei") != "") & (F.trim("parent_lei") != ""), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(supported & complete).alias("supported"), F.count_if(~supported).alias("unsupported"), F.count_if(supported & ~complete).alias("incomplete"))


def seed_phrase_match(spark: SparkSession, d: str) -> DataFrame:
    return R.seeds(_known(spark, d), _queries(spark, d)).select("query_id", "lei", "likeness")


def _walks(spark: SparkSession, d: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    active = R.links(table(spark, d, "relationships", "child_lei", "parent_lei", "relationship_type", "relationship_status"), "ACTIVE")
    known, edges = scratch.write(_known(spark, d)), scratch.write(active)
    found = scratch.write(R.seeds(known, _queries(spark, d)))
    return known, found, R.walk_upward(found.select("query_id", F.col("lei").alias("seed")), edges, scratch)


def upward_walk(spark: SparkSession, d: str) -> DataFrame:
    return _walks(spark, d, Scratch(spark))[2]


def root_vote_scores(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    known, _, walks = _walks(spark, d, scratch)
    out = R.root_scores(scratch.write(walks), known, _queries(spark, d))
    return out.select("query_id", "lei", "matched", "n_seeds", "direct_votes", "ultimate_votes", "terminal_votes", "max_depth", F.round("score", 6).alias("score"))


def root_resolution(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    known, found, walks = _walks(spark, d, scratch)
    out = R.decide_roots(R.root_scores(scratch.write(walks), known, _queries(spark, d)), found)
    return out.select("query_id", "lei", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "status", "confidence")


def or_endpoint_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.touching(_edges(spark, d), _roots(spark, d))


def relation_direction(spark: SparkSession, d: str) -> DataFrame:
    near = R.touching(_edges(spark, d), _roots(spark, d))
    return near.groupBy("root", R.relation(F.col("root"), F.col("child"), F.col("direct"), F.col("ultimate")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


def company_expansion(spark: SparkSession, d: str) -> DataFrame:
    return R.expand(_edges(spark, d), _roots(spark, d), _known(spark, d))


def endpoint_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every link with the names of both ends; an end that the registry lacks keeps its LEI."""
    known = _known(spark, d).select("lei", "legal_name")
    rows = _edges(spark, d).join(known.select(F.col("lei").alias("child"), F.col("legal_name").alias("cn")), "child", "left").join(known.select(F.col("lei").alias("parent"), F.col("legal_name").alias("pn")), "parent", "left")
    return rows.select("child", "parent", F.coalesce("cn", "child").alias("child_name"), F.coalesce("pn", "parent").alias("parent_name"))


def both_ends_known(spark: SparkSession, d: str) -> DataFrame:
    known = _known(spark, d).select("lei")
    return _edges(spark, d).join(known.withColumnRenamed("lei", "child"), "child", "left_semi").join(known.withColumnRenamed("lei", "parent"), "parent", "left_semi").select("child", "parent")


def not_in_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_candidates", "candidate_id", "legal_name").join(table(spark, d, "candidate_groups", "candidate_id"), "candidate_id", "left_anti")


def review_candidates_blocked(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose base names are equal: each with its class, named by the smallest LEI, and the number of others in it."""
    known = _known(spark, d).withColumn("base_name", T.strip_suffixes(F.col("name"))).where("base_name is not null")
    classes = known.groupBy("base_name").agg(F.min("lei").alias("class_lei"), (F.count(F.lit(1)) - 1).alias("n_links")).where("n_links > 0")
    return known.join(classes, "base_name").select("lei", "class_lei", "n_links")


def snapshot_movement(spark: SparkSession, d: str) -> DataFrame:
    """Entity status by the deliveries up to 2019 against all deliveries."""
    rows = table(spark, d, "lei_entities", "record_id", "lei", "entity_status", "delivered_at").select(lei("lei").alias("lei"), "record_id", F.upper(F.trim("entity_status")).alias("entity_status"), "delivered_at")
    before = R.upsert_last(rows.where("delivered_at < timestamp_ntz '2020-01-01 00:00:00'"), ["lei"], "record_id")
    return R.compare_snapshots(before, R.upsert_last(rows, ["lei"], "record_id"), "lei", "entity_status")


def state_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last value of every attribute of the graph's nodes on record before 2018."""
    rows = table(spark, d, "graph_states", "node_id", "state_type", "state_value", "recorded_at", "source_event_id").where("recorded_at < timestamp_ntz '2018-01-01 00:00:00' and state_value.to_value is not null")
    return rows.groupBy(F.lower(F.trim("node_id")).alias("node_id"), "state_type").agg(F.max_by("state_value.to_value", F.struct("recorded_at", "source_event_id")).alias("value"))


def filings_before_document(spark: SparkSession, d: str) -> DataFrame:
    """Filings of the same issuer in the 365 days before a document: range join on the issuer and a yearly bucket, over days counted before."""
    filings = table(spark, d, "edgar_subsidiaries", "cik", "accession", "filing_date").select("cik", "accession", calendar_day(F.col("filing_date")).alias("day")).where("day is not null").distinct()
    filings = filings.groupBy("cik", "day").agg(F.count(F.lit(1)).alias("n")).withColumn("n_day", F.unix_date("day")).withColumn("bucket", F.explode(F.array(F.floor(F.col("n_day") / 366), F.floor(F.col("n_day") / 366) + 1)))
    docs = table(spark, d, "documents", "doc_id", "cik", "published_at").where("published_at is not null").withColumn("p_day", F.unix_date(F.to_date("published_at"))).withColumn("bucket", F.floor(F.col("p_day") / 366))
    hits = docs.join(filings.drop("day"), ["cik", "bucket"]).where("n_day <= p_day and n_day > p_day - 365")
    return hits.groupBy("doc_id").agg(F.sum("n").alias("n_filings"))


def seed_top(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty names of each query, a report."""
    return R.top_names(R.seeds(_known(spark, d), _queries(spark, d)))


def root_candidates_top(spark: SparkSession, d: str) -> DataFrame:
    """The best twenty candidates for each query's root, a report."""
    scratch = Scratch(spark)
    known, _, walks = _walks(spark, d, scratch)
    out = R.top_candidates(R.root_scores(scratch.write(walks), known, _queries(spark, d)))
    return out.select("query_id", "lei", F.round("score", 6).alias("score"), "place")


def endpoint_override(spark: SparkSession, d: str) -> DataFrame:
    """Names of both ends of every link, those of the study before the registry's."""
    given = table(spark, d, "study_companies", "lei", "company").select(lei("lei").alias("lei"), F.col("company").alias("name"))
    return R.named_ends(_edges(spark, d), _known(spark, d), given)


QUERIES = {f.__name__: f for f in (upsert_last_wins, relationship_upsert, relationship_load_counts, seed_phrase_match, upward_walk, root_vote_scores, root_resolution, or_endpoint_edges, relation_direction, company_expansion, endpoint_lookup, both_ends_known, not_in_groups, review_candidates_blocked, snapshot_movement, state_as_of, filings_before_document, seed_top, root_candidates_top, endpoint_override)}

_KNOWN = f"""known AS (SELECT lei, legal_name, jurisdiction, entity_status, {sql_fold('legal_name')} AS name FROM (
 SELECT upper(trim(lei)) AS lei, trim(legal_name) AS legal_name, trim(legal_jurisdiction) AS jurisdiction, trim(entity_status) AS entity_status FROM lei_entities WHERE trim(lei) <> ''
 QUALIFY row_number() OVER (PARTITION BY upper(trim(lei)) ORDER BY record_id DESC) = 1)),"""
_EDGES = f"""edges AS (SELECT upper(trim(child_lei)) AS child, upper(trim(parent_lei)) AS parent, bool_or(trim(relationship_type) = '{R.DIRECT}') AS direct, bool_or(trim(relationship_type) = '{R.ULTIMATE}') AS ultimate
 FROM relationships WHERE trim(relationship_type) IN ('{R.DIRECT}', '{R.ULTIMATE}') AND trim(child_lei) <> '' AND trim(parent_lei) <> '' GROUP BY 1, 2)"""
_SEEDS = f"""q AS (SELECT company_id AS query_id, CASE WHEN company_id % 4 = 0 THEN {sql_fold('sector')} ELSE split_part({sql_fold('company')}, ' ', 1) END AS query FROM study_companies),
hits AS (SELECT query_id, query, lei, legal_name, entity_status, name, name = query AS exact FROM known JOIN q ON contains(' ' || name || ' ', ' ' || query || ' ')),
seeds AS (SELECT *, CASE WHEN exact THEN 1.0 WHEN starts_with(name || ' ', query || ' ') THEN 0.95 ELSE 0.9 END::DOUBLE AS likeness FROM hits QUALIFY exact OR NOT bool_or(exact) OVER (PARTITION BY query_id)),"""
_WALK = _SEEDS + _EDGES.replace("WHERE", "WHERE upper(trim(relationship_status)) = 'ACTIVE' AND") + """,
w AS (SELECT query_id, lei AS seed, lei AS node, 0::BIGINT AS depth FROM seeds UNION SELECT w.query_id, w.seed, edges.parent, w.depth + 1 FROM w JOIN edges ON edges.child = w.node WHERE w.depth < 12),
s AS (SELECT query_id, seed, node, min(depth) AS depth FROM w GROUP BY 1, 2, 3),
fl AS (SELECT s.query_id, s.seed, e.parent AS node, bool_or(e.direct) AS direct, bool_or(e.ultimate) AS ultimate FROM s JOIN edges e ON e.child = s.node WHERE s.depth < 12 GROUP BY 1, 2, 3),
walks AS (SELECT s.query_id, s.seed, s.node, s.depth, coalesce(fl.direct, false) AS direct, coalesce(fl.ultimate, false) AS ultimate, s.depth < 12 AND s.node NOT IN (SELECT child FROM edges) AS terminal FROM s LEFT JOIN fl USING (query_id, seed, node))"""
_SCORES = _WALK + """,
inf AS (SELECT DISTINCT query_id, seed FROM walks WHERE node <> seed), tot AS (SELECT query_id, count(*) AS n_seeds FROM inf GROUP BY 1),
v AS (SELECT query_id, node, count(*) AS matched, count_if(direct) AS direct_votes, count_if(ultimate) AS ultimate_votes, count_if(terminal) AS terminal_votes, max(depth) AS max_depth FROM walks JOIN inf USING (query_id, seed) GROUP BY 1, 2),
c AS (SELECT n.query_id, n.node AS lei, k.legal_name, k.entity_status, coalesce(v.matched, 0) AS matched, coalesce(tot.n_seeds, 0) AS n_seeds, coalesce(v.direct_votes, 0) AS direct_votes, coalesce(v.ultimate_votes, 0) AS ultimate_votes,
 coalesce(v.terminal_votes, 0) AS terminal_votes, coalesce(v.max_depth, 0) AS max_depth, CASE WHEN coalesce(tot.n_seeds, 0) > 0 THEN coalesce(v.matched, 0)::DOUBLE / tot.n_seeds ELSE 0.0 END AS coverage,
 CASE WHEN coalesce(k.name, '') = '' THEN 0.0 WHEN k.name = q.query THEN 1.0 WHEN starts_with(k.name || ' ', q.query || ' ') THEN 0.95 WHEN contains(' ' || k.name || ' ', ' ' || q.query || ' ') THEN 0.9 ELSE 0.0 END::DOUBLE AS likeness
 FROM (SELECT DISTINCT query_id, node FROM walks) n JOIN q USING (query_id) LEFT JOIN v ON v.query_id = n.query_id AND v.node = n.node LEFT JOIN tot ON tot.query_id = n.query_id LEFT JOIN known k ON k.lei = n.node),
sc AS (SELECT *, coverage * 100 + ultimate_votes * 8 + terminal_votes * 5 + direct_votes * 2 + least(max_depth, 6) * 1.5::DOUBLE + likeness * 6 + CASE WHEN entity_status = 'ACTIVE' THEN 2.0 ELSE 0.0 END::DOUBLE AS score FROM c)"""
_TOUCH = _EDGES + """, r AS (SELECT DISTINCT upper(trim(lei)) AS root FROM study_companies),
t AS (SELECT DISTINCT root, child, parent, direct, ultimate FROM edges JOIN r ON r.root = edges.child OR r.root = edges.parent)"""
_RELATION = "CASE WHEN direct AND ultimate THEN 'DIRECT_AND_ULTIMATE' WHEN direct THEN 'DIRECT' ELSE 'ULTIMATE' END || '_' || CASE WHEN child = root THEN 'PARENT' ELSE 'CHILD' END"

ORACLE = {
    "upsert_last_wins": f"WITH {_KNOWN.rstrip(',')} SELECT lei, legal_name, jurisdiction, entity_status FROM known",
    "relationship_upsert": f"""SELECT upper(trim(child_lei)) AS child, upper(trim(parent_lei)) AS parent, trim(relationship_type) AS relationship_type, max(id) AS id, arg_max(struct_pack(s := relationship_status), id).s AS relationship_status FROM relationships
WHERE trim(relationship_type) IN ('{R.DIRECT}', '{R.ULTIMATE}') GROUP BY 1, 2, 3""",
    "relationship_load_counts": f"""SELECT count(*) AS scanned, count_if(sup AND com) AS supported, count_if(NOT sup) AS unsupported, count_if(sup AND NOT com) AS incomplete
FROM (SELECT coalesce(trim(relationship_type) IN ('{R.DIRECT}', '{R.ULTIMATE}'), false) AS sup, coalesce(trim(child_lei) <> '' AND trim(parent_lei) <> '', false) AS com FROM relationships)""",
    "seed_phrase_match": f"WITH {_KNOWN} {_SEEDS.rstrip(',')} SELECT query_id, lei, likeness FROM seeds",
    "upward_walk": f"WITH RECURSIVE {_KNOWN} {_WALK} SELECT * FROM walks",
    "root_vote_scores": f"WITH RECURSIVE {_KNOWN} {_SCORES} SELECT query_id, lei, matched, n_seeds, direct_votes, ultimate_votes, terminal_votes, max_depth, round(score, 6) AS score FROM sc",
    "root_resolution": f"""WITH RECURSIVE {_KNOWN} {_SCORES},
rk AS (SELECT *, row_number() OVER o AS place, lead(score) OVER o AS second, count(*) OVER (PARTITION BY query_id) AS n FROM sc WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, coverage DESC, ultimate_votes DESC, terminal_votes DESC, coalesce(legal_name, ''), lei)),
ex AS (SELECT query_id, count(*) AS n_exact, min(lei) AS exact_lei FROM seeds WHERE likeness = 1.0 AND entity_status = 'ACTIVE' GROUP BY 1),
z AS (SELECT rk.*, score - coalesce(second, 0.0) AS margin, coalesce(matched >= 2 AND coverage >= 0.6 AND (ultimate_votes >= 1 OR terminal_votes >= 2) AND score - coalesce(second, 0.0) >= 8, false) AS strong,
 coalesce(n_exact = 1 AND lei = exact_lei AND (second IS NULL OR score - second >= 8), false) AS single, coalesce(n = 1 AND likeness >= 0.9 AND entity_status = 'ACTIVE', false) AS alone FROM rk LEFT JOIN ex USING (query_id) WHERE place = 1)
SELECT query_id, lei, round(score, 6) AS score, round(margin, 6) AS margin, CASE WHEN strong OR single OR alone THEN 'AUTO_RESOLVED' ELSE 'REVIEW_REQUIRED' END AS status,
 CASE WHEN strong THEN 'HIGH' WHEN single OR alone OR coverage >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM z""",
    "seed_top": f"WITH {_KNOWN} {_SEEDS.rstrip(',')} SELECT query_id, lei, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN entity_status = 'ACTIVE' THEN 0 ELSE 1 END, coalesce(legal_name, ''), lei) AS place FROM seeds) WHERE place <= 50",
    "root_candidates_top": f"WITH RECURSIVE {_KNOWN} {_SCORES} SELECT query_id, lei, round(score, 6) AS score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coverage DESC, ultimate_votes DESC, terminal_votes DESC, coalesce(legal_name, ''), lei) AS place FROM sc) WHERE place <= 20",
    "endpoint_override": f"""WITH {_KNOWN} {_EDGES}, g AS (SELECT upper(trim(lei)) AS lei, min(company) AS name FROM study_companies WHERE company IS NOT NULL GROUP BY 1)
SELECT child, parent, coalesce(g1.name, a.legal_name, child) AS child_name, coalesce(g2.name, b.legal_name, parent) AS parent_name, CASE WHEN g1.name IS NOT NULL THEN 'OVERRIDE' WHEN a.legal_name IS NOT NULL THEN 'INDEX' ELSE 'UNRESOLVED' END AS child_source, CASE WHEN g2.name IS NOT NULL THEN 'OVERRIDE' WHEN b.legal_name IS NOT NULL THEN 'INDEX' ELSE 'UNRESOLVED' END AS parent_source
FROM edges LEFT JOIN known a ON a.lei = child LEFT JOIN known b ON b.lei = parent LEFT JOIN g g1 ON g1.lei = child LEFT JOIN g g2 ON g2.lei = parent""",
    "or_endpoint_edges": f"WITH {_TOUCH} SELECT * FROM t",
    "relation_direction": f"WITH {_TOUCH} SELECT root, {_RELATION} AS relation, count(*) AS n FROM t GROUP BY 1, 2",
    "company_expansion": f"""WITH {_KNOWN} {_TOUCH}, x AS (SELECT root, CASE WHEN child = root THEN parent ELSE child END AS lei, string_agg(DISTINCT {_RELATION}, ',' ORDER BY {_RELATION}) AS relations FROM t GROUP BY 1, 2)
SELECT root, x.lei, coalesce(k.legal_name, x.lei) AS name, relations, CASE WHEN k.legal_name IS NOT NULL THEN 'RESOLVED' ELSE 'UNRESOLVED_LEVEL1' END AS enrichment FROM x LEFT JOIN known k ON k.lei = x.lei""",
    "endpoint_lookup": f"WITH {_KNOWN} {_EDGES} SELECT child, parent, coalesce(a.legal_name, child) AS child_name, coalesce(b.legal_name, parent) AS parent_name FROM edges LEFT JOIN known a ON a.lei = child LEFT JOIN known b ON b.lei = parent",
    "both_ends_known": f"WITH {_KNOWN} {_EDGES} SELECT child, parent FROM edges WHERE child IN (SELECT lei FROM known) AND parent IN (SELECT lei FROM known)",
    "not_in_groups": "SELECT candidate_id, legal_name FROM entity_candidates WHERE candidate_id NOT IN (SELECT candidate_id FROM candidate_groups WHERE candidate_id IS NOT NULL)",
    "review_candidates_blocked": f"WITH {_KNOWN} b AS (SELECT lei, {sql_base('name')} AS base_name FROM known) SELECT lei, min(lei) OVER w AS class_lei, count(*) OVER w - 1 AS n_links FROM b WHERE base_name IS NOT NULL WINDOW w AS (PARTITION BY base_name) QUALIFY count(*) OVER w > 1",
    "snapshot_movement": """WITH r AS (SELECT upper(trim(lei)) AS lei, record_id, upper(trim(entity_status)) AS s, delivered_at FROM lei_entities WHERE lei IS NOT NULL),
a AS (SELECT lei, s FROM r WHERE delivered_at < TIMESTAMP '2020-01-01' QUALIFY row_number() OVER (PARTITION BY lei ORDER BY record_id DESC) = 1), b AS (SELECT lei, s FROM r QUALIFY row_number() OVER (PARTITION BY lei ORDER BY record_id DESC) = 1)
SELECT coalesce(a.lei, b.lei) AS lei, a.s AS value_before, b.s AS value_after, CASE WHEN a.lei IS NULL THEN 'ADDED' WHEN b.lei IS NULL THEN 'REMOVED' WHEN a.s IS NOT DISTINCT FROM b.s THEN 'SAME' ELSE 'CHANGED' END AS movement FROM a FULL JOIN b ON a.lei = b.lei""",
    "state_as_of": """SELECT lower(trim(node_id)) AS node_id, state_type, arg_max(state_value.to_value, (recorded_at, source_event_id)) AS value FROM graph_states WHERE recorded_at < TIMESTAMP '2018-01-01' AND state_value.to_value IS NOT NULL GROUP BY 1, 2""",
    "filings_before_document": f"""WITH f AS (SELECT DISTINCT cik, accession, {_DAY.format(c='filing_date')} AS day FROM edgar_subsidiaries)
SELECT doc_id, count(*) AS n_filings FROM documents d JOIN f ON f.cik = d.cik AND f.day <= d.published_at::DATE AND f.day > d.published_at::DATE - 365 GROUP BY doc_id""",
}
