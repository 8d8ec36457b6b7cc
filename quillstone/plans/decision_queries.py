"""Pair decisions, evidence, the graph over time and disclosures over whole tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import adjudicate as A
from quillstone.operators import disclosure as D
from quillstone.operators import evidence as V
from quillstone.operators import ledger as L
from quillstone.operators import registrants as N
from quillstone.operators import registry as R
from quillstone.operators import temporal as G
from quillstone.plans.data_queries import _DAY, _LEDGER, _updates
from quillstone.plans.name_queries import sql_base, sql_fold, sql_id, sql_place
from quillstone.tables import table

AS_OF = "1995-06-30"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "entity_candidates", "candidate_id", "legal_name", "other_names", "jurisdiction", "registration_id", "legal_address")
    return A.group_pairs(table(spark, d, "candidate_groups"), records)


def pair_signals(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("dup_group", F.col("right.candidate_id").alias("candidate_id"), *(c.alias(n) for n, c in A.signals("left", "right").items()))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    have = A.signals("left", "right")
    return _pairs(spark, d).select("dup_group", F.col("right.candidate_id").alias("candidate_id"), *(c.alias(n) for n, c in A.decide(A.policy("SAME_ENTITY"), have).items()))


def pair_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).withColumn("score", F.round("score", 4))


def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).rollup("decision", "reason").agg(F.count(F.lit(1)).alias("n"))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations derived from the events: kind of event as capability, value as availability and polarity, property as domain."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value", "props")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("none"))
    n = F.floor(F.col("value")).cast("bigint")
    capability = F.element_at(F.create_map(*(F.lit(x) for kv in {"view": "RDAP_WHOIS", "click": "IP_ASN_OWNERSHIP", "error": "TLS_CERTIFICATE", "signup": "HTTP_LEGAL_PRIVACY", "purchase": "CUSTOMER_ASSERTION"}.items() for x in kv)), F.col("event_type"))
    availability = F.when(n % 7 == 0, "MISSING").when(n % 7 == 1, "INCONCLUSIVE").when(n % 41 == 2, "CONTRADICTORY").otherwise("PROVIDED")
    return e.where("value is not null").select(F.col("user_id").cast("string").alias("entity"), F.concat(F.lit("www.d"), k, F.lit(".example.com")).alias("domain"), F.lit("events").alias("provider"), capability.alias("capability"), availability.alias("availability"), n.cast("string").alias("observed_value"), F.when(n % 5 == 0, F.lit(None).cast("boolean")).otherwise(n % 37 != 3).alias("supports"), F.lit(None).cast("string").alias("reference"))


def evidence_bridge(spark: SparkSession, d: str) -> DataFrame:
    return V.bridge(_observations(spark, d)).groupBy("evidence_type", "supports").agg(F.count(F.lit(1)).alias("n"))


def evidence_unique(spark: SparkSession, d: str) -> DataFrame:
    return V.unique_evidence(V.bridge(_observations(spark, d))).select("entity", "domain", "evidence_type", "observed_value", "supports")


def evidence_policy(spark: SparkSession, d: str) -> DataFrame:
    return V.evaluate(V.bridge(_observations(spark, d)))


def shared_domain_conflict(spark: SparkSession, d: str) -> DataFrame:
    rows = V.evaluate(V.bridge(_observations(spark, d))).withColumn("registrable", F.regexp_replace("domain", "^www\\.", ""))
    return V.shared_domain_conflicts(rows)


def evidence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return V.gaps(_observations(spark, d))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Deals derived from orders: the priority as kind of event, keys as parties."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    kinds = F.array(*(F.lit(x) for x in ("AGREED_TO_ACQUIRE", "ACQUIRED", "SUBSIDIARY_OF", "MERGED_INTO", "RENAMED_TO")))
    kind = F.element_at(kinds, (F.ascii("o_orderpriority") - 48).cast("int"))
    a, b = F.concat(F.lit("Company "), (F.col("o_custkey") % 211).cast("string")), F.concat(F.lit("Company "), (F.col("o_orderkey") % 307).cast("string"))
    deal = kind.isin("AGREED_TO_ACQUIRE", "ACQUIRED")
    pick = lambda on, c: F.when(on, c)
    return o.select(T.stable_id("evt", F.col("o_orderkey").cast("string")).alias("event_id"), kind.alias("event_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), pick(deal, a).alias("acquirer"), pick(deal, b).alias("target"), pick(~deal, a).alias("subject"), pick(kind.isin("SUBSIDIARY_OF", "MERGED_INTO"), b).alias("object_entity"), pick(kind == "RENAMED_TO", b).alias("result_entity"))


def temporal_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(_events(spark, d))


def temporal_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(_events(spark, d)).select("edge_type", "edge_class", "subject", "object", "day", "end_day", "event_id")


def agreement_closure(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(_events(spark, d)).where("edge_type = 'AGREED_TO_ACQUIRE' and end_day is not null").select("subject", "object", "day", "end_day")


def temporal_asof_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.existence_as_of(G.nodes(_events(spark, d)), AS_OF)


def temporal_asof_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges_as_of(G.edges(_events(spark, d)), AS_OF).groupBy("edge_type", "edge_class").agg(F.count(F.lit(1)).alias("n"))


def ledger_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What was on record at the start of 2020 about the middle of 2018."""
    rows = G.attribute_as_of(L.ledger(L.registry_updates(*_updates(spark, d))), 17_713, 1_577_836_800_000_000)
    return rows.groupBy("attribute_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value_key").alias("n_values"))


def _appearances(spark: SparkSession, d: str) -> DataFrame:
    return D.appearances(table(spark, d, "edgar_subsidiaries", "cik", "accession", "filing_date", "subsidiary_name", "country"))


def disclosure_timeline(spark: SparkSession, d: str) -> DataFrame:
    return D.timeline(_appearances(spark, d))


def disclosure_changes(spark: SparkSession, d: str) -> DataFrame:
    return D.changes(_appearances(spark, d))


def disclosure_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.changes(_appearances(spark, d)).cube("cik", "change_type").agg(F.count(F.lit(1)).alias("n"))


def disclosure_missed(spark: SparkSession, d: str) -> DataFrame:
    return D.missed_days(_appearances(spark, d))


def _registrants(spark: SparkSession, d: str, least: dict[float | None, float]) -> DataFrame:
    """Registration data's records against the registry, from a name score by country score on."""
    c = table(spark, d, "entity_candidates", "candidate_id", "provider", "legal_name", "other_names", "legal_address", "jurisdiction").where("lower(provider) = 'rdap'")
    left = c.select(F.col("candidate_id").cast("string").alias("resource"), F.array_compact(F.concat(F.array("legal_name"), F.coalesce("other_names", F.array().cast("array<string>")))).alias("names"), F.concat_ws(" ", F.array_join("legal_address.lines", " "), "legal_address.city").alias("address"), T.jurisdiction_code(F.col("jurisdiction")).alias("country"))
    known = R.entities(table(spark, d, "lei_entities", "record_id", "lei", "legal_name", "legal_jurisdiction", "entity_status"))
    return N.match(left, known.select(F.col("lei").alias("entity_id"), F.array("legal_name").alias("names"), F.lit(None).cast("string").alias("address"), "jurisdiction"), least=least)


def registrant_matches(spark: SparkSession, d: str) -> DataFrame:
    kept = _registrants(spark, d, {1.0: 0.65, None: 0.65})  # all others are rejected
    return kept.where("decision <> 'reject'").select("resource", "entity_id", F.round("name_score", 6).alias("name_score"), "country_score", "decision")


def registrant_evidence(spark: SparkSession, d: str) -> DataFrame:
    telling = _registrants(spark, d, {1.0: 0.9, 0.0: 0.65})  # all others are no evidence
    return N.attribution_evidence(telling).groupBy("evidence_type", "supports").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (registrant_matches, registrant_evidence, pair_signals, pair_decision, decision_counts, evidence_bridge, evidence_unique, evidence_policy, shared_domain_conflict, evidence_gaps, temporal_nodes, temporal_edges, agreement_closure, temporal_asof_nodes, temporal_asof_edges, ledger_as_of, disclosure_timeline, disclosure_changes, disclosure_change_counts, disclosure_missed)}

_ADDR = "array_to_string([CASE w WHEN 'street' THEN 'st' WHEN 'road' THEN 'rd' WHEN 'avenue' THEN 'ave' WHEN 'boulevard' THEN 'blvd' WHEN 'suite' THEN 'ste' WHEN 'floor' THEN 'fl' ELSE w END FOR w IN string_split(trim(regexp_replace(lower(coalesce(concat_ws(' ', array_to_string(legal_address.lines, ' '), legal_address.city), '')), '[^a-z0-9]+', ' ', 'g')), ' ')], ' ')"
_SIGNALS = f"""WITH r AS (SELECT candidate_id, {sql_fold('legal_name')} AS name, {sql_place('jurisdiction')} AS place,
 CASE WHEN length(regexp_replace(upper(registration_id), '[^0-9]+', '', 'g')) >= 5 THEN [regexp_replace(upper(registration_id), '[^A-Z0-9]+', '', 'g')] ELSE [] END::VARCHAR[] AS ids,
 coalesce([{sql_fold('x')} FOR x IN other_names IF {sql_fold('x')} IS NOT NULL], [])::VARCHAR[] AS aliases, CASE WHEN legal_address IS NOT NULL THEN [{_ADDR}] ELSE [] END::VARCHAR[] AS addresses FROM entity_candidates),
b AS (SELECT *, {sql_base('name')} AS base FROM r), g AS (SELECT DISTINCT dup_group, candidate_id FROM candidate_groups), f AS (SELECT dup_group, min(candidate_id) AS first_id FROM g GROUP BY 1),
p AS (SELECT g.dup_group, g.candidate_id, x.name AS a, y.name AS b, x.base AS xb, y.base AS yb, x.place AS xp, y.place AS yp, x.ids AS xi, y.ids AS yi, x.aliases AS xa, y.aliases AS ya, x.addresses AS xd, y.addresses AS yd
 FROM g JOIN f USING (dup_group) JOIN b x ON x.candidate_id = f.first_id JOIN b y ON y.candidate_id = g.candidate_id WHERE g.candidate_id <> f.first_id),
s AS (SELECT dup_group, candidate_id, coalesce(a = b, false) AS exact_name, coalesce(xb = yb, false) AS exact_base,
 CASE WHEN length(a) > 0 AND length(b) > 0 THEN 1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END AS levenshtein_ratio,
 CASE WHEN length(a) > 0 AND length(b) > 0 THEN len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' '))))::DOUBLE / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) END AS token_jaccard,
 coalesce(xp = yp, false) AS place_match, coalesce(xp <> yp, false) AS place_conflict, len(list_intersect(xi, yi)) > 0 AS exact_identifier, len(xi) > 0 AND len(yi) > 0 AND len(list_intersect(xi, yi)) = 0 AS identifier_conflict,
 coalesce(list_contains(xa, b), false) OR coalesce(list_contains(ya, a), false) AS former_name_match, len(list_intersect(xd, yd)) > 0 AS shared_address FROM p)"""
_DECIDED = _SIGNALS + """, sc AS (SELECT *, CASE WHEN exact_name THEN 35.0 ELSE 0 END::DOUBLE + CASE WHEN exact_base THEN 15.0 ELSE 0 END::DOUBLE + CASE WHEN place_match THEN 20.0 ELSE 0 END::DOUBLE + CASE WHEN shared_address THEN 8.0 ELSE 0 END::DOUBLE
 + (coalesce(levenshtein_ratio * 12.0::DOUBLE, 0) + coalesce(token_jaccard * 10.0::DOUBLE, 0)) AS score FROM s),
dc AS (SELECT dup_group, candidate_id, score, CASE WHEN identifier_conflict THEN 'REJECT' WHEN exact_identifier OR former_name_match THEN 'ACCEPT' WHEN place_conflict THEN 'REJECT' WHEN score >= 75 THEN 'ACCEPT' WHEN score >= 45 THEN 'REVIEW' ELSE 'REJECT' END AS decision,
 CASE WHEN identifier_conflict THEN 'HARD_IDENTIFIER_CONFLICT' WHEN exact_identifier OR former_name_match THEN 'EXPLICIT_CONTINUITY_OR_IDENTIFIER' WHEN place_conflict THEN 'DISTINCT_BY_JURISDICTION' WHEN score >= 75 THEN 'SUFFICIENT_SIGNAL_AGREEMENT' WHEN score >= 45 THEN 'AMBIGUOUS_SIGNAL_AGREEMENT' ELSE 'INSUFFICIENT_IDENTITY_EVIDENCE' END AS reason FROM sc)"""
_OBS = """WITH n AS (SELECT *, floor(value)::BIGINT AS n FROM events WHERE value IS NOT NULL),
o AS (SELECT user_id::VARCHAR AS entity, 'www.d' || coalesce(json_extract_string(props, '$.k'), 'none') || '.example.com' AS domain, CASE event_type WHEN 'view' THEN 'RDAP_WHOIS' WHEN 'click' THEN 'IP_ASN_OWNERSHIP' WHEN 'error' THEN 'TLS_CERTIFICATE' WHEN 'signup' THEN 'HTTP_LEGAL_PRIVACY' WHEN 'purchase' THEN 'CUSTOMER_ASSERTION' END AS capability,
 CASE WHEN n % 7 = 0 THEN 'MISSING' WHEN n % 7 = 1 THEN 'INCONCLUSIVE' WHEN n % 41 = 2 THEN 'CONTRADICTORY' ELSE 'PROVIDED' END AS availability, n::VARCHAR AS observed_value, CASE WHEN n % 5 = 0 THEN NULL ELSE n % 37 <> 3 END AS supports FROM n),
z AS (SELECT *, availability = 'CONTRADICTORY' OR supports IS NOT DISTINCT FROM false AS neg FROM o WHERE availability NOT IN ('MISSING', 'INCONCLUSIVE')),
ev AS (SELECT entity, domain, observed_value, NOT neg AS supports, CASE WHEN neg THEN CASE capability WHEN 'RDAP_WHOIS' THEN 'RDAP_ATTRIBUTION_CONFLICT' ELSE 'CONTRADICTORY_OWNERSHIP' END ELSE CASE capability WHEN 'RDAP_WHOIS' THEN 'RDAP_REGISTRANT' WHEN 'IP_ASN_OWNERSHIP' THEN 'ASN_OWNERSHIP' WHEN 'TLS_CERTIFICATE' THEN 'CERTIFICATE_ORG' WHEN 'HTTP_LEGAL_PRIVACY' THEN 'LEGAL_PRIVACY_DECLARATION' WHEN 'CUSTOMER_ASSERTION' THEN 'CUSTOMER_SUPPLIED' ELSE 'OTHER' END END AS evidence_type FROM z),
u AS (SELECT DISTINCT * FROM ev),
c AS (SELECT entity, domain, bool_or(NOT supports) AS against, bool_or(evidence_type = 'CUSTOMER_SUPPLIED' AND supports) AS ident, count(DISTINCT CASE WHEN supports AND evidence_type IN ('RDAP_REGISTRANT', 'ASN_OWNERSHIP', 'CERTIFICATE_ORG', 'LEGAL_PRIVACY_DECLARATION') THEN evidence_type END) AS kinds, count(*) AS n_evidence FROM u GROUP BY 1, 2),
p AS (SELECT entity, domain, CASE WHEN against OR ident THEN 'HIGH' WHEN kinds >= 2 THEN 'MEDIUM' WHEN kinds = 1 THEN 'LOW' ELSE 'UNKNOWN' END AS confidence, CASE WHEN against THEN 'REJECT' WHEN ident THEN 'AUTO' ELSE 'REVIEW' END AS disposition, n_evidence FROM c)"""
_EVENTS = f"""WITH k AS (SELECT *, ['AGREED_TO_ACQUIRE', 'ACQUIRED', 'SUBSIDIARY_OF', 'MERGED_INTO', 'RENAMED_TO'][ascii(o_orderpriority) - 48] AS event_type, 'Company ' || (o_custkey % 211) AS a, 'Company ' || (o_orderkey % 307) AS b FROM orders),
ev AS (SELECT {sql_id('evt', 'o_orderkey::VARCHAR')} AS event_id, event_type, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN event_type IN ('AGREED_TO_ACQUIRE', 'ACQUIRED') THEN a END AS acquirer, CASE WHEN event_type IN ('AGREED_TO_ACQUIRE', 'ACQUIRED') THEN b END AS target,
 CASE WHEN event_type NOT IN ('AGREED_TO_ACQUIRE', 'ACQUIRED') THEN a END AS subject, CASE WHEN event_type IN ('SUBSIDIARY_OF', 'MERGED_INTO') THEN b END AS object_entity, CASE WHEN event_type = 'RENAMED_TO' THEN b END AS result_entity FROM k),
m AS (SELECT event_id, day, unnest([acquirer, target, subject, object_entity, result_entity]) AS name, unnest(range(5)) AS place FROM ev), mm AS (SELECT *, CASE WHEN place < 2 THEN 'COMPANY' ELSE 'ENTITY' END AS role, lower(trim(name)) AS entity_key FROM m WHERE name IS NOT NULL),
en AS (SELECT lower(trim(subject)) AS entity_key, arg_max(day, (coalesce(day, ''), event_id)) AS existence_end FROM ev WHERE (event_type = 'MERGED_INTO' AND subject <> object_entity) OR (event_type IN ('CONVERTED_TO', 'RENAMED_TO') AND subject <> result_entity) GROUP BY 1),
nd AS (SELECT entity_key, arg_min(name, (coalesce(day, ''), event_id, place)) AS canonical_name, arg_min(role, (coalesce(day, ''), event_id, place)) AS role, min(day) AS observed_from FROM mm GROUP BY 1),
nodes AS (SELECT {sql_id('node', 'canonical_name', digits=20)} AS node_id, canonical_name, entity_key, role, observed_from, existence_end FROM nd LEFT JOIN en USING (entity_key)),
tn AS (SELECT *, sum(CASE WHEN event_type = 'AGREED_TO_ACQUIRE' THEN 1 ELSE 0 END) OVER (PARTITION BY acquirer, target ORDER BY coalesce(day, ''), event_id ROWS UNBOUNDED PRECEDING) AS turn FROM ev WHERE event_type IN ('AGREED_TO_ACQUIRE', 'ACQUIRED')),
cl AS (SELECT acquirer, target, turn, arg_max(day, (coalesce(day, ''), event_id)) AS end_day FROM tn WHERE event_type = 'ACQUIRED' AND turn > 0 GROUP BY 1, 2, 3),
ed AS (SELECT event_type AS edge_type, 'EVENT' AS edge_class, tn.acquirer AS subject, tn.target AS object, day, end_day, event_id FROM tn LEFT JOIN cl ON cl.acquirer = tn.acquirer AND cl.target = tn.target AND cl.turn = tn.turn WHERE event_type = 'AGREED_TO_ACQUIRE'
 UNION ALL SELECT event_type, 'EVENT', acquirer, target, day, NULL, event_id FROM ev WHERE event_type = 'ACQUIRED' UNION ALL SELECT 'CORPORATE_OWNS', 'STATE', acquirer, target, day, NULL, event_id FROM ev WHERE event_type = 'ACQUIRED'
 UNION ALL SELECT event_type, 'STATE', subject, object_entity, day, NULL, event_id FROM ev WHERE event_type = 'SUBSIDIARY_OF' UNION ALL SELECT 'CORPORATE_OWNS', 'STATE', object_entity, subject, day, NULL, event_id FROM ev WHERE event_type = 'SUBSIDIARY_OF'
 UNION ALL SELECT event_type, 'EVENT', subject, object_entity, day, NULL, event_id FROM ev WHERE event_type = 'MERGED_INTO' UNION ALL SELECT event_type, 'EVENT', subject, result_entity, day, NULL, event_id FROM ev WHERE event_type = 'RENAMED_TO')"""
_APP = f"""WITH ap AS (SELECT DISTINCT * FROM (SELECT cik, {sql_fold('subsidiary_name')} AS identity, strftime({_DAY.format(c='filing_date')}, '%Y-%m-%d') AS day, accession, trim(subsidiary_name) AS name, trim(country) AS country FROM edgar_subsidiaries) WHERE cik IS NOT NULL AND identity IS NOT NULL AND day IS NOT NULL),
dy AS (SELECT cik, day, row_number() OVER w AS k, count(*) OVER (PARTITION BY cik) AS n, lead(day) OVER w AS nxt, lag(day) OVER w AS prv FROM (SELECT DISTINCT cik, day FROM ap) WINDOW w AS (PARTITION BY cik ORDER BY day))"""
_CHG = _APP + """, sn AS (SELECT cik, identity, day, array_to_string(list_sort(list(DISTINCT name)), chr(10)) AS names, array_to_string(list_sort(coalesce(list(DISTINCT country) FILTER (country IS NOT NULL), [])), chr(10)) AS countries FROM ap GROUP BY 1, 2, 3),
fw AS (SELECT sn.*, dy.nxt, b.names AS names2, b.countries AS countries2 FROM sn JOIN dy ON dy.cik = sn.cik AND dy.day = sn.day LEFT JOIN sn b ON b.cik = sn.cik AND b.identity = sn.identity AND b.day = dy.nxt WHERE dy.nxt IS NOT NULL),
ch AS (SELECT cik, identity, day AS previous_day, nxt AS current_day, 'DISAPPEARED_FROM_DISCLOSURE' AS change_type FROM fw WHERE names2 IS NULL UNION ALL SELECT cik, identity, day, nxt, 'NAME_TEXT_CHANGED' FROM fw WHERE names <> names2 UNION ALL SELECT cik, identity, day, nxt, 'JURISDICTION_TEXT_CHANGED' FROM fw WHERE countries <> countries2
 UNION ALL SELECT sn.cik, sn.identity, dy.prv, sn.day, CASE WHEN (SELECT min(day) FROM sn f WHERE f.cik = sn.cik AND f.identity = sn.identity) < dy.prv THEN 'REAPPEARED_IN_DISCLOSURE' ELSE 'APPEARED_IN_DISCLOSURE' END
 FROM sn JOIN dy ON dy.cik = sn.cik AND dy.day = sn.day LEFT JOIN sn b ON b.cik = sn.cik AND b.identity = sn.identity AND b.day = dy.prv WHERE dy.prv IS NOT NULL AND b.cik IS NULL)"""

ORACLE = {
    "pair_signals": _SIGNALS + " SELECT * FROM s",
    "pair_decision": _DECIDED + " SELECT dup_group, candidate_id, round(score, 4) AS score, decision, reason FROM dc",
    "decision_counts": _DECIDED + " SELECT decision, reason, count(*) AS n FROM dc GROUP BY ROLLUP (decision, reason)",
    "evidence_bridge": _OBS + " SELECT evidence_type, supports, count(*) AS n FROM ev GROUP BY 1, 2",
    "evidence_unique": _OBS + " SELECT entity, domain, evidence_type, observed_value, supports FROM u",
    "evidence_policy": _OBS + " SELECT * FROM p",
    "shared_domain_conflict": _OBS + """, g AS (SELECT *, regexp_replace(domain, '^www\\.', '') AS registrable FROM p), cl AS (SELECT registrable FROM g WHERE disposition = 'AUTO' GROUP BY 1 HAVING count(DISTINCT entity) > 1)
SELECT entity, domain, registrable, CASE WHEN disposition = 'AUTO' AND registrable IN (SELECT registrable FROM cl) THEN 'MEDIUM' ELSE confidence END AS confidence, CASE WHEN disposition = 'AUTO' AND registrable IN (SELECT registrable FROM cl) THEN 'REVIEW' ELSE disposition END AS disposition FROM g""",
    "evidence_gaps": _OBS + """, su AS (SELECT DISTINCT entity, domain FROM o), rq AS (SELECT unnest(['RDAP_WHOIS', 'IP_ASN_OWNERSHIP', 'TLS_CERTIFICATE', 'HTTP_LEGAL_PRIVACY']) AS capability, unnest([1, 2, 3, 4]) AS priority),
h AS (SELECT entity, domain, capability, bool_or(availability IN ('PROVIDED', 'CONTRADICTORY')) AS closed, bool_or(availability = 'INCONCLUSIVE') AS inc FROM o GROUP BY 1, 2, 3)
SELECT su.entity, su.domain, rq.capability, priority, CASE WHEN closed IS NULL THEN 'NOT_PROVIDED' WHEN inc THEN 'INCONCLUSIVE' ELSE 'MARKED_MISSING' END AS reason FROM su CROSS JOIN rq LEFT JOIN h ON h.entity = su.entity AND h.domain = su.domain AND h.capability = rq.capability WHERE closed IS NULL OR NOT closed""",
    "ledger_as_of": _LEDGER + " SELECT attribute_name, count(*) AS n, count(DISTINCT value_key) AS n_values FROM lg WHERE vf <= DATE '2018-07-01' AND vt > DATE '2018-07-01' AND rf <= 1577836800000000 AND rt > 1577836800000000 GROUP BY 1",
    "temporal_nodes": _EVENTS + " SELECT * FROM nodes",
    "temporal_edges": _EVENTS + " SELECT * FROM ed",
    "agreement_closure": _EVENTS + " SELECT subject, object, day, end_day FROM ed WHERE edge_type = 'AGREED_TO_ACQUIRE' AND end_day IS NOT NULL",
    "temporal_asof_nodes": _EVENTS + f" SELECT node_id, canonical_name, CASE WHEN existence_end <= '{AS_OF}' THEN 'ENDED' ELSE 'UNKNOWN_START' END AS status FROM nodes",
    "temporal_asof_edges": _EVENTS + f" SELECT edge_type, edge_class, count(*) AS n FROM ed WHERE CASE WHEN edge_class = 'STATE' THEN (day IS NULL OR day <= '{AS_OF}') AND (end_day IS NULL OR end_day > '{AS_OF}') ELSE day <= '{AS_OF}' END GROUP BY 1, 2",
    "disclosure_timeline": _APP + """, pr AS (SELECT cik, identity, arg_max(name, (day, accession, name)) AS canonical_name, min(day) AS first_observed, max(day) AS last_observed, count(*) AS n_observed, count(DISTINCT day) AS n_dates FROM ap GROUP BY 1, 2)
SELECT pr.*, b.k - a.k + 1 - n_dates AS n_missed, b.k = b.n AS current FROM pr JOIN dy a ON a.cik = pr.cik AND a.day = first_observed JOIN dy b ON b.cik = pr.cik AND b.day = last_observed""",
    "disclosure_missed": _APP + """, iv AS (SELECT cik, identity, min(day) AS a, max(day) AS b FROM ap GROUP BY 1, 2) SELECT iv.cik, identity, dy.day FROM iv JOIN dy ON dy.cik = iv.cik AND dy.day > a AND dy.day < b WHERE NOT EXISTS (SELECT 1 FROM ap WHERE ap.cik = iv.cik AND ap.identity = iv.identity AND ap.day = dy.day)""",
    "disclosure_changes": _CHG + " SELECT * FROM ch",
    "disclosure_change_counts": _CHG + " SELECT cik, change_type, count(*) AS n FROM ch GROUP BY CUBE (cik, change_type)",
}
