"""The graph's nodes over time, entities resolved from all records, seeds and what the graph says of pairs, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.dates import calendar_day
from quillstone.operators import bridges as B
from quillstone.operators import evidence as V
from quillstone.operators import gold, registry
from quillstone.operators import resolution as R
from quillstone.operators import temporal as G
from quillstone.operators.intervals import lei
from quillstone.plans.data_queries import _DAY
from quillstone.plans.decision_queries import _OBS, _observations
from quillstone.plans.name_queries import sql_base, sql_fold, sql_identity, sql_place
from quillstone.plans.registry_queries import _EDGES, _KNOWN, _edges, _known
from quillstone.tables import table

AS_OF = "2012-01-01"


def _states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph_states", "node_id", "state_type", "effective_date", "state_value", "source_event_id")
    return rows.select(F.lower(F.trim("node_id")).alias("entity_key"), F.date_format(calendar_day(F.col("effective_date")), "yyyy-MM-dd").alias("day"), F.trim("state_type").alias("state_type"), F.col("state_value.to_value").alias("value"), F.col("source_event_id").alias("event_id")).where("entity_key is not null")


def node_state_log(spark: SparkSession, d: str) -> DataFrame:
    """Each node's states in order, as one text."""
    log = G.state_log(_states(spark, d))
    return log.select("entity_key", F.array_join(F.transform("log", lambda x: F.concat_ws("|", x["day"], F.coalesce(x["state_type"], F.lit("")), F.coalesce(x["value"], F.lit("")))), "\n").alias("log"))


def node_activity(spark: SparkSession, d: str) -> DataFrame:
    """Nodes active on a day by what is recorded of them."""
    return G.active_as_of(G.activity(_states(spark, d)), AS_OF)


def node_existence(spark: SparkSession, d: str) -> DataFrame:
    """Whether each node exists on a day: from its first legal form on, until its last legal status other than active."""
    s = _states(spark, d)
    per = s.groupBy("entity_key").agg(F.min(F.when(F.col("state_type") == "LEGAL_FORM", F.col("day"))).alias("start"), F.max(F.when((F.col("state_type") == "LEGAL_STATUS") & (F.upper(F.trim("value")) != "ACTIVE"), F.col("day"))).alias("end"))
    return per.select("entity_key", G.existence(F.col("start"), F.col("end"), AS_OF).alias("status"))


def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the graph by the first word of every registry entity's name; only names that lead to one node."""
    nodes = table(spark, d, "graph_states", "node_id", "canonical_name").groupBy(F.lower(F.trim("node_id")).alias("node_id")).agg(F.min("canonical_name").alias("canonical_name"))
    words = _known(spark, d).where("name is not null").select(F.split("name", " ")[0].alias("query")).distinct().withColumn("query_id", F.col("query"))
    return G.find_nodes(nodes, words)


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entity_candidates", "candidate_id", "provider_id", "legal_name", "other_names", "jurisdiction").where("candidate_id is not null")
    name, place = T.fold_name(F.col("legal_name")), T.jurisdiction_code(F.col("jurisdiction"))
    aliases = F.coalesce(F.array_distinct(F.filter(F.transform("other_names", T.fold_name), lambda x: x.isNotNull())), F.array().cast("array<string>"))
    return rows.select(F.col("candidate_id").alias("pos"), R.ids(name, place)["node_id"].alias("node_id"), F.col("legal_name").alias("name"), name.alias("name_normalized"), place.alias("jurisdiction"), aliases.alias("aliases"), "provider_id", F.lit(False).alias("is_root")).where("name_normalized is not null")


def resolved_records(spark: SparkSession, d: str) -> DataFrame:
    """Which record each provider record is merged into, by name and jurisdiction or a former name, and why."""
    return R.merge_records(_records(spark, d))


def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d)
    return R.resolved_nodes(rows, R.merge_records(rows)).select("into", "name_normalized", "jurisdiction", "n_records", F.size("provider_ids").alias("n_providers"), F.size("aliases").alias("n_aliases"))


def _parent_links(spark: SparkSession, d: str) -> DataFrame:
    """Links with the file that tells of them."""
    rel = table(spark, d, "relationships", "child_lei", "parent_lei", "relationship_type", "source_file").where(F.trim("relationship_type").isin(registry.DIRECT, registry.ULTIMATE))
    return rel.select(lei("child_lei").alias("subject"), F.trim("relationship_type").alias("predicate"), lei("parent_lei").alias("object"), F.trim("source_file").alias("source")).where("subject <> '' and object <> ''")


def pair_context(spark: SparkSession, d: str) -> DataFrame:
    """What the links say of entities whose names agree but for legal forms: each with the smallest of its class."""
    nodes = _known(spark, d).select(F.col("lei").alias("node_id"), F.col("name").alias("name_normalized"))
    pairs = R.review_candidates(nodes).where("node_id <> class_id").select(F.concat_ws("|", "class_id", "node_id").alias("packet_id"), F.col("class_id").alias("left_id"), F.col("node_id").alias("right_id"))
    return R.graph_context(pairs, _parent_links(spark, d)).select("left_id", "right_id", F.array_join("shared_parents", ",").alias("shared_parents"), "same_source", "both_have_parents")


def corporate_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Entities next to a studied company, with the worst standing of their names and what may be done with them."""
    roots = table(spark, d, "study_companies", "lei").select(lei("lei").alias("node_id")).distinct().withColumn("is_root", F.lit(True))
    known = _known(spark, d).select(F.col("lei").alias("node_id"), F.col("legal_name").alias("name"), "jurisdiction", F.lit(True).alias("known"))
    links = _edges(spark, d).select(F.col("child").alias("subject"), F.lit(registry.DIRECT).alias("predicate"), F.col("parent").alias("object"), F.lit("gleif").alias("provider"))
    every = links.select(F.explode(F.array("subject", "object")).alias("node_id")).distinct()
    nodes = every.join(known, "node_id", "left").join(roots, "node_id", "left").select("node_id", "name", "jurisdiction", F.coalesce("is_root", F.lit(False)).alias("is_root"))
    for end in ("subject", "object"):
        links = links.join(known.select(F.col("node_id").alias(end), "known"), end, "left").withColumn(f"{end}_standing", R.standing(F.coalesce("known", F.lit(False)), F.lit(True))).drop("known")
    return R.seeds(nodes, links).select("node_id", "name", "worst", "disposition", "n_links")


def disclosed_links(spark: SparkSession, d: str) -> DataFrame:
    """Rows of subsidiary lists as links from child to parent."""
    rows = table(spark, d, "edgar_subsidiaries", "row_id", "cik", "subsidiary_name", "relationship_label")
    label = F.col("relationship_label")
    return R.canonical_links(rows.select(F.col("cik").alias("subject"), F.when(label.isNull(), "SELF_OR_ULTIMATE_PARENT").when(label == "Branch", "BRANCH_OF").otherwise("HAS_SUBSIDIARY").alias("predicate"), F.trim("subsidiary_name").alias("object"), "row_id"))


def domain_facts(spark: SparkSession, d: str) -> DataFrame:
    """What domain candidates become as facts."""
    c = V.evaluate(V.bridge(_observations(spark, d))).withColumn("entity_name", F.col("entity"))
    return B.domain_facts(c).groupBy("status", "confidence", "pivot_eligible").agg(F.count(F.lit(1)).alias("n"))


def titles_loosely_same(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose title is, in whole words, a beginning of their issuer's name or the other way round."""
    docs = table(spark, d, "documents", "doc_id", "cik", "title").join(table(spark, d, "study_companies", "cik", "company"), "cik")
    return docs.select("doc_id", gold.loosely_same(F.col("title"), F.col("company")).alias("loosely_same"))


QUERIES = {f.__name__: f for f in (node_state_log, node_activity, node_existence, node_lookup, resolved_records, resolved_entities, pair_context, corporate_seeds, disclosed_links, domain_facts, titles_loosely_same)}

_STATES = f"""WITH st AS (SELECT lower(trim(node_id)) AS entity_key, strftime({_DAY.format(c='effective_date')}, '%Y-%m-%d') AS day, trim(state_type) AS state_type, state_value.to_value AS value FROM graph_states WHERE node_id IS NOT NULL)"""
_REC = f"""r AS (SELECT candidate_id AS pos, {sql_fold('legal_name')} AS n, {sql_place('jurisdiction')} AS j, list_distinct(coalesce([{sql_fold('x')} FOR x IN other_names IF {sql_fold('x')} IS NOT NULL], [])) AS al, provider_id FROM entity_candidates WHERE candidate_id IS NOT NULL),
rr AS (SELECT * FROM r WHERE n IS NOT NULL), a AS (SELECT pos, j, unnest(al) AS m FROM rr),
e AS (SELECT DISTINCT x.pos AS p, y.pos AS q FROM rr x JOIN rr y ON x.n = y.n AND x.j IS NOT DISTINCT FROM y.j UNION SELECT a.pos, rr.pos FROM a JOIN rr ON a.m = rr.n AND a.j IS NOT DISTINCT FROM rr.j UNION SELECT rr.pos, a.pos FROM a JOIN rr ON a.m = rr.n AND a.j IS NOT DISTINCT FROM rr.j),
w AS (SELECT pos AS v, pos AS o FROM rr UNION SELECT w.v, e.q FROM w JOIN e ON e.p = w.o), g AS (SELECT v AS pos, min(o) AS into_ FROM w GROUP BY 1)"""
_LINKS = f"""ln AS (SELECT upper(trim(child_lei)) AS s, upper(trim(parent_lei)) AS o, trim(source_file) AS f FROM relationships WHERE trim(relationship_type) IN ('{registry.DIRECT}', '{registry.ULTIMATE}') AND trim(child_lei) <> '' AND trim(parent_lei) <> '')"""
ORACLE = {
    "node_state_log": _STATES + " SELECT entity_key, string_agg(concat_ws('|', coalesce(day, ''), coalesce(state_type, ''), coalesce(value, '')), chr(10) ORDER BY coalesce(day, ''), state_type NULLS FIRST, value NULLS FIRST) AS log FROM st GROUP BY 1",
    "node_activity": _STATES + f", x AS (SELECT entity_key, min(day) AS first_seen, max(day) AS last_seen FROM st GROUP BY 1) SELECT * FROM x WHERE (first_seen IS NULL OR first_seen <= '{AS_OF}') AND (last_seen IS NULL OR last_seen > '{AS_OF}')",
    "node_existence": _STATES + f", x AS (SELECT entity_key, min(CASE WHEN state_type = 'LEGAL_FORM' THEN day END) AS s, max(CASE WHEN state_type = 'LEGAL_STATUS' AND upper(trim(value)) <> 'ACTIVE' THEN day END) AS e FROM st GROUP BY 1) SELECT entity_key, CASE WHEN s > '{AS_OF}' THEN 'NOT_YET_EXISTING' WHEN e <= '{AS_OF}' THEN 'ENDED' WHEN s IS NULL THEN 'UNKNOWN_START' ELSE 'EXISTING' END AS status FROM x",
    "node_lookup": f"""WITH {_KNOWN} n AS (SELECT lower(trim(node_id)) AS node_id, lower(min(canonical_name)) AS name FROM graph_states GROUP BY 1), q AS (SELECT DISTINCT split_part(name, ' ', 1) AS query FROM known WHERE name IS NOT NULL),
h AS (SELECT query, node_id, name FROM q JOIN n ON contains(name, query)), p AS (SELECT query, min(CASE WHEN name = query THEN node_id END) AS exact, count(DISTINCT node_id) AS c, min(node_id) AS only_ FROM h GROUP BY 1)
SELECT query AS query_id, coalesce(exact, CASE WHEN c = 1 THEN only_ END) AS node_id FROM p WHERE exact IS NOT NULL OR c = 1""",
    "resolved_records": f"""WITH RECURSIVE {_REC} SELECT g.pos, g.into_ AS "into", CASE WHEN g.pos = g.into_ THEN NULL WHEN x.n = y.n AND x.j IS NOT DISTINCT FROM y.j THEN 'exact_identity' ELSE 'former_name_same_jurisdiction' END AS reason FROM g JOIN rr x ON x.pos = g.pos JOIN rr y ON y.pos = g.into_""",
    "resolved_entities": f"""WITH RECURSIVE {_REC}, z AS (SELECT g.into_, count(*) AS n_records, count(DISTINCT rr.provider_id)::INT AS n_providers FROM g JOIN rr USING (pos) GROUP BY 1), na AS (SELECT g.into_, count(DISTINCT a.m)::INT AS c FROM g JOIN a USING (pos) GROUP BY 1)
SELECT z.into_ AS "into", rr.n AS name_normalized, rr.j AS jurisdiction, n_records, n_providers, coalesce(na.c, 0) AS n_aliases FROM z JOIN rr ON rr.pos = z.into_ LEFT JOIN na ON na.into_ = z.into_""",
    "pair_context": f"""WITH {_KNOWN} {_LINKS}, b AS (SELECT lei, {sql_base('name')} AS base FROM known), c AS (SELECT lei, min(lei) OVER (PARTITION BY base) AS cl FROM b WHERE base IS NOT NULL), p AS (SELECT cl, lei FROM c WHERE cl <> lei),
up AS (SELECT s, list(DISTINCT o) AS os, coalesce(list(DISTINCT f) FILTER (f IS NOT NULL), []) AS fs FROM ln GROUP BY 1)
SELECT cl AS left_id, lei AS right_id, array_to_string(list_sort(list_intersect(coalesce(x.os, []), coalesce(y.os, []))), ',') AS shared_parents, len(list_intersect(coalesce(x.fs, []), coalesce(y.fs, []))) > 0 AS same_source, x.s IS NOT NULL AND y.s IS NOT NULL AS both_have_parents FROM p LEFT JOIN up x ON x.s = cl LEFT JOIN up y ON y.s = lei""",
    "corporate_seeds": f"""WITH {_KNOWN} {_EDGES}, r AS (SELECT DISTINCT upper(trim(lei)) AS lei FROM study_companies), x AS (SELECT child AS v FROM edges WHERE parent IN (SELECT lei FROM r) UNION ALL SELECT parent FROM edges WHERE child IN (SELECT lei FROM r)),
y AS (SELECT v, count(*) AS n_links FROM x WHERE v NOT IN (SELECT lei FROM r) GROUP BY 1)
SELECT v AS node_id, k.legal_name AS name, CASE WHEN k.lei IS NULL THEN 'UNRESOLVED_RETRY' ELSE 'RESOLVED' END AS worst, CASE WHEN k.lei IS NULL THEN 'REVIEW_REQUIRED' ELSE 'SAFE_WITH_CONTEXT' END AS disposition, n_links FROM y LEFT JOIN known k ON k.lei = y.v""",
    "disclosed_links": """SELECT CASE WHEN relationship_label = 'Branch' THEN cik ELSE trim(subsidiary_name) END AS subject, CASE WHEN relationship_label = 'Branch' THEN 'BRANCH_OF' ELSE 'SUBSIDIARY_OF' END AS predicate, CASE WHEN relationship_label = 'Branch' THEN trim(subsidiary_name) ELSE cik END AS object, row_id FROM edgar_subsidiaries WHERE relationship_label IS NOT NULL""",
    "domain_facts": _OBS + " SELECT CASE disposition WHEN 'AUTO' THEN 'ACCEPTED' WHEN 'REJECT' THEN 'REJECTED' ELSE 'REVIEW' END AS status, confidence, disposition = 'AUTO' AND confidence = 'HIGH' AS pivot_eligible, count(*) AS n FROM p GROUP BY 1, 2, 3",
    "titles_loosely_same": f"""WITH x AS (SELECT doc_id, {sql_identity('title')} || ' ' AS a, {sql_identity('company')} || ' ' AS b FROM documents JOIN study_companies USING (cik)) SELECT doc_id, a <> ' ' AND b <> ' ' AND (starts_with(a, b) OR starts_with(b, a)) AS loosely_same FROM x""",
}
