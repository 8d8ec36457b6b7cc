"""Queries p1, p3 and p6: intervals, histories and hierarchies, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.dates import day_text
from quillstone.operators import hierarchy, intervals, ledger
from quillstone.tables import table

_REL = ["child_lei", "parent_lei", "relationship_type", "relationship_status", "relationship_start", "relationship_end"]


def _relationships(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relationships", *_REL)


def _updates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    registry = table(spark, d, "lei_entities", "record_id", "delivered_at", "lei", "legal_name", "entity_status", "legal_address_city", "last_update_date")
    return registry, table(spark, d, "graph_states", "source_event_id", "node_id", "state_type", "effective_date", "state_value", "recorded_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.found_periods(_relationships(spark, d))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Periods, gaps and days covered of every child."""
    p = intervals.consolidation_periods(_relationships(spark, d))
    is_period = F.col("kind") == "PERIOD"
    return p.groupBy(F.col("key").alias("child_lei")).agg(
        F.count_if(is_period).alias("n_periods"), F.count_if(~is_period).alias("n_gaps"),
        F.sum(F.when(is_period & (F.col("end") < intervals.OPEN_END), F.col("end") - F.col("start")).otherwise(0)).cast("bigint").alias("closed_days"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ledger.found_versions(*_updates(spark, d))


def p3_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Every row ever on record, with both times."""
    rows = ledger.ledger(ledger.registry_updates(*_updates(spark, d)))
    stamp = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")
    return rows.select(*ledger.KEY, "value", day_text(F.col("valid_from")).alias("valid_from"), day_text(F.col("valid_to")).alias("valid_to"), stamp("recorded_from").alias("recorded_from"), stamp("recorded_to").alias("recorded_to"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.found_nodes(_relationships(spark, d))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.paths(hierarchy.forest(hierarchy.consolidation_links(_relationships(spark, d))))
    return out.select(F.col("id").alias("lei"), F.array_join("path", "/").alias("path"), "depth")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.descendant_intervals(hierarchy.forest(hierarchy.consolidation_links(_relationships(spark, d))))
    return out.select(F.col("id").alias("lei"), F.col("root").alias("root_lei"), "entry", "last_entry", "n_descendants")


QUERIES = {f.__name__: f for f in (p1_found, p1_coverage, p3_found, p3_ledger, p6_found, p6_paths, p6_descendants)}

_DAY = """CASE WHEN regexp_matches(trim({c}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?$') THEN try_cast(left(trim({c}), 10) AS DATE)
 WHEN regexp_matches(trim({c}), '^\\d{{8}}$') THEN try_cast(left(trim({c}), 4) || '-' || substr(trim({c}), 5, 2) || '-' || substr(trim({c}), 7, 2) AS DATE)
 WHEN regexp_matches(trim({c}), '^\\d{{1,2}}-[A-Za-z]{{3}}-\\d{{4}}$') THEN try_strptime(trim({c}), '%d-%b-%Y')::DATE
 WHEN regexp_matches(trim({c}), '^[A-Za-z]{{3,9}} \\d{{1,2}}, ?\\d{{4}}$') THEN coalesce(try_strptime(trim({c}), '%B %d, %Y'), try_strptime(trim({c}), '%b %d, %Y'))::DATE END"""

_PERIODS = f"""
WITH raw AS (
 SELECT upper(trim(child_lei)) AS k, {_DAY.format(c="relationship_start")} AS s,
  CASE WHEN relationship_end IS NULL OR trim(relationship_end) = '' OR trim(relationship_end) LIKE '9999%' THEN DATE '9999-12-31' ELSE {_DAY.format(c="relationship_end")} END AS e
 FROM relationships WHERE trim(relationship_type) = 'IS_DIRECTLY_CONSOLIDATED_BY'),
iv AS (SELECT DISTINCT k, s, e FROM raw WHERE k IS NOT NULL AND s IS NOT NULL AND e > s),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m),
p AS (SELECT k, isl, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY k, isl),
q AS (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY s) AS nxt FROM p)
"""

_TREE = """
WITH RECURSIVE l AS (
 SELECT upper(trim(child_lei)) AS c, min(upper(trim(parent_lei))) AS p FROM relationships
 WHERE trim(relationship_type) = 'IS_DIRECTLY_CONSOLIDATED_BY' AND upper(trim(relationship_status)) = 'ACTIVE' AND trim(child_lei) <> '' AND trim(parent_lei) <> '' GROUP BY 1),
al AS (SELECT DISTINCT upper(trim(child_lei)) AS c, upper(trim(parent_lei)) AS p FROM relationships
 WHERE trim(relationship_type) = 'IS_DIRECTLY_CONSOLIDATED_BY' AND upper(trim(relationship_status)) = 'ACTIVE' AND trim(child_lei) <> '' AND trim(parent_lei) <> ''),
n AS (SELECT c AS v FROM al UNION SELECT p FROM al),
t AS (SELECT v, v AS root, 0::BIGINT AS depth, v AS path FROM n WHERE v NOT IN (SELECT c FROM l)
 UNION ALL SELECT l.c, t.root, t.depth + 1, t.path || '/' || l.c FROM t JOIN l ON l.p = t.v),
r AS (SELECT c AS a, p AS b FROM l WHERE c NOT IN (SELECT v FROM t) UNION SELECT r.a, l.p FROM r JOIN l ON l.c = r.b),
cyc AS (SELECT a AS v FROM r WHERE a = b)
"""

_UPDATES = f"""
WITH inst AS (
 SELECT upper(trim(lei)) AS entity_id, record_id, legal_name, entity_status, legal_address_city,
  CASE WHEN regexp_matches(trim(last_update_date), '(Z|[+-]\\d{{2}}:?\\d{{2}})$') THEN try_cast(trim(last_update_date) AS TIMESTAMPTZ) ELSE try_cast(trim(last_update_date) || 'Z' AS TIMESTAMPTZ) END AS ts, delivered_at FROM lei_entities),
u AS (
 SELECT entity_id, a AS attribute_name, v, epoch_us(ts) AS ord, (DATE '1970-01-01' + (floor(epoch_us(ts) / 86400000000.0))::INT) AS d, epoch_us(delivered_at) AS rec, lpad(record_id::VARCHAR, 20, '0') AS ident
 FROM (SELECT *, unnest(['legal_name', 'entity_status', 'legal_address_city']) AS a, unnest([legal_name, entity_status, legal_address_city]) AS v FROM inst)
 UNION ALL
 SELECT lower(trim(node_id)), trim(state_type), state_value.to_value, epoch_us(recorded_at), {_DAY.format(c="effective_date")}, epoch_us(recorded_at), source_event_id FROM graph_states),
k AS (SELECT *, lower(upper(regexp_replace(v, '\\s+', '', 'g'))) AS vk FROM u WHERE entity_id IS NOT NULL AND attribute_name IS NOT NULL AND d IS NOT NULL AND trim(v) <> ''),
day AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY entity_id, attribute_name, d ORDER BY ord DESC, rec DESC, ident DESC) = 1),
f AS (SELECT *, lag(vk) OVER (PARTITION BY entity_id, attribute_name ORDER BY d) AS b FROM day),
w AS (SELECT entity_id, attribute_name, d, lead(d) OVER (PARTITION BY entity_id, attribute_name ORDER BY d) AS nxt, count(*) OVER (PARTITION BY entity_id, attribute_name) AS n FROM f WHERE b IS NULL OR b <> vk)
"""

# Every row ever on record: at each recording time of a key the winner of every day and the next day known
_LEDGER = _UPDATES + """,
o1 AS (SELECT entity_id, attribute_name, d, coalesce(ord, 0) AS ord, v, vk, min((coalesce(rec, 0), coalesce(ident, ''))) AS x FROM k WHERE vk <> '' GROUP BY ALL),
o2 AS (SELECT entity_id, attribute_name, d, v, vk, x[1] AS rec, x[2] AS ident, ord, (ord, x[1], x[2]) AS rk FROM o1),
o3 AS (SELECT *, max(rk) OVER (PARTITION BY entity_id, attribute_name, d ORDER BY rec, ord, ident ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o2),
o4 AS (SELECT *, lag(vk) OVER w AS b, row_number() OVER w AS i FROM o3 WHERE top IS NULL OR rk > top WINDOW w AS (PARTITION BY entity_id, attribute_name, d ORDER BY rec, ord, ident)),
o5 AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> vk THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, attribute_name, d ORDER BY i) AS run FROM o4),
o6 AS (SELECT *, first_value(v) OVER (PARTITION BY entity_id, attribute_name, d, run ORDER BY i) AS value FROM o5),
tm AS (SELECT DISTINCT entity_id, attribute_name, rec AS t FROM o6), dd AS (SELECT entity_id, attribute_name, d, min(rec) AS since FROM o6 GROUP BY ALL),
st AS (SELECT tm.entity_id, tm.attribute_name, dd.d, t, lead(dd.d) OVER (PARTITION BY tm.entity_id, tm.attribute_name, t ORDER BY dd.d) AS nxt FROM tm JOIN dd ON dd.entity_id = tm.entity_id AND dd.attribute_name = tm.attribute_name AND dd.since <= t),
sv AS (SELECT st.entity_id, st.attribute_name, st.d, st.t, st.nxt, arg_max(struct_pack(r := run, v := value, vk := vk), (rec, i)) AS z FROM st JOIN o6 ON o6.entity_id = st.entity_id AND o6.attribute_name = st.attribute_name AND o6.d = st.d AND o6.rec <= st.t GROUP BY ALL),
sl AS (SELECT *, lag((z.r, nxt)) OVER (PARTITION BY entity_id, attribute_name, d ORDER BY t) AS before FROM sv),
ch AS (SELECT * FROM sl WHERE before IS NULL OR before IS DISTINCT FROM (z.r, nxt)),
lg AS (SELECT entity_id, attribute_name, z.v AS value, z.vk AS value_key, d AS vf, coalesce(nxt, DATE '9999-12-31') AS vt, t AS rf, coalesce(lead(t) OVER (PARTITION BY entity_id, attribute_name, d ORDER BY t), 253402300799000000) AS rt FROM ch)
"""

# Sizes by all pairs of node and ancestor; siblings in order with the heavy one first
_ENTRIES = _TREE.rstrip() + """,
tp AS (SELECT t.v, l.p AS parent, t.root, t.depth FROM t LEFT JOIN l ON l.c = t.v),
up AS (SELECT v, v AS a FROM t UNION ALL SELECT up.v, tp.parent FROM up JOIN tp ON tp.v = up.a WHERE tp.parent IS NOT NULL),
sz AS (SELECT a AS v, count(*) AS size FROM up GROUP BY 1),
hv AS (SELECT tp.parent, arg_max(tp.v, (sz.size, tp.v)) AS heavy FROM tp JOIN sz USING (v) WHERE tp.parent IS NOT NULL GROUP BY 1),
sb AS (SELECT tp.v, tp.parent, coalesce(1 + sum(sz.size) OVER (PARTITION BY tp.parent ORDER BY tp.v <> hv.heavy, tp.v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS off FROM tp JOIN sz USING (v) JOIN hv ON hv.parent = tp.parent),
en AS (SELECT up.v, sum(coalesce(sb.off, 0))::BIGINT AS entry FROM up LEFT JOIN sb ON sb.v = up.a GROUP BY 1)
"""

ORACLE = {
    "p3_ledger": _LEDGER + """SELECT entity_id, attribute_name, value, strftime(vf, '%Y-%m-%d') AS valid_from, strftime(vt, '%Y-%m-%d') AS valid_to, strftime(make_timestamp(rf), '%Y-%m-%d %H:%M:%S') AS recorded_from, strftime(make_timestamp(rt), '%Y-%m-%d %H:%M:%S') AS recorded_to FROM lg""",
    "p6_descendants": _ENTRIES + """SELECT t.v AS lei, t.root AS root_lei, entry, entry + size - 1 AS last_entry, size - 1 AS n_descendants FROM t JOIN en USING (v) JOIN sz USING (v)""",
    "p1_found": _PERIODS + """SELECT k AS child_lei, 'PERIOD' AS kind, strftime(s, '%Y-%m-%d') AS period_start, strftime(e, '%Y-%m-%d') AS period_end FROM q WHERE n >= 2
UNION ALL SELECT k, 'GAP', strftime(e, '%Y-%m-%d'), strftime(nxt, '%Y-%m-%d') FROM q WHERE nxt IS NOT NULL""",
    "p1_coverage": _PERIODS + """SELECT k AS child_lei, count(*) AS n_periods, count(nxt) AS n_gaps, sum(CASE WHEN e < DATE '9999-12-31' THEN e - s ELSE 0 END)::BIGINT AS closed_days FROM q GROUP BY k""",
    "p3_found": _UPDATES + """SELECT entity_id, attribute_name, strftime(d, '%Y-%m-%d') AS valid_from, coalesce(strftime(nxt, '%Y-%m-%d'), '9999-12-31') AS valid_to FROM w WHERE n >= 2""",
    "p6_found": _TREE + """SELECT v AS lei, 'TREE' AS node_state, root AS root_lei, depth FROM t
UNION ALL SELECT a, CASE WHEN a IN (SELECT v FROM cyc) THEN 'CYCLE' ELSE 'UNDER_CYCLE' END, '', -1::BIGINT FROM (SELECT DISTINCT a FROM r)""",
    "p6_paths": _TREE + """SELECT v AS lei, path, depth FROM t""",
}
