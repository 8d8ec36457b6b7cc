"""Expansion, fact merging and event windows over whole tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import expansion as X
from quillstone.operators import registry as R
from quillstone.operators.intervals import lei
from quillstone.tables import table


MAX_ROUNDS = 200  # of an expansion to its end; one that has none by then raises


def _expanded(spark: SparkSession, d: str, max_rounds: int) -> tuple[DataFrame, list[dict], str]:
    seeds = table(spark, d, "study_companies", "company_id", "company", "lei").select(F.lit("ENTITY").alias("fact_type"), lei("lei").alias("value"), lei("lei").alias("identifier"), F.col("company").alias("subject"), F.lit("study").alias("source"), F.lit("HIGH").alias("confidence"), F.lit("ACCEPTED").alias("status"), F.lit(True).alias("pivot_eligible"), F.col("company_id").cast("bigint").alias("seq"))
    edges = R.links(table(spark, d, "relationships", "child_lei", "parent_lei", "relationship_type", "relationship_status"), "ACTIVE")
    facts, rounds, why = X.expand(seeds, {"registry": X.related_entities(edges)}, max_rounds)
    if errors := [f"round {r['iteration']}, {e['provider']}: {e['error']}" for r in rounds for e in r["errors"]]:
        raise RuntimeError("the expansion is not whole: " + "; ".join(errors))
    return facts.select("fact_type", "identifier", "confidence", "status"), rounds, why


def fixpoint_expansion(spark: SparkSession, d: str) -> DataFrame:
    """From all studied companies over direct links, as far as they lead within five rounds, the default of a run.

    A provider that fails ends the query, as its facts would be missing unseen. Where trusted facts still lead on after the last round, a warning tells it.
    """
    facts, rounds, why = _expanded(spark, d, 5)
    if why == "MAX_ITERATIONS_REACHED":
        warnings.warn(f"fixpoint_expansion: {why}, {rounds[-1]['new_pivots']} trusted facts of round {len(rounds)} were not followed", stacklevel=2)
    return facts


def expansion_to_the_end(spark: SparkSession, d: str) -> DataFrame:
    """From all studied companies until no trusted fact leads anywhere new; raises where that takes more than ``MAX_ROUNDS`` rounds."""
    facts, rounds, why = _expanded(spark, d, MAX_ROUNDS)
    if why == "MAX_ITERATIONS_REACHED":
        raise RuntimeError(f"expansion_to_the_end: {why}, {rounds[-1]['new_pivots']} trusted facts of round {len(rounds)} were not followed")
    return facts


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts told by accepted, reviewed and rejected packets about their first node."""
    p = table(spark, d, "eval_packets", "packet_id", "created_at", "candidate_a", "policy_name", "deterministic_evaluation")
    decision = F.upper(F.trim("deterministic_evaluation.decision"))
    return p.select(F.lit("entity").alias("fact_type"), F.trim("candidate_a.node_id").alias("value"), F.lit(None).cast("string").alias("identifier"), F.col("candidate_a.canonical_name").alias("subject"), F.trim("policy_name").alias("source"), F.when(F.col("deterministic_evaluation.score") >= 75, "HIGH").when(F.col("deterministic_evaluation.score") >= 45, "MEDIUM").otherwise("LOW").alias("confidence"), F.when(decision == "ACCEPT", "ACCEPTED").when(decision == "REJECT", "REJECTED").otherwise("REVIEW").alias("status"), (F.col("deterministic_evaluation.score") >= 80).alias("pivot_eligible"), (F.unix_micros(F.col("created_at").cast("timestamp")) * 1000 + F.pmod(F.crc32("packet_id"), F.lit(1000))).alias("seq")).where("value is not null")


def fact_merge(spark: SparkSession, d: str) -> DataFrame:
    return X.merge(_facts(spark, d)).select(F.lower("value").alias("node"), "confidence", "status", "flagged")


def fact_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.merge(_facts(spark, d)).agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("status") == "ACCEPTED").alias("accepted"), F.count_if(F.col("status") == "REVIEW").alias("review"), F.count_if(F.col("status") == "REJECTED").alias("rejected"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and kind: the batch twin of the streaming windows."""
    e = table(spark, d, "events", "ts", "event_type", "value")
    return e.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "ts", "user_id")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (fixpoint_expansion, expansion_to_the_end, fact_merge, fact_status_counts, event_windows, event_sessions)}

_FACTS = """WITH f AS (SELECT lower(trim(candidate_a.node_id)) AS node, CASE WHEN deterministic_evaluation.score >= 75 THEN 3 WHEN deterministic_evaluation.score >= 45 THEN 2 ELSE 1 END AS c,
 CASE WHEN upper(trim(deterministic_evaluation.decision)) = 'ACCEPT' THEN 2 WHEN upper(trim(deterministic_evaluation.decision)) = 'REJECT' THEN 0 ELSE 1 END AS s, created_at, packet_id FROM eval_packets WHERE candidate_a.node_id IS NOT NULL),
g AS (SELECT node, max(c) AS c, max(s) AS s, min(CASE WHEN s = 0 THEN created_at END) AS r, min(created_at) AS t, min(CASE WHEN s > 0 THEN created_at END) AS o FROM f GROUP BY 1),
m AS (SELECT node, ['UNKNOWN', 'LOW', 'MEDIUM', 'HIGH'][c + 1] AS confidence, CASE WHEN r = t AND (o IS NULL OR o > r) THEN 'REJECTED' ELSE ['REJECTED', 'REVIEW', 'ACCEPTED'][s + 1] END AS status, r = t AND s > 0 AND (o IS NULL OR o > r) AS flagged FROM g)"""
_LINKED = """WITH RECURSIVE e AS (SELECT upper(trim(child_lei)) AS c, upper(trim(parent_lei)) AS p, bool_or(trim(relationship_type) = 'IS_DIRECTLY_CONSOLIDATED_BY') AS d FROM relationships WHERE upper(trim(relationship_status)) = 'ACTIVE' AND trim(relationship_type) IN ('IS_DIRECTLY_CONSOLIDATED_BY', 'IS_ULTIMATELY_CONSOLIDATED_BY') AND trim(child_lei) <> '' AND trim(parent_lei) <> '' GROUP BY 1, 2),
a AS (SELECT c AS x, p AS y, d FROM e UNION ALL SELECT p, c, d FROM e)"""
_REACHED = " SELECT 'ENTITY' AS fact_type, n AS identifier, CASE WHEN bool_or(d) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, CASE WHEN bool_or(d) THEN 'ACCEPTED' ELSE 'REVIEW' END AS status FROM w GROUP BY n"
ORACLE = {
    "fact_merge": _FACTS + " SELECT node, confidence, status, coalesce(flagged, false) AS flagged FROM m",
    "fact_status_counts": _FACTS + " SELECT count(*) AS facts, count_if(status = 'ACCEPTED') AS accepted, count_if(status = 'REVIEW') AS review, count_if(status = 'REJECTED') AS rejected FROM m",
    "fixpoint_expansion": _LINKED + """, w AS (SELECT upper(trim(lei)) AS n, 0 AS k, true AS d FROM study_companies UNION SELECT a.y, w.k + 1, a.d FROM w JOIN a ON a.x = w.n WHERE w.d AND w.k < 5)""" + _REACHED,
    "expansion_to_the_end": _LINKED + """, w AS (SELECT upper(trim(lei)) AS n, true AS d FROM study_companies UNION SELECT a.y, a.d FROM w JOIN a ON a.x = w.n WHERE w.d)""" + _REACHED,
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "event_sessions": """WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT user_id, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, b ROWS UNBOUNDED PRECEDING) AS k FROM o),
c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1""",
}
