"""Attribution of domains to entities from typed evidence, and what evidence is still missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of evidence by what they can do
IDENTITY_GRADE = ("OFFICIAL_WEBSITE", "RDAP_ATTRIBUTION_MATCH", "WHOIS_REGISTRANT", "CUSTOMER_SUPPLIED", "MANUAL_ANALYST")
CORROBORATING = ("RDAP_REGISTRANT", "RDAP_ORG", "CERTIFICATE_ORG", "CERTIFICATE_DOMAIN", "ASN_OWNERSHIP", "LEGAL_PRIVACY_DECLARATION", "EDGAR_REFERENCE", "DNS_OBSERVATION")
NEGATIVE = ("CONTRADICTORY_OWNERSHIP", "RDAP_ATTRIBUTION_CONFLICT")
# Capability, kind of evidence when it supports, kind when it contradicts
CAPABILITIES = {
    "RDAP_WHOIS": ("RDAP_REGISTRANT", "RDAP_ATTRIBUTION_CONFLICT"), "IP_ASN_OWNERSHIP": ("ASN_OWNERSHIP", "CONTRADICTORY_OWNERSHIP"), "TLS_CERTIFICATE": ("CERTIFICATE_ORG", "CONTRADICTORY_OWNERSHIP"),
    "DNS": ("DNS_OBSERVATION", "CONTRADICTORY_OWNERSHIP"), "HTTP_LEGAL_PRIVACY": ("LEGAL_PRIVACY_DECLARATION", "CONTRADICTORY_OWNERSHIP"), "CUSTOMER_ASSERTION": ("CUSTOMER_SUPPLIED", "CONTRADICTORY_OWNERSHIP"),
}
WATERFALL = ("RDAP_WHOIS", "IP_ASN_OWNERSHIP", "TLS_CERTIFICATE", "HTTP_LEGAL_PRIVACY")
EVIDENCE_KEY = ["entity", "domain", "provider", "evidence_type", "reference", "observed_value", "supports"]


def bridge(observations: DataFrame) -> DataFrame:
    """Observations (entity, domain, provider, capability, availability, observed_value, supports, reference) as evidence; missing and inconclusive ones are none."""
    rows = observations.where("availability not in ('MISSING', 'INCONCLUSIVE')")
    negative = (F.col("availability") == "CONTRADICTORY") | F.col("supports").eqNullSafe(F.lit(False))
    maps = [F.create_map(*(F.lit(x) for k, v in CAPABILITIES.items() for x in (k, v[i]))) for i in (0, 1)]
    kind = F.when(negative, F.coalesce(F.element_at(maps[1], F.col("capability")), F.lit("CONTRADICTORY_OWNERSHIP"))).otherwise(F.coalesce(F.element_at(maps[0], F.col("capability")), F.lit("OTHER")))
    return rows.select("entity", "domain", "provider", kind.alias("evidence_type"), "reference", "observed_value", (~negative).alias("supports"))


def unique_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.select(*EVIDENCE_KEY).distinct()


def evaluate(evidence: DataFrame) -> DataFrame:
    """(entity, domain, confidence, disposition, n_evidence): one contradiction rejects, identity-grade support accepts, the rest is for review."""
    yes, no = F.col("supports").eqNullSafe(F.lit(True)), F.col("supports").eqNullSafe(F.lit(False))
    rows = unique_evidence(evidence).groupBy("entity", "domain").agg(
        F.bool_or(F.col("evidence_type").isin(*NEGATIVE) | no).alias("against"), F.bool_or(F.col("evidence_type").isin(*IDENTITY_GRADE) & yes).alias("identity"),
        F.count_distinct(F.when(F.col("evidence_type").isin(*CORROBORATING) & yes, F.col("evidence_type"))).alias("kinds"), F.count(F.lit(1)).alias("n_evidence"),
    )
    confidence = F.when(F.col("against") | F.col("identity"), "HIGH").when(F.col("kinds") >= 2, "MEDIUM").when(F.col("kinds") == 1, "LOW").otherwise("UNKNOWN")
    return rows.select("entity", "domain", confidence.alias("confidence"), F.when(F.col("against"), "REJECT").when(F.col("identity"), "AUTO").otherwise("REVIEW").alias("disposition"), "n_evidence")


def shared_domain_conflicts(candidates: DataFrame) -> DataFrame:
    """``evaluate`` rows with (registrable) where accepted claims of two or more entities to one domain are all put back to review.

    Claimants are counted by an aggregate joined back, so that a domain with very many claims is no single task's.
    """
    sole = F.col("disposition") == "AUTO"
    claims = candidates.where(sole).groupBy("registrable").agg((F.min("entity") != F.max("entity")).alias("shared"))
    both = candidates.join(claims, "registrable", "left")
    down = sole & F.coalesce("shared", F.lit(False))
    return both.select("entity", "domain", "registrable", F.when(down, "MEDIUM").otherwise(F.col("confidence")).alias("confidence"), F.when(down, "REVIEW").otherwise(F.col("disposition")).alias("disposition"))


def gaps(observations: DataFrame, required: tuple[str, ...] = WATERFALL) -> DataFrame:
    """(entity, domain, capability, priority, reason): required capabilities that no provided or contradictory observation covers."""
    wanted = F.explode(F.array(*(F.struct(F.lit(c).alias("capability"), F.lit(i).alias("priority")) for i, c in enumerate(required, 1))))
    subjects = observations.select("entity", "domain").distinct().withColumn("w", wanted).select("entity", "domain", "w.*")
    have = observations.groupBy("entity", "domain", "capability").agg(F.bool_or(F.col("availability").isin("PROVIDED", "CONTRADICTORY")).alias("closed"), F.bool_or(F.col("availability") == "INCONCLUSIVE").alias("inconclusive"))
    reason = F.when(F.col("closed").isNull(), "NOT_PROVIDED").when(F.col("inconclusive"), "INCONCLUSIVE").otherwise("MARKED_MISSING")
    return subjects.join(have, ["entity", "domain", "capability"], "left").where("closed is null or not closed").select("entity", "domain", "capability", "priority", reason.alias("reason"))
