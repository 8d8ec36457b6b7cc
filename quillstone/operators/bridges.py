"""From candidates and events to facts, and the providers of the expansion that give them.

A provider takes the frontier's facts and the round and gives facts as ``expansion`` merges them, without ``seq``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import identity_key
from quillstone.operators.expansion import FACT, Provider

SELF = "REGISTRANT_SELF_REFERENCE"
COLUMNS = [c.split()[0] for c in FACT.split(", ")[:-1]]


def domain_facts(candidates: DataFrame) -> DataFrame:
    """Facts of evaluated domain candidates (entity, entity_name, domain, confidence, disposition); nothing is weighed anew. Only AUTO with HIGH may lead on."""
    d, c = F.upper("disposition"), F.upper("confidence")
    return candidates.select(F.lit("DOMAIN").alias("fact_type"), F.col("domain").alias("value"), F.col("entity").alias("identifier"), F.col("entity_name").alias("subject"), F.lit("DOMAIN_CANDIDATES").alias("source"), c.alias("confidence"),
                             F.when(d == "AUTO", "ACCEPTED").when(d == "REJECT", "REJECTED").otherwise("REVIEW").alias("status"), F.coalesce((d == "AUTO") & (c == "HIGH"), F.lit(False)).alias("pivot_eligible"))


def other_party(subject: Column, object_: Column, pivot: Column) -> Column:
    """The end of an event that isn't the pivot: opposite the registrant's own mention, else opposite the pivot's identity; null where both or neither are."""
    s, o, p = identity_key(subject), identity_key(object_), identity_key(pivot)
    return F.when(subject == SELF, object_).when(object_ == SELF, subject).when((s == p) & ~o.eqNullSafe(p), object_).when((o == p) & ~s.eqNullSafe(p), subject)


def event_facts(events: DataFrame, authorize: Callable[[], Column] | None = None) -> DataFrame:
    """One fact a counterparty of each pivot from ``events`` (pivot, subject, object, event_type, status, rule, document).

    Counterparties agree by identity. A fact is for review and leads nowhere unless ``authorize``, a condition on an event,
    holds for one of its events.
    """
    ok = F.coalesce(authorize(), F.lit(False)) if authorize else F.lit(False)
    named = events.withColumns({"party": other_party(F.col("subject"), F.col("object"), F.col("pivot")), "ok": ok}).withColumn("key", identity_key(F.col("party"))).where("party is not null and key <> ''")
    one = named.groupBy("pivot", "key").agg(F.min_by("party", F.struct("document", "party")).alias("party"), F.bool_or("ok").alias("ok"), F.count(F.lit(1)).alias("n_events"))
    return one.select(F.lit("LEGAL_ENTITY").alias("fact_type"), F.col("party").alias("value"), F.lit(None).cast("string").alias("identifier"), F.col("pivot").alias("subject"), F.lit("EDGAR_MA").alias("source"),
                      F.when(F.col("ok"), "HIGH").otherwise("MEDIUM").alias("confidence"), F.when(F.col("ok"), "ACCEPTED").otherwise("REVIEW").alias("status"), F.col("ok").alias("pivot_eligible"))


def event_provider(events: DataFrame, authorize: Callable[[], Column] | None = None) -> Provider:
    """Counterparties of the frontier's companies. ``events``: (company, subject, object, event_type, status, rule, document), met by the company's identity."""
    keyed = events.withColumn("_k", identity_key(F.col("company"))).where("_k <> ''")

    def provide(frontier: DataFrame, n: int) -> DataFrame:
        at = frontier.where("upper(fact_type) in ('COMPANY', 'LEGAL_ENTITY', 'ENTITY')").select(F.col("value").alias("pivot")).distinct().withColumn("_k", identity_key(F.col("pivot")))
        return event_facts(keyed.join(at, "_k"), authorize)

    return provide


def identity_provider(roots: DataFrame) -> Provider:
    """The resolved root of frontier facts that have a name and no identifier. ``roots``: (query, lei, legal_name, status, confidence); only AUTO_RESOLVED ones give a fact."""
    sure = roots.where("status = 'AUTO_RESOLVED' and lei is not null").withColumn("_k", F.lower(F.trim("query")))

    def provide(frontier: DataFrame, n: int) -> DataFrame:
        at = frontier.where("upper(fact_type) in ('COMPANY', 'LEGAL_ENTITY', 'ENTITY') and (identifier is null or trim(identifier) = '')").select(F.lower(F.trim("value")).alias("_k"), "value").distinct()
        got = at.join(sure.withColumnRenamed("status", "_s"), "_k")
        return got.select(F.lit("LEGAL_ENTITY").alias("fact_type"), F.coalesce("legal_name", "value").alias("value"), F.col("lei").alias("identifier"), F.col("value").alias("subject"), F.lit("GLEIF_IDENTITY_FALLBACK").alias("source"), F.coalesce("confidence", F.lit("MEDIUM")).alias("confidence"), F.lit("ACCEPTED").alias("status"), F.lit(True).alias("pivot_eligible"))

    return provide


def candidate_provider(candidates: DataFrame) -> Provider:
    """Domain facts of the frontier's entities. ``candidates``: as ``domain_facts``, met by the entity's identifier, else by its name."""

    def provide(frontier: DataFrame, n: int) -> DataFrame:
        at = frontier.where("upper(fact_type) <> 'DOMAIN'").select(F.lower(F.trim("identifier")).alias("_i"), F.lower(F.trim("value")).alias("_v")).distinct()
        c = candidates.withColumns({"_i": F.lower(F.trim("entity")), "_v": F.lower(F.trim("entity_name"))})
        by_id = c.join(at.where("_i <> ''").select("_i").distinct(), "_i", "left_semi")
        by_name = c.where("_i is null or _i = ''").join(at.select("_v").distinct(), "_v", "left_semi")
        return domain_facts(by_id.unionByName(by_name).drop("_i", "_v"))

    return provide


def seeded_sites(seeds: DataFrame, observations: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> Provider:
    """Domain facts from supplied sites: the frontier's seeds (entity, entity_name, domain, provider) with what observation of them said.

    ``observations``: (entity, domain, evidence_type, supports, observed_value, reference); a seed that nothing was observed of
    still gives evidence that it was named. ``evaluate``: evidence to (entity, domain, confidence, disposition).
    """

    def provide(frontier: DataFrame, n: int) -> DataFrame:
        at = frontier.select(F.lower(F.trim("identifier")).alias("_i")).where("_i <> ''").distinct()
        mine = seeds.withColumn("_i", F.lower(F.trim("entity"))).join(at, "_i", "left_semi").drop("_i")
        named = mine.select("entity", "domain", "provider", F.lit("OTHER").alias("evidence_type"), F.lit(None).cast("string").alias("reference"), F.lit(None).cast("string").alias("observed_value"), F.lit(None).cast("boolean").alias("supports"))
        seen = observations.join(mine.select("entity", "domain", "provider").distinct(), ["entity", "domain"]).select(*named.columns)
        names = mine.groupBy("entity", "domain").agg(F.min("entity_name").alias("entity_name"))
        return domain_facts(evaluate(named.unionByName(seen)).join(names, ["entity", "domain"]))

    return provide


def discovered(entities: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((entity, entity_name, domain, provider, url, title), (entity, provider, error)) from saved search results: nothing fails unseen.

    ``pages``: (entity, provider, ok, error, results array of (url, title, domain)). Providers of an entity are asked in the order
    of ``rank``, which the pages have; the first that answered with results counts, an answer without any isn't a failure. Where
    all failed, the errors of all come out, as does an entity that was never asked.
    """
    asked = pages.join(entities.select("entity", "entity_name"), "entity")
    good = asked.where(F.col("ok") & (F.size("results") > 0)).groupBy("entity", "entity_name").agg(F.min_by(F.struct("provider", "results"), "rank").alias("b"))
    rows = good.select("entity", "entity_name", F.col("b.provider").alias("provider"), F.explode("b.results").alias("r"))
    seeds = rows.groupBy("entity", "entity_name", F.col("r.domain").alias("domain")).agg(F.min("provider").alias("provider"), F.min_by("r.url", F.struct("r.url")).alias("url"), F.min_by("r.title", F.struct("r.url")).alias("title")).where("domain is not null")
    failed = asked.groupBy("entity").agg(F.bool_or("ok").alias("any_ok"))
    errors = asked.join(failed.where("not any_ok"), "entity", "left_semi").select("entity", "provider", F.coalesce("error", F.lit("no answer")).alias("error"))
    never = entities.join(pages.select("entity").distinct(), "entity", "left_anti").select("entity", F.lit(None).cast("string").alias("provider"), F.lit("not asked").alias("error"))
    return seeds, errors.unionByName(never)


def canonical_events(candidates: DataFrame, allowed: tuple[str, ...] = ("AGREED_TO_ACQUIRE", "ACQUIRED", "SUBSIDIARY_OF", "MERGED_INTO", "CONVERTED_TO", "RENAMED_TO", "M&A_CANDIDATE")) -> DataFrame:
    """Event candidates of the allowed kinds as events with an id by content; a mere candidate stays one, the others are asserted by their filing.

    ``candidates``: (event_type, event_date, acquirer, target, subject, object_entity, result_entity, accession, confidence). Repeated ones count once.
    """
    key = ("event_type", "event_date", "acquirer", "target", "subject", "object_entity", "result_entity", "accession")
    raw = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in key))
    kept = candidates.where(F.col("event_type").isin(*allowed)).select(F.concat(F.lit("evt:"), F.substring(F.sha2(raw, 256), 1, 20)).alias("event_id"), "event_type", F.col("event_date").alias("day"), *key[2:], F.when(F.col("event_type") == "M&A_CANDIDATE", "CANDIDATE").otherwise("ASSERTED_FROM_FILING").alias("status"), "confidence")
    return kept.groupBy(*(c for c in kept.columns if c != "confidence")).agg(F.min("confidence").alias("confidence"))
