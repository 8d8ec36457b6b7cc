"""Facts merged under a conservative rule, and expansion from fact to fact until nothing new may be trusted.

Facts: (fact_type, value, identifier, subject, source, confidence, status, pivot_eligible, seq). A fact's key is its type,
value and identifier in any letter case. ``seq`` is the order of arrival: a first REJECTED stays, a later one doesn't demote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import Scratch

KEY = ["k_type", "k_value", "k_id"]
FACT = "fact_type string, value string, identifier string, subject string, source string, confidence string, status string, pivot_eligible boolean, seq bigint"
CONFIDENCE, STATUS = ("UNKNOWN", "LOW", "MEDIUM", "HIGH"), ("REJECTED", "REVIEW", "ACCEPTED")
Provider = Callable[[DataFrame, int], DataFrame]


def _keyed(facts: DataFrame) -> DataFrame:
    return facts.withColumns({"k_type": F.upper(F.trim("fact_type")), "k_value": F.lower(F.trim("value")), "k_id": F.lower(F.trim(F.coalesce("identifier", F.lit(""))))})


def _rank(c: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, v in enumerate(order) for x in (v, i))), c), F.lit(0))


def merge(facts: DataFrame) -> DataFrame:
    """One row a key with (n_sources, flagged): highest confidence and status, unless the first word was REJECTED.

    An aggregate that combines before the exchange: a fact told very often is no burden. ``flagged``: something else was said after a rejection.
    """
    f = _keyed(facts).withColumns({"c": _rank(F.col("confidence"), CONFIDENCE), "s": _rank(F.col("status"), STATUS)})
    first = lambda c: F.min_by(c, "seq").alias(c)
    g = f.groupBy(*KEY).agg(first("fact_type"), first("value"), first("identifier"), first("subject"), first("source"), F.max("c").alias("c"), F.max("s").alias("s"), F.min_by("s", "seq").alias("s0"), F.bool_or(F.coalesce("pivot_eligible", F.lit(False))).alias("p"), F.min_by(F.coalesce("pivot_eligible", F.lit(False)), "seq").alias("p0"), F.min("seq").alias("seq"), F.count_distinct("source").alias("n_sources"), F.max("s").alias("top"))
    rejected = F.col("s0") == 0
    name = lambda c, order: F.element_at(F.array(*(F.lit(x) for x in order)), c + 1)
    return g.select("fact_type", "value", "identifier", "subject", "source", name(F.col("c"), CONFIDENCE).alias("confidence"), F.when(rejected, "REJECTED").otherwise(name(F.col("s"), STATUS)).alias("status"), F.when(rejected, F.col("p0")).otherwise(F.col("p")).alias("pivot_eligible"), "seq", "n_sources", (rejected & (F.col("top") > 0)).alias("flagged"))


def can_pivot(status: str = "status", confidence: str = "confidence", eligible: str = "pivot_eligible") -> Column:
    return (F.col(status) == "ACCEPTED") & (F.col(confidence) == "HIGH") & F.coalesce(F.col(eligible), F.lit(False))


def shared_domains(facts: DataFrame) -> DataFrame:
    """Accepted domain facts of one domain but differing owners go back to review and can't be pivots; their confidence stays."""
    sole = (F.upper("fact_type") == "DOMAIN") & (F.col("status") == "ACCEPTED") & (F.col("confidence") == "HIGH")
    owner = F.lower(F.trim(F.coalesce("identifier", "subject", F.lit(""))))
    f = facts.withColumns({"_d": F.when(sole, F.lower(F.trim("value"))), "_o": owner})
    claims = f.where("_d is not null and _o <> ''").groupBy("_d").agg((F.min("_o") != F.max("_o")).alias("_x"))
    both = f.join(claims, "_d", "left").withColumn("_x", F.coalesce("_x", F.lit(False)))
    return both.withColumns({"status": F.when(F.col("_x"), "REVIEW").otherwise(F.col("status")), "pivot_eligible": F.col("pivot_eligible") & ~F.col("_x")}).drop("_d", "_o", "_x")


def expand(seeds: DataFrame, providers: dict[str, Provider], max_rounds: int = 10) -> tuple[DataFrame, list[dict], str]:
    """(facts, one record a round, reason for the end): NO_PIVOT_ELIGIBLE_SEEDS, NO_NEW_TRUSTED_PIVOTS or MAX_ITERATIONS_REACHED.

    A provider takes the frontier and the round and gives facts without ``seq``. All pivots of a round go through a provider
    at once. A provider that fails is recorded with its error; the others go on.
    """
    scratch = Scratch(seeds.sparkSession)
    plain = lambda df: df.select(*(c.split()[0] for c in FACT.split(", ")))
    log = scratch.write(plain(seeds))
    known, (pivots,) = scratch.write_counting(merge(log), F.count_if(can_pivot()))
    frontier = known.where(can_pivot())
    rounds: list[dict] = []
    if not pivots:
        return shared_domains(known), rounds, "NO_PIVOT_ELIGIBLE_SEEDS"
    for n in range(1, max_rounds + 1):
        found, errors = None, []
        for name, provider in providers.items():
            try:
                new = scratch.write(provider(frontier, n))
                new = new.select(*(c.split()[0] for c in FACT.split(", ")[:-1])).withColumn("seq", F.monotonically_increasing_id() + n * 10**12)
                found = new if found is None else found.unionByName(new)
            except Exception as e:  # one source failing must not end the expansion
                errors.append({"provider": name, "error": f"{type(e).__name__}: {str(e)[:200]}"})
        if found is None:
            rounds.append({"iteration": n, "frontier": pivots, "discovered": 0, "new_facts": 0, "new_pivots": 0, "errors": errors})
            return shared_domains(known), rounds, "NO_NEW_TRUSTED_PIVOTS"
        added, (discovered,) = scratch.write_counting(found, F.count(F.lit(1)))
        log = log.unionByName(added)
        after = scratch.write(merge(log))
        before = _keyed(known).select(*KEY, can_pivot().alias("was"))
        marked = _keyed(after).join(before, KEY, "left")
        marked, (new_facts, new_pivots) = scratch.write_counting(marked, F.count_if(F.col("was").isNull()), F.count_if(can_pivot() & ~F.coalesce("was", F.lit(False))))
        rounds.append({"iteration": n, "frontier": pivots, "discovered": discovered, "new_facts": new_facts, "new_pivots": new_pivots, "errors": errors})
        known, frontier, pivots = after, marked.where(can_pivot() & ~F.coalesce("was", F.lit(False))).drop("was", *KEY), new_pivots
        if not new_pivots:
            return shared_domains(known), rounds, "NO_NEW_TRUSTED_PIVOTS"
    return shared_domains(known), rounds, "MAX_ITERATIONS_REACHED"


def related_entities(edges: DataFrame) -> Provider:
    """A provider of the entities directly linked to the frontier's. ``edges``: (child, parent, direct, ultimate)."""

    def provide(frontier: DataFrame, n: int) -> DataFrame:
        at = frontier.where("upper(fact_type) = 'ENTITY'").select(F.upper("identifier").alias("root"))
        up = edges.select(F.col("child").alias("root"), F.col("parent").alias("other"), "direct").join(at, "root")
        down = edges.select(F.col("parent").alias("root"), F.col("child").alias("other"), "direct").join(at, "root")
        near = up.unionByName(down).groupBy("other").agg(F.bool_or("direct").alias("direct"), F.min("root").alias("root"))
        return near.select(F.lit("ENTITY").alias("fact_type"), F.col("other").alias("value"), F.col("other").alias("identifier"), F.col("root").alias("subject"), F.lit("registry").alias("source"), F.when(F.col("direct"), "HIGH").otherwise("MEDIUM").alias("confidence"), F.when(F.col("direct"), "ACCEPTED").otherwise("REVIEW").alias("status"), F.col("direct").alias("pivot_eligible"))

    return provide
