"""Signals of a pair of records, and a decision by an explicit policy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T


@dataclass(frozen=True)
class Policy:
    """Signals that settle a pair, weights of the others, and the scores from which it is accepted or reviewed."""

    confirms: tuple[str, ...]
    conflicts: tuple[str, ...]
    weights: dict[str, float]
    numeric: dict[str, float]
    accept: float
    review: float
    guards: tuple[tuple[str, str], ...] = field(default=())


# Weights and thresholds of the two policies
POLICIES = {
    "SAME_ENTITY": Policy(("exact_identifier", "former_name_match"), ("identifier_conflict",), {"exact_name": 35.0, "exact_base": 15.0, "place_match": 20.0, "shared_address": 8.0}, {"levenshtein_ratio": 12.0, "token_jaccard": 10.0}, 75.0, 45.0, (("place_conflict", "DISTINCT_BY_JURISDICTION"),)),
    "SUBSIDIARY_OF": Policy(("subsidiary_edge",), (), {"exact_base": 4.0, "place_match": 2.0, "shared_address": 3.0}, {"levenshtein_ratio": 2.0, "token_jaccard": 2.0}, 70.0, 35.0),
}


def policy(name: str) -> Policy:
    """A policy by name in any letter case; an unknown one raises KeyError."""
    return POLICIES[name.upper()]


def signals(left: str, right: str) -> dict[str, Column]:
    """Signals of two structs (name, base, place, ids, aliases, addresses): booleans that are false when either side is missing, and two ratios."""
    a, b = (lambda f: F.col(left)[f]), (lambda f: F.col(right)[f])
    both = lambda f: a(f).isNotNull() & b(f).isNotNull()
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    sure = lambda c: F.coalesce(c, F.lit(False))
    common = lambda f: sure(some(a(f)) & some(b(f)) & F.arrays_overlap(a(f), b(f)))
    return {
        "exact_name": sure(both("name") & (a("name") == b("name"))),
        "exact_base": sure(both("base") & (a("base") == b("base"))),
        "levenshtein_ratio": T.levenshtein_ratio(a("name"), b("name")),
        "token_jaccard": T.token_jaccard(a("name"), b("name")),
        "place_match": sure(both("place") & (a("place") == b("place"))),
        "place_conflict": sure(both("place") & (a("place") != b("place"))),
        "exact_identifier": common("ids"),
        "identifier_conflict": sure(some(a("ids")) & some(b("ids")) & ~F.arrays_overlap(a("ids"), b("ids"))),
        "former_name_match": sure(F.array_contains(a("aliases"), b("name"))) | sure(F.array_contains(b("aliases"), a("name"))),
        "shared_address": common("addresses"),
    }


def decide(p: Policy, have: dict[str, Column]) -> dict[str, Column]:
    """Score, decision and reason: conflicts before confirmations before guards before the score."""
    no = F.lit(False)
    got = lambda names: F.greatest(*(have.get(n, no) for n in names)) if len(names) > 1 else have.get(names[0], no) if names else no
    score = sum((F.when(have[s], w).otherwise(0.0) for s, w in p.weights.items()), F.lit(0.0)) + sum((F.coalesce(have[s] * w, F.lit(0.0)) for s, w in p.numeric.items()), F.lit(0.0))
    decision, reason = F.when(got(p.conflicts), "REJECT").when(got(p.confirms), "ACCEPT"), F.when(got(p.conflicts), "HARD_IDENTIFIER_CONFLICT").when(got(p.confirms), "EXPLICIT_CONTINUITY_OR_IDENTIFIER")
    for signal, why in p.guards:
        decision, reason = decision.when(have[signal], "REJECT"), reason.when(have[signal], why)
    decision = decision.when(score >= p.accept, "ACCEPT").when(score >= p.review, "REVIEW").otherwise("REJECT")
    reason = reason.when(score >= p.accept, "SUFFICIENT_SIGNAL_AGREEMENT").when(score >= p.review, "AMBIGUOUS_SIGNAL_AGREEMENT").otherwise("INSUFFICIENT_IDENTITY_EVIDENCE")
    return {"score": score, "decision": decision, "reason": reason}


def group_pairs(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(dup_group, left, right): every member of a group with the group's smallest candidate, as structs of what signals need."""
    name = T.fold_name(F.col("legal_name"))
    # What stands in for a missing number
    number = F.regexp_replace(F.upper("registration_id"), "[^A-Z0-9]+", "")
    known = F.length(F.regexp_replace(number, "[^0-9]+", "")) >= 5
    side = records.select("candidate_id", F.struct(
        "candidate_id", name.alias("name"), T.strip_suffixes(name).alias("base"), T.jurisdiction_code(F.col("jurisdiction")).alias("place"),
        F.when(known, F.array(number)).otherwise(F.array().cast("array<string>")).alias("ids"),
        F.coalesce(F.filter(F.transform("other_names", T.fold_name), lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("aliases"),
        F.when(F.col("legal_address").isNotNull(), F.array(T.address_key(F.concat_ws(" ", F.array_join("legal_address.lines", " "), "legal_address.city")))).otherwise(F.array().cast("array<string>")).alias("addresses"),
    ).alias("record"))
    members = groups.select("dup_group", "candidate_id").distinct()
    first = members.groupBy("dup_group").agg(F.min("candidate_id").alias("first_id"))
    pairs = members.join(first, "dup_group").where("candidate_id <> first_id")
    return pairs.join(side.select(F.col("candidate_id").alias("first_id"), F.col("record").alias("left")), "first_id").join(side.select("candidate_id", F.col("record").alias("right")), "candidate_id").select("dup_group", "left", "right")
