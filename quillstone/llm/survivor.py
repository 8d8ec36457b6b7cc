"""One surviving record for each group of duplicates, field by field.

Records are ranked by windows: a whole record by completeness, trust and recency; a field's value by trust, recency and
completeness; the candidate id decides ties. A group may hold a third of all rows: the records of a group and field that were
updated on one day are first reduced to the best of them, before they are exchanged, so that a window ranks as many rows as there
are days, however many records there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.dates import calendar_day

FIELDS = ("legal_name", "registration_id", "entity_status", "legal_form", "entity_creation_date")
UNTRUSTED = 2**31 - 1
# Words that stand in for a missing value, letters only
STAND_INS = ("unknown", "na", "none", "null", "nil", "tbd", "tba", "tbc", "notavailable", "notapplicable", "notknown", "notprovided", "notspecified", "unspecified", "undefined", "missing", "pending", "empty", "blank")
# Days that fill a date field
FILLER_DAYS = ("9999-12-31", "9999-01-01", "0001-01-01", "1900-01-01", "1970-01-01")


def is_value(c: Column, is_date: bool = False) -> Column:
    """False for null, blank, a word or sign for a missing value, a number of one repeated digit, and a filler date."""
    t = F.trim(c)
    letters = F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""))
    ok = c.isNotNull() & (letters != "") & ~letters.isin(*STAND_INS) & ~letters.rlike(r"^(\d)\1*$")
    if is_date:
        day = calendar_day(t)
        ok = ok & day.isNotNull() & ~F.date_format(day, "yyyy-MM-dd").isin(*FILLER_DAYS)
    return F.coalesce(ok, F.lit(False))


def provider_key(c: Column) -> Column:
    """Provider names are compared by their letters only."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}]+", ""))


def ranked_members(groups: DataFrame, records: DataFrame, trust: DataFrame) -> DataFrame:
    """(dup_group, candidate_id, day, trust_rank, completeness, and the fields, null where they are no value), repeated rows once.

    A provider not in ``trust`` or null is trusted least; an unreadable date is the earliest. ``trust`` has one row a
    provider and is fixed in size; it is checked before it is broadcast.
    """
    rows = trust.select(provider_key(F.col("provider")).alias("_p"), F.col("trust_rank").cast("int")).groupBy("_p").agg(F.min("trust_rank").alias("trust_rank"))
    if len(rows.limit(10_001).collect()) <= 10_000:
        rows = F.broadcast(rows)
    named = records.select("candidate_id", provider_key(F.col("provider")).alias("_p"), F.unix_date(calendar_day(F.col("last_update_date"))).alias("day"), *(F.when(is_value(F.col(f), f.endswith("_date")), F.col(f)).alias(f) for f in FIELDS))
    named = named.join(rows, "_p", "left").drop("_p")
    full = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    named = named.withColumns({"trust_rank": F.coalesce("trust_rank", F.lit(UNTRUSTED)), "day": F.coalesce("day", F.lit(-(2**31))), "completeness": full})
    return groups.select("dup_group", "candidate_id").where("dup_group is not null and candidate_id is not null").distinct().join(named, "candidate_id")


def _winners(rows: DataFrame, keys: list[str], order: list[tuple[str, int]]) -> DataFrame:
    """The first row a key in ``order`` (numeric columns, 1 rising or -1 falling), with n (rows) and latest: its day is later than that of all others."""
    rank = F.struct(*((F.col(c).cast("bigint") * sign).alias(f"_o{i}") for i, (c, sign) in enumerate(order)), *(c for c in rows.columns if c not in keys))
    daily = rows.groupBy(*keys, "day").agg(F.min(rank).alias("_best"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    few = daily.withColumns({"_place": F.row_number().over(group.orderBy("_best")), "n": F.sum("_n").over(group), "_last": F.max(F.struct(F.col("day").alias("d"), F.col("_n").alias("k"))).over(group)})
    top = few.where("_place = 1").withColumn("latest", (F.col("day") == F.col("_last.d")) & (F.col("_last.k") == 1))
    return top.select(*keys, *(F.col(f"_best.{c}") for c in rows.columns if c not in keys), "n", "latest")


def field_survivors(members: DataFrame) -> DataFrame:
    """``(dup_group, field_name, value, candidate_id, n, latest)``: the value kept for each field of a group, and where it is from.

    ``n`` counts the records with a value; ``latest``: its record is later than all the others. Values are ranked by
    trust first, so that no record of the group with a value of the field is trusted more.
    """
    long = members.select("dup_group", "candidate_id", "day", "trust_rank", "completeness", F.explode(F.create_map(*(x for f in FIELDS for x in (F.lit(f), F.col(f))))).alias("field_name", "value")).where("value is not null")
    out = _winners(long, ["dup_group", "field_name"], [("trust_rank", 1), ("day", -1), ("completeness", -1), ("candidate_id", 1)])
    return out.select("dup_group", "field_name", "value", "candidate_id", "trust_rank", "n", "latest")


def survivors(members: DataFrame) -> DataFrame:
    """One row a group: base record by completeness, trust and recency, and every field with the candidate it is from.

    A group without any value keeps its base record and null fields.
    """
    base = _winners(members, ["dup_group"], [("completeness", -1), ("trust_rank", 1), ("day", -1), ("candidate_id", 1)]).select("dup_group", F.col("candidate_id").alias("base_candidate_id"), F.col("n").alias("n_records"))
    kept = field_survivors(members).groupBy("dup_group").agg(*(F.max(F.when(F.col("field_name") == f, F.col(c))).alias(n) for f in FIELDS for c, n in (("value", f), ("candidate_id", f"{f}_from"))))
    return base.join(kept, "dup_group", "left")


def found_origins(groups: DataFrame, records: DataFrame, trust: DataFrame) -> DataFrame:
    """``(dup_group, field_name, candidate_id)``: fields whose kept value is both the latest and of the most trusted."""
    kept = field_survivors(ranked_members(groups, records, trust))
    return kept.where("n >= 2 and latest").select("dup_group", "field_name", "candidate_id")
