"""What successive filings disclose of a structure: timelines of names and changes from one filing to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.dates import calendar_day
from quillstone.functions.text import fold_name


def appearances(subsidiaries: DataFrame) -> DataFrame:
    """(cik, identity, day, accession, name, country) of the rows of subsidiary lists with a name and a date; repeated rows once."""
    rows = subsidiaries.select("cik", fold_name(F.col("subsidiary_name")).alias("identity"), F.date_format(calendar_day(F.col("filing_date")), "yyyy-MM-dd").alias("day"), "accession", F.trim("subsidiary_name").alias("name"), F.trim("country").alias("country"))
    return rows.where("cik is not null and identity is not null and day is not null").distinct()


def timeline(rows: DataFrame) -> DataFrame:
    """(cik, identity, canonical_name, first_observed, last_observed, n_observed, n_dates, n_missed, current): bounds of disclosure, not of existence.

    ``n_missed``: filing days of the issuer between the first and the last where the name is absent. Absence proves nothing.
    """
    days = rows.select("cik", "day").distinct()
    place = days.withColumns({"k": F.row_number().over(Window.partitionBy("cik").orderBy("day")), "n": F.count(F.lit(1)).over(Window.partitionBy("cik"))})
    per = rows.groupBy("cik", "identity").agg(F.max_by("name", F.struct("day", "accession", "name")).alias("canonical_name"), F.min("day").alias("first_observed"), F.max("day").alias("last_observed"), F.count(F.lit(1)).alias("n_observed"), F.count_distinct("day").alias("n_dates"))
    out = per.join(place.select("cik", F.col("day").alias("first_observed"), F.col("k").alias("k1")), ["cik", "first_observed"]).join(place.select("cik", F.col("day").alias("last_observed"), F.col("k").alias("k2"), "n"), ["cik", "last_observed"])
    return out.select("cik", "identity", "canonical_name", "first_observed", "last_observed", "n_observed", "n_dates", (F.col("k2") - F.col("k1") + 1 - F.col("n_dates")).cast("bigint").alias("n_missed"), (F.col("k2") == F.col("n")).alias("current"))


def changes(rows: DataFrame) -> DataFrame:
    """(cik, identity, previous_day, current_day, change_type) between successive filing days of an issuer."""
    days = rows.select("cik", "day").distinct()
    steps = days.withColumns({"next_day": F.lead("day").over(Window.partitionBy("cik").orderBy("day"))})
    before = days.select("cik", "day", F.lag("day").over(Window.partitionBy("cik").orderBy("day")).alias("previous_day"))
    snap = rows.groupBy("cik", "identity", "day").agg(F.array_join(F.array_sort(F.collect_set("name")), "\n").alias("names"), F.array_join(F.array_sort(F.collect_set("country")), "\n").alias("countries"))
    first = rows.groupBy("cik", "identity").agg(F.min("day").alias("first_day"))
    forward = snap.join(steps, ["cik", "day"]).where("next_day is not null")
    now = snap.select("cik", "identity", F.col("day").alias("next_day"), F.col("names").alias("names2"), F.col("countries").alias("countries2"))
    pairs = forward.join(now, ["cik", "identity", "next_day"], "left")
    gone = pairs.where("names2 is null").select("cik", "identity", F.col("day").alias("previous_day"), F.col("next_day").alias("current_day"), F.lit("DISAPPEARED_FROM_DISCLOSURE").alias("change_type"))
    renamed = pairs.where("names2 is not null and names <> names2").select("cik", "identity", F.col("day").alias("previous_day"), F.col("next_day").alias("current_day"), F.lit("NAME_TEXT_CHANGED").alias("change_type"))
    moved = pairs.where("names2 is not null and countries <> countries2").select("cik", "identity", F.col("day").alias("previous_day"), F.col("next_day").alias("current_day"), F.lit("JURISDICTION_TEXT_CHANGED").alias("change_type"))
    back = snap.select("cik", "identity", "day").join(before, ["cik", "day"]).where("previous_day is not null")
    came = back.join(snap.select("cik", "identity", F.col("day").alias("previous_day")), ["cik", "identity", "previous_day"], "left_anti").join(first, ["cik", "identity"])
    came = came.select("cik", "identity", "previous_day", F.col("day").alias("current_day"), F.when(F.col("first_day") < F.col("previous_day"), "REAPPEARED_IN_DISCLOSURE").otherwise("APPEARED_IN_DISCLOSURE").alias("change_type"))
    return gone.unionByName(renamed).unionByName(moved).unionByName(came)


def missed_days(rows: DataFrame) -> DataFrame:
    """(cik, identity, day): filing days of the issuer between a name's first and last where the name is absent. Absence proves nothing.

    An issuer's filing days are one array, as long as its filings; names meet that, not one another.
    """
    days = rows.groupBy("cik").agg(F.array_sort(F.collect_set("day")).alias("days"))
    own = rows.groupBy("cik", "identity").agg(F.collect_set("day").alias("own"))
    between = F.filter(F.array_except("days", "own"), lambda d: (d > F.array_min("own")) & (d < F.array_max("own")))
    return own.join(days, "cik").select("cik", "identity", F.explode(between).alias("day"))
