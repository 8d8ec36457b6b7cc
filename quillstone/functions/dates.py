"""Calendar days and instants from the ways in which registries and filings write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ways of writing a day, as (pattern of the text, date format)
DAY_FORMS = (
    (r"^\d{4}-\d{2}-\d{2}([T ].*)?$", "yyyy-MM-dd"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3,9} \d{1,2}, ?\d{4}$", "MMMM d, yyyy"),
)


def calendar_day(text: Column) -> Column:
    """The day as written, in whichever form, as DATE; null when there is none. Time and zone are not regarded."""
    t = F.trim(text)
    iso = F.when(t.rlike(DAY_FORMS[0][0]), F.try_to_date(F.left(t, F.lit(10)), "yyyy-MM-dd"))
    plain = F.when(t.rlike(DAY_FORMS[1][0]), F.try_to_date(t, "yyyyMMdd"))
    short = F.when(t.rlike(DAY_FORMS[2][0]), F.try_to_date(F.initcap(t), "d-MMM-yyyy"))
    long = F.when(t.rlike(DAY_FORMS[3][0]), F.coalesce(F.try_to_date(F.initcap(t), "MMMM d, yyyy"), F.try_to_date(F.initcap(t), "MMM d, yyyy")))
    return F.coalesce(iso, plain, short, long)


def utc_micros(text: Column) -> Column:
    """The instant as microseconds since 1970 in UTC; UTC when no zone is given; null when it isn't one.

    A plain day is its midnight. The session's time zone plays no part.
    """
    t = F.trim(text)
    zoned = F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), t)
    bare = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), F.concat(t, F.lit("Z")))
    at = F.coalesce(zoned, bare).try_cast("timestamp")
    return F.coalesce(F.unix_micros(at), F.unix_date(calendar_day(t)).cast("bigint") * F.lit(86_400_000_000))


def day_text(days: Column) -> Column:
    """Days since 1970 as ``YYYY-MM-DD``."""
    return F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd")
