"""Bitemporal ledger of changing attributes: when a value was valid, and when that was on record.

Updates are swept in the order of their recording over the ordered valid days of a key. A late update falls
into a valid interval already on record: that row is closed at the recording time and superseded by its two
parts, never overwritten. The rows not superseded are the present knowledge.

Hot keys: repeated deliveries are combined before the exchange, and the sweep is split by stretches of valid
time (``STRETCH_DAYS``). A stretch leaves open what ran past its end while it was on record. A second pass gives those rows the
end that later stretches set: it holds the first days of the later stretches over recorded time, which change only by an update
before all others of a stretch, and looks each row up in them by binary search as it streams by.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.dates import calendar_day, day_text, utc_micros
from quillstone.operators.intervals import OPEN_END, _emit, lei
from quillstone.session import Scratch

STRETCH_DAYS = 2_922  # eight years
NEVER = 253_402_300_799_000_000  # 9999-12-31T23:59:59Z in microseconds
KEY = ["entity_id", "attribute_name"]
SWEPT = "entity_id string, attribute_name string, stretch int, is_head boolean, value string, value_key string, valid_from int, valid_to int, recorded_from bigint, recorded_to bigint"
SWEPT_TYPES = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def value_key(value: Column) -> Column:
    """What is compared: letter case and blanks play no part."""
    return F.lower(F.upper(F.regexp_replace(value, r"[\s ​]+", "")))


class _Stretch:
    """Assertions of one key in one stretch of valid time, by valid day."""

    __slots__ = ("days", "rows", "head_since")

    def __init__(self):
        self.days: list[int] = []
        self.rows: list[list] = []  # [order, value, value_key, recorded_from]
        self.head_since = 0

    def take(self, day: int, order: tuple, value: str, vkey: str, at: int) -> Iterator[tuple]:
        """Rows superseded by this update, as (is_head, value, value_key, valid_from, valid_to, recorded_from, recorded_to)."""
        days, rows = self.days, self.rows
        i = bisect_left(days, day)
        after = days[i + 1] if i + 1 < len(days) else None
        if i < len(days) and days[i] == day:
            old = rows[i]
            if order > old[0]:  # a later word on the same day
                if old[2] == vkey:
                    old[0] = order
                else:
                    if old[3] < at:
                        yield False, old[1], old[2], day, after, old[3], at
                    rows[i] = [order, value, vkey, at]
            return
        after = days[i] if i < len(days) else None
        if i:
            old = rows[i - 1]
            if old[3] < at:
                yield False, old[1], old[2], days[i - 1], after, old[3], at
            old[3] = at
        else:
            if days and self.head_since < at:
                yield True, None, None, days[0], None, self.head_since, at
            self.head_since = at
        days.insert(i, day)
        rows.insert(i, [order, value, vkey, at])

    def rest(self) -> Iterator[tuple]:
        for i, (day, row) in enumerate(zip(self.days, self.rows)):
            yield False, row[1], row[2], day, self.days[i + 1] if i + 1 < len(self.days) else None, row[3], NEVER
        if self.days:
            yield True, None, None, self.days[0], None, self.head_since, NEVER


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        present, state = None, _Stretch()
        for b in batches:
            for e, a, s, day, instant, at, ident, value, vkey in zip(*(c.to_pylist() for c in b.columns)):
                if (e, a, s) != present:
                    if present:
                        yield from (present + r for r in state.rest())
                    present, state = (e, a, s), _Stretch()
                yield from (present + r for r in state.take(day, (instant, at, ident), value, vkey, at))
        if present:
            yield from (present + r for r in state.rest())

    return _emit(rows(), [f.split()[0] for f in SWEPT.split(", ")], SWEPT_TYPES)


def _next_days(heads: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """(since, day) of the first day known after a stretch, over recorded time, from (since, stretch, day) of the later stretches' first days.

    A stretch once known stays known, so that only the same or a nearer one changes what comes next.
    """
    since: list[int] = []
    days: list[int] = []
    nearest = None
    for at, stretch, day in sorted(heads):
        if nearest is not None and stretch > nearest:
            continue
        nearest = stretch
        if since and since[-1] == at:
            days[-1] = day
        else:
            since.append(at)
            days.append(day)
    return since, days


def _join_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By key and stretch the later stretches' first days (no ``value_key``), then the rows left open, which get their end as it was on record."""

    def rows():
        present, heads, known = None, [], None
        for b in batches:
            for e, a, s, head, value, vkey, first, since, till in zip(*(c.to_pylist() for c in b.columns)):
                if (e, a, s) != present:
                    present, heads, known = (e, a, s), [], None
                if head is not None:
                    heads.append((since, head, first))
                    continue
                known = known or _next_days(heads)
                i = bisect_right(known[0], since)
                start, end = since, known[1][i - 1] if i else OPEN_END
                while i < len(known[0]) and known[0][i] < till:
                    if known[1][i] != end:
                        yield e, a, value, vkey, first, end, start, known[0][i]
                        start, end = known[0][i], known[1][i]
                    i += 1
                yield e, a, value, vkey, first, end, start, till

    names = [*KEY, "value", "value_key", "valid_from", "valid_to", "recorded_from", "recorded_to"]
    return _emit(rows(), names, [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])


def sweep(updates: DataFrame) -> DataFrame:
    """Ledger rows by stretch, from updates (entity_id, attribute_name, value, valid_day int, instant, recorded_us bigint, ident string).

    Updates with a null in entity, attribute, day or value, or a blank value, say nothing. A null recording time is the
    earliest. Within a day the highest (instant, recorded_us, ident) counts. Repeated updates count as first recorded.
    """
    said = updates.where("entity_id is not null and attribute_name is not null and valid_day is not null and trim(value) <> ''")
    said = said.where(value_key(F.col("value")) != "")
    said = said.withColumns({"instant": F.coalesce("instant", F.lit(0)), "recorded_us": F.coalesce("recorded_us", F.lit(0)), "ident": F.coalesce("ident", F.lit(""))})
    once = said.groupBy(*KEY, "valid_day", "instant", "value").agg(F.min(F.struct("recorded_us", "ident")).alias("x"))
    once = once.select(*KEY, F.floor(F.col("valid_day") / STRETCH_DAYS).cast("int").alias("stretch"), "valid_day", "instant", "x.recorded_us", "x.ident", "value")
    once = once.repartition(*KEY, "stretch").sortWithinPartitions(*KEY, "stretch", "recorded_us", "instant", "ident")
    once = once.withColumn("value_key", value_key(F.col("value")))  # only here: it needn't be exchanged
    return once.mapInArrow(_sweep, SWEPT)


def ledger(updates: DataFrame) -> DataFrame:
    """The whole ledger: ``(entity_id, attribute_name, value, value_key, valid_from, valid_to, recorded_from, recorded_to)``, days and microseconds.

    At every recording time the rows on record cover an attribute's time from its first day without overlap; a confirmed
    value keeps its own row. ``recorded_to`` of the present rows is ``NEVER``. Each row ever on record stays.
    """
    swept = Scratch(updates.sparkSession).write(sweep(updates))
    heads = swept.where("is_head").select(*KEY, F.col("stretch").alias("head"), "valid_from", "recorded_from", "recorded_to")
    stretches = swept.where(f"is_head and recorded_to = {NEVER}").select(*KEY, "stretch")  # one row each
    none = F.lit(None).cast("string")
    later = stretches.join(heads, KEY).where("head > stretch").select(*KEY, "stretch", "head", none.alias("value"), none.alias("value_key"), "valid_from", "recorded_from", "recorded_to")
    left = swept.where("not is_head and valid_to is null").select(*KEY, "stretch", F.lit(None).cast("int").alias("head"), "value", "value_key", "valid_from", "recorded_from", "recorded_to")
    bounds = later.unionByName(left).repartition(*KEY, "stretch").sortWithinPartitions(*KEY, "stretch", F.col("head").desc_nulls_last())
    joined = bounds.mapInArrow(_join_stretches, "entity_id string, attribute_name string, value string, value_key string, valid_from int, valid_to int, recorded_from bigint, recorded_to bigint")
    return joined.unionByName(swept.where("not is_head and valid_to is not null").select(*joined.columns))


def versions(swept: DataFrame) -> DataFrame:
    """``(entity_id, attribute_name, value, valid_from, valid_to, n_versions)`` as known now: runs of equal values.

    Reads the rows of ``sweep`` that nothing superseded: one for each key and day at most, which bounds the windows.
    """
    now = swept.where(f"not is_head and recorded_to = {NEVER}")
    w = Window.partitionBy(*KEY).orderBy("valid_from")
    first = now.withColumn("before", F.lag("value_key").over(w)).where("before is null or before <> value_key")
    out = first.select(*KEY, "value", "valid_from", F.coalesce(F.lead("valid_from").over(w), F.lit(OPEN_END)).alias("valid_to"), F.count(F.lit(1)).over(Window.partitionBy(*KEY)).alias("n_versions"))
    return out


def registry_updates(lei_entities: DataFrame, graph_states: DataFrame) -> DataFrame:
    """Updates from registry deliveries (days of last_update_date in UTC) and from graph states (days as written)."""
    at = utc_micros(F.col("last_update_date"))
    registry = lei_entities.select(
        lei("lei").alias("entity_id"), at.alias("instant"), F.unix_micros(F.col("delivered_at").cast("timestamp")).alias("recorded_us"), F.lpad(F.col("record_id").cast("string"), 20, "0").alias("ident"),
        F.explode(F.create_map(*(x for c in ("legal_name", "entity_status", "legal_address_city") for x in (F.lit(c), F.col(c))))).alias("attribute_name", "value"),
    )
    registry = registry.select("entity_id", "attribute_name", "value", F.floor(F.col("instant") / 86_400_000_000).cast("int").alias("valid_day"), "instant", "recorded_us", "ident")
    recorded = F.unix_micros(F.col("recorded_at").cast("timestamp"))
    states = graph_states.select(
        F.lower(F.trim("node_id")).alias("entity_id"), F.trim("state_type").alias("attribute_name"), F.col("state_value.to_value").alias("value"),
        F.unix_date(calendar_day(F.col("effective_date"))).alias("valid_day"), F.coalesce(recorded, F.lit(0)).alias("instant"), recorded.alias("recorded_us"), F.col("source_event_id").alias("ident"),
    )
    return registry.unionByName(states)


def found_versions(lei_entities: DataFrame, graph_states: DataFrame) -> DataFrame:
    """``(entity_id, attribute_name, valid_from, valid_to)``: every version of an attribute that has at least two."""
    out = versions(sweep(registry_updates(lei_entities, graph_states))).where("n_versions >= 2")
    return out.select(*KEY, day_text(F.col("valid_from")).alias("valid_from"), day_text(F.col("valid_to")).alias("valid_to"))
