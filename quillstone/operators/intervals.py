"""Continuous periods and gaps of overlapping, nested, touching and gapped intervals per entity.

Keyed state is an ordered map of disjoint intervals. Each insertion finds what it touches by binary
search, fuses it and thereby moves the gaps, which are what lies between neighbours of the map.

Hot entities: equal intervals are first combined before any exchange; then the map is built per entity
and decade of the start, so that an entity with a third of all rows spreads over many tasks; the disjoint
rest (at most one interval for every two days of the calendar, whatever the number of rows) is fused per
entity. Fusing maps is associative, so that the result doesn't depend on the split.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.dates import calendar_day, day_text

OPEN_END = 2_932_896  # 9999-12-31 in days since 1970
BUCKET_DAYS = 3_653  # about ten years


class IntervalMap:
    """Disjoint half-open intervals in order; ``many`` says if an interval was formed from differing ones."""

    __slots__ = ("starts", "ends", "many")

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.many: list[bool] = []

    def insert(self, start: int, end: int, many: bool = False) -> None:
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if i < j:  # it overlaps or touches i .. j-1
            many = many or j - i > 1 or self.many[i] or (self.starts[i], self.ends[i]) != (start, end)
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j], self.many[i:j] = [start], [end], [many]

    def periods(self) -> Iterator[tuple[int, int, bool]]:
        return zip(self.starts, self.ends, self.many)

    def gaps(self) -> Iterator[tuple[int, int]]:
        return zip(self.ends, self.starts[1:])


def _keyed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, IntervalMap]]:
    """Rows sorted by their first ``keys`` columns, to one map a key; only the present key's map is held."""
    present, state = None, IntervalMap()
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for row in zip(*columns):
            if row[:keys] != present:
                if present is not None:
                    yield present, state
                present, state = row[:keys], IntervalMap()
            state.insert(*row[keys:])
    if present is not None:
        yield present, state


def _emit(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], at_once: int = 20_000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for r in rows:
        out.append(r)
        if len(out) >= at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((key, s, e, m) for (key, _), state in _keyed(batches, 2) for s, e, m in state.periods())
    return _emit(rows, ["key", "start", "end", "many"], [pa.string(), pa.int32(), pa.int32(), pa.bool_()])


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (key,), state in _keyed(batches, 1):
            yield from ((key, "PERIOD", s, e, m) for s, e, m in state.periods())
            yield from ((key, "GAP", s, e, None) for s, e in state.gaps())

    return _emit(rows(), ["key", "kind", "start", "end", "many"], [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()])


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``(key string, kind, start, end, many)``: all continuous periods (kind PERIOD) and the gaps between them (GAP).

    ``start`` and ``end`` are days since 1970 (int), the end not included. Rows with a null in one of the three,
    or whose end isn't after the start, are left out. Repeated rows count once. ``many`` is true for a period formed
    from at least two differing intervals, null for gaps. Other columns play no part; no rows give no rows.
    """
    clean = df.select(F.col(key).cast("string").alias("key"), F.col(start).cast("int").alias("start"), F.col(end).cast("int").alias("end"))
    clean = clean.where("key is not null and start is not null and end is not null and end > start").distinct()
    split = clean.select("key", F.floor(F.col("start") / BUCKET_DAYS).cast("int").alias("bucket"), "start", "end").repartition("key", "bucket").sortWithinPartitions("key", "bucket")
    parts = split.mapInArrow(_partial, "key string, start int, end int, many boolean")
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(_final, "key string, kind string, start int, end int, many boolean")


def lei(column: str | Column) -> Column:
    """A LEI as compared and put out: trimmed, upper case."""
    return F.upper(F.trim(F.col(column) if isinstance(column, str) else column))


def validity_days(start: Column, end: Column) -> tuple[Column, Column]:
    """Start and end as days since 1970. An end that is null, blank or in year 9999 is open: 9999-12-31."""
    last = F.unix_date(calendar_day(end))
    is_open = end.isNull() | (F.trim(end) == "") | (F.trim(end).rlike(r"^9999-?\d{2}-?\d{2}|[ -]9999$"))
    return F.unix_date(calendar_day(start)), F.when(is_open, F.lit(OPEN_END)).otherwise(last)


def consolidation_periods(relationships: DataFrame) -> DataFrame:
    """The periods and gaps of direct consolidation of every child, whatever the status and the parent."""
    rows = relationships.where(F.trim("relationship_type") == "IS_DIRECTLY_CONSOLIDATED_BY")
    first, last = validity_days(F.col("relationship_start"), F.col("relationship_end"))
    return periods_and_gaps(rows.select(lei("child_lei").alias("k"), first.alias("s"), last.alias("e")), "k", "s", "e")


def found_periods(relationships: DataFrame) -> DataFrame:
    """``(child_lei, kind, period_start, period_end)``: periods formed from differing intervals, and all gaps."""
    out = consolidation_periods(relationships).where("kind = 'GAP' or many")
    return out.select(F.col("key").alias("child_lei"), "kind", day_text(F.col("start")).alias("period_start"), day_text(F.col("end")).alias("period_end"))
