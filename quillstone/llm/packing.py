"""Filling containers of fixed capacity by best-fit decreasing, over the whole corpus at once.

Sizes are whole numbers up to the capacity, so that the sequence of best-fit decreasing is determined by how many items
have each size. The plan runs over this histogram: a segment tree over remaining capacities finds the tightest open
container in logarithmic time, and all items of a size that go the same way are placed in one step. A step either uses up
a size or a run of alike containers, and a run shrinks its remaining capacity by more than half; so the plan has less than
``40 * capacity`` steps, whatever the number of items, and each stands for many items. The items themselves
are numbered in the order of size by a range-partitioned sort, where no size is too frequent for one task, and look up
their step by their number. The result is that of the item-by-item algorithm.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.hotkeys import prefix_sum
from quillstone.session import Scratch

MAX_KINDS = 10_000  # kinds of containers that the driver plans for
MAX_CAPACITY = 4_000_000  # of all kinds together: the driver holds a count for each size
MAX_PLAN_BYTES = 128 * 2**20  # of the steps that go to the workers


class RemainingTree:
    """Segment tree over remaining capacities 0..capacity: which of them have open containers."""

    def __init__(self, capacity: int):
        self.width = 1 << max(1, capacity.bit_length())
        self.open = [0] * (2 * self.width)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.width
        while i:
            self.open[i] += n
            i >>= 1

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least ``size`` with an open container."""
        i, tree = size + self.width, self.open
        if size >= self.width:
            return None
        if tree[i]:
            return size
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Steps (first item, items, items a container, first container) over items numbered by falling size."""
    tree, runs = RemainingTree(capacity), [deque() for _ in range(capacity + 1)]
    steps: list[tuple[int, int, int, int]] = []
    item = made = 0

    def put(remaining: int, first: int, n: int) -> None:
        if n:
            runs[remaining].append((first, n))
            tree.add(remaining, 1)

    for size in sorted(histogram, reverse=True):
        todo = histogram[size]
        while todo:
            room = tree.tightest(size)
            if room is None:  # open new ones, as many as are needed
                room, each = capacity, capacity // size if size else todo
                first, n = made, -(-todo // each)
                made += n
            else:
                first, n = runs[room].popleft()
                tree.add(room, -1)
                each = room // size if size else todo
            full, rest = divmod(min(todo, n * each), each)
            if full:
                steps.append((item, full * each, each, first))
                put(room - each * size, first, full)
            if rest:
                steps.append((item + full * each, rest, rest, first + full))
                put(room - rest * size, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            item += full * each + rest
            todo -= full * each + rest
    return steps


def _histogram(sizes: DataFrame, caps) -> dict[int, dict[int, int]]:
    """By kind, how many parts have each size: counted by size of the items first, then by size of their parts; at most the sum of the capacities."""
    by_size = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("items")).withColumn("k", F.explode(caps)).select("n", "items", "k.*")
    full = F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / F.col("cap"))
    part = F.explode(F.array(F.struct(F.col("cap").alias("size"), (full * F.col("items")).alias("parts")), F.struct((F.col("n") - full * F.col("cap")).cast("int").alias("size"), F.col("items").alias("parts")))).alias("p")
    counts: dict[int, dict[int, int]] = {}
    for kind, size, n in by_size.select("kind", part).groupBy("kind", "p.size").agg(F.sum("p.parts").cast("bigint").alias("n")).where("n > 0").collect():
        counts.setdefault(kind, {})[size] = n
    return counts


def pack(items: DataFrame, capacities: dict[str, int], scratch: Scratch | None = None) -> DataFrame:
    """``items`` (doc_id, n_tokens) of every kind in containers: ``(container_kind, container_id, doc_id, part, token_from, n_tokens)``.

    An item above the capacity is divided into full parts and a remainder, all others stay whole. Items of size 0 take no
    room and go where the tightest container is; a null size counts as 0. Repeated items are packed each. Ties in size
    go by doc_id and part. No items give no containers. Containers are numbered from 0 for each kind.
    """
    spark = items.sparkSession
    scratch = scratch or Scratch(spark)
    if len(capacities) > MAX_KINDS or any(c is None or c < 1 for c in capacities.values()) or sum(capacities.values()) > MAX_CAPACITY:
        raise ValueError(f"capacities must be positive, for at most {MAX_KINDS} kinds, and at most {MAX_CAPACITY} together")
    kinds = sorted(capacities)
    schema = "container_kind string, container_id bigint, doc_id bigint, part int, token_from bigint, n_tokens int"
    if not kinds:
        return spark.createDataFrame([], schema)
    caps = F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(capacities[k]).alias("cap")) for i, k in enumerate(kinds)))
    sizes = items.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).alias("n"))
    sized = sizes.withColumn("k", F.explode(caps)).select("doc_id", "n", "k.*")
    last = F.greatest(F.ceil(F.col("n") / F.col("cap")).cast("int"), F.lit(1)) - 1
    parts = sized.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    parts = parts.select("kind", F.least(F.col("n") - F.col("part") * F.col("cap"), F.col("cap")).alias("size"), "doc_id", "part", (F.col("part").cast("bigint") * F.col("cap")).alias("token_from"))
    numbered = prefix_sum(parts.withColumn("falling", -F.col("size")), ["kind", "falling", "doc_id", "part"], None, "number", scratch)
    steps: list[tuple[int, int, int, int]] = []
    base = 0
    counts = _histogram(sizes, caps)
    for i, k in enumerate(kinds):
        plan = best_fit_plan(counts.get(i, {}), capacities[k])
        steps += [(base + a, n, each, first) for a, n, each, first in plan]
        base += sum(counts.get(i, {}).values())
    table = np.array(steps or [(0, 0, 1, 0)], np.int64)
    if table.nbytes > MAX_PLAN_BYTES:
        raise ValueError(f"the plan takes {table.nbytes} bytes: pack the kinds of containers one by one")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column("number").to_numpy(zero_copy_only=False)
            step = table[np.searchsorted(table[:, 0], number, "right") - 1]
            container = step[:, 3] + (number - step[:, 0]) // step[:, 2]
            names = pa.array(kinds).take(b.column("kind"))
            yield pa.RecordBatch.from_arrays([names, pa.array(container), b.column("doc_id"), b.column("part"), b.column("token_from"), b.column("size")], ["container_kind", "container_id", "doc_id", "part", "token_from", "n_tokens"])

    return numbered.select("kind", "number", F.col("doc_id").cast("bigint"), "part", "token_from", "size").mapInArrow(assign, schema)


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """``(container_kind, n_containers, n_tokens, unused_tokens, fill)`` of each kind."""
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in capacities.items() for x in kv)), F.col("container_kind"))
    kind = packed.groupBy("container_kind").agg((F.max("container_id") + 1).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    room = F.col("n_containers") * cap
    return kind.select("container_kind", "n_containers", "n_tokens", (room - F.col("n_tokens")).alias("unused_tokens"), (F.col("n_tokens") / room).alias("fill"))


def capacities_of(specs: DataFrame) -> dict[str, int]:
    """Kinds and capacities, repeated rows once. More than ``MAX_KINDS`` kinds, or one with two capacities, raise. A null kind or capacity says nothing."""
    rows = specs.select("container_kind", "capacity_tokens").where("container_kind is not null and capacity_tokens is not null").groupBy("container_kind").agg(F.min("capacity_tokens").alias("least"), F.max("capacity_tokens").alias("most"))
    got = rows.limit(MAX_KINDS + 1).collect()
    if len(got) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    if two := sorted(r[0] for r in got if r[1] != r[2]):
        raise ValueError(f"more than one capacity for {', '.join(two[:5])}")
    return {r[0]: r[1] for r in got}
