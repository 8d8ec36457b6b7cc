"""Registrants of domains or networks against registry entities: conservative, a second structured signal besides the name."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillstone.functions import likeness
from quillstone.functions import text as T


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp likeness, 0 when either is null or empty; the order of the two matters. In Arrow batches."""

    @F.pandas_udf(DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() if p and q else 0.0 for p, q in zip(x, y)])

    return ratio(a, b)


def _blocks(names: Column) -> Column:
    """First words and runs of two words of the names: what two names of one company have in common."""
    words = lambda n: F.split(n, " ")
    first = F.transform(names, lambda n: words(n)[0])
    pairs = F.flatten(F.transform(names, lambda n: F.when(F.size(words(n)) > 1, F.transform(F.sequence(F.lit(1), F.size(words(n)) - 1), lambda i: F.array_join(F.slice(words(n), i, 2), " "))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.filter(F.concat(first, pairs), lambda k: k != ""))


HOT_ROWS = 4096  # entities of a key that one task compares; more are dealt to several, each with the key's registrants
CHUNK = 65_536  # pairs compared at once
NONE, CONFLICT, SAME = 0, 1, 2  # what two places say; the index of their country score
COUNTRY_SCORES = (None, 0.0, 1.0)


def match(registrants: DataFrame, entities: DataFrame, limit: int | None = None, least: Mapping[float | None, float] | None = None) -> DataFrame:
    """(resource, entity_id, name_score, address_score, country_score, score, decision), the best ``limit`` of each resource if given.

    ``registrants``: (resource, names array<string>, address, country); ``entities``: (entity_id, names array<string>, address, jurisdiction).
    Pairs share a first word or two words in a row. Null names, addresses and places are no evidence. ``least``: by country score (1.0, 0.0 or
    None) the smallest name score that is asked for; a pair below it doesn't come out, and is mostly told by bounds. Without, all pairs do.

    A name meets others where their keys do, and pairs are scored there: only names are exchanged, never pairs. A pair of several keys is scored
    under the first.
    """
    fold = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.resolver_name), lambda n: n != "")
    left = _keyed(registrants, "resource", fold(F.col("names")), "country")
    right = _keyed(entities, "entity_id", fold(F.col("names")), "jurisdiction")
    hot = right.groupBy("k").count().where(F.col("count") > HOT_ROWS).select("k", F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("n"))
    dealt = lambda rows, part: rows.join(F.broadcast(hot), "k", "left").withColumn("part", part).drop("n")
    left = dealt(left, F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)))
    right = dealt(right, F.coalesce(F.pmod(F.xxhash64("entity_id"), F.col("n")).cast("int"), F.lit(0)))
    both = left.withColumn("known", F.lit(False)).unionByName(right.withColumn("known", F.lit(True)), allowMissingColumns=True)
    wanted = [(least or {}).get(c, 0.0 if least is None else math.inf) for c in COUNTRY_SCORES]
    schema = StructType([left.schema["resource"], right.schema["entity_id"], *(StructField(n, DoubleType()) for n in ("name_score", "address_score", "country_score"))])
    scored = both.repartition("k", "part").sortWithinPartitions("k", "part", "known").mapInArrow(_scorer(wanted, schema.names), schema)
    support = (F.col("address_score") >= 0.7) | F.coalesce(F.col("country_score") == 1, F.lit(False))
    conflict = F.coalesce(F.col("country_score") == 0, F.lit(False))
    n = F.col("name_score")
    decision = F.when((n >= 0.9) & support & ~conflict, "strong_candidate").when((n >= 0.8) & ~conflict, "review").when(conflict | (n < 0.65), "reject").otherwise("weak_candidate")
    out = scored.select("resource", "entity_id", "name_score", "address_score", "country_score", (0.62 * n + 0.28 * F.col("address_score") + 0.1 * F.coalesce("country_score", F.lit(0.0))).alias("score"), decision.alias("decision"))
    if limit is None:
        return out
    return out.withColumn("_k", F.row_number().over(Window.partitionBy("resource").orderBy(F.desc("score"), "entity_id"))).where(F.col("_k") <= limit).drop("_k")


def _keyed(rows: DataFrame, unit: str, names: Column, place: str) -> DataFrame:
    """(unit, names, address, place, k, before): a row for each key of a unit, with the keys that come before it; rows of one unit are one."""
    rows = rows.where(F.col(unit).isNotNull()).select(unit, names.alias("names"), T.address_key(F.col("address")).alias("address"), F.upper(place).alias("place"))
    rows = rows.groupBy(unit).agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"), F.first("address").alias("address"), F.first("place").alias("place"))
    rows = rows.withColumn("keys", F.array_sort(_blocks(F.col("names"))))
    return rows.select(unit, "names", "address", "place", "keys", F.posexplode("keys").alias("at", "k")).withColumn("before", F.slice("keys", F.lit(1), F.col("at"))).drop("keys", "at")


def _scorer(wanted: list[float], columns: list[str]):
    """Scores the pairs of rows sorted by key and part, registrants first; of a key only the registrants are held from batch to batch."""

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
            k, part, known = t["k"].chunk(0).dictionary_encode().indices.to_numpy(), t["part"].to_numpy(), t["known"].to_numpy()
            group = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (part[1:] != part[:-1]))])
            for i, j, name, address, country in _scored(t, group, known, wanted):
                yield pa.RecordBatch.from_arrays([t["resource"].chunk(0).take(pa.array(i)), t["entity_id"].chunk(0).take(pa.array(j)), pa.array(name), pa.array(address), country], columns)
            held = t.filter(pa.array(~known & (group == group[-1])))

    return run


def _scored(t: pa.Table, group: np.ndarray, known: np.ndarray, wanted: list[float]):
    """Chunks of (rows of registrants, rows of entities, name scores, address scores, country scores): the pairs of each group that are asked for."""
    n_known = np.bincount(group, known)
    n_left = np.bincount(group) - n_known
    meet = np.flatnonzero((n_known > 0) & (n_left > 0))
    if not len(meet):
        return
    begin = np.searchsorted(group, meet)
    middle, end = begin + n_left[meet].astype(int), np.searchsorted(group, meet, side="right")
    names, address = _Names(t["names"].chunk(0)), t["address"].to_pylist()
    before, country = t["before"].to_pylist(), _Countries(t["place"].chunk(0))
    stated = np.array([bool(x) for x in address])
    wanted = np.array(wanted)

    def scores(parts):
        i, j = (np.concatenate(x) for x in zip(*parts))
        c = country(i, j)
        some = np.flatnonzero(wanted[c] <= 1)
        i, j, c = i[some], j[some], c[some]
        at, name = names.best(i, j, wanted[c])
        i, j, c = i[at], j[at], c[at]
        alike = np.zeros(len(i))
        for p in np.flatnonzero(stated[i] & stated[j]):
            alike[p] = SequenceMatcher(None, address[i[p]], address[j[p]]).ratio()
        return i, j, name, alike, pa.array(np.where(c == SAME, 1.0, 0.0), mask=c == NONE)

    parts, n = [], 0
    for first, mid, last in zip(begin, middle, end):
        seen = _by_key(before, first, mid)
        shared = [(np.array(seen[k]), np.array(rows) - mid) for k, rows in _by_key(before, mid, last, seen).items()]
        each = max(1, CHUNK // int(last - mid))
        for at in range(first, mid, each):
            upto = min(at + each, mid)
            new = np.ones((upto - at, last - mid), dtype=bool)
            for rows, others in shared:
                new[np.ix_(rows[(rows >= at) & (rows < upto)] - at, others)] = False
            p, q = np.nonzero(new)
            parts.append((p + at, q + mid))
            n += len(p)
            if n >= CHUNK:
                yield scores(parts)
                parts, n = [], 0
    if n:
        yield scores(parts)


def _by_key(before: list[list[str]], first: int, last: int, only=None) -> dict[str, list[int]]:
    """Rows by each key that comes before theirs, of the keys in ``only`` if given."""
    out = defaultdict(list)
    for r in range(first, last):
        for k in before[r]:
            if only is None or k in only:
                out[k].append(r)
    return out


class _Names:
    """Names of rows, and the best likeness of two rows' names."""

    def __init__(self, names: pa.ListArray):
        self.strings = likeness.Strings(names.flatten().to_pylist())
        self.count = names.value_lengths().to_numpy()
        self.first = np.cumsum(self.count) - self.count

    def best(self, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of rows those whose best score is at least ``least`` (their numbers), and the score."""
        n = self.count[i] * self.count[j]
        pair = np.repeat(np.arange(len(i)), n)
        nth, others = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n), self.count[j[pair]]
        at, score = likeness.ratios(self.strings, self.strings, self.first[i[pair]] + nth // others, self.first[j[pair]] + nth % others, least[pair])
        best = np.full(len(i), -1.0)
        np.maximum.at(best, pair[at], score)
        found = np.flatnonzero(best >= 0)
        return found, best[found]


class _Countries:
    """Whether the places of two rows, in upper case, say one country: one is part of the other. No place is no evidence."""

    def __init__(self, places: pa.Array):
        coded = pc.fill_null(places, "").dictionary_encode()
        self.code, self.places = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        self.table = np.full(len(self.places) ** 2, -1, dtype=np.int8) if len(self.places) <= 1024 else None

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        pairs = self.code[i] * len(self.places) + self.code[j]
        if self.table is None:
            each, at = np.unique(pairs, return_inverse=True)
            return np.array([self._tell(p) for p in each.tolist()], dtype=np.int8)[at]
        for p in np.unique(pairs[self.table[pairs] < 0]).tolist():
            self.table[p] = self._tell(p)
        return self.table[pairs]

    def _tell(self, pair: int) -> int:
        a, b = (self.places[x] for x in divmod(pair, len(self.places)))
        return NONE if not a or not b else SAME if a in b or b in a else CONFLICT


def attribution_evidence(matches: DataFrame) -> DataFrame:
    """(resource, entity_id, evidence_type, supports): a name and its country speak for the entity, a like name in another country against it."""
    n, c = F.col("name_score"), F.col("country_score")
    kind = F.when((n >= 0.9) & (c == 1), "RDAP_ATTRIBUTION_MATCH").when((n >= 0.65) & (c == 0), "RDAP_ATTRIBUTION_CONFLICT")
    return matches.select("resource", "entity_id", kind.alias("evidence_type"), (kind == "RDAP_ATTRIBUTION_MATCH").alias("supports")).where("evidence_type is not null")
