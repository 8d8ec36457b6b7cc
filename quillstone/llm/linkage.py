"""Matching registry entities with provider records that share no key, by soft logic.

Candidate pairs share a key: a registration number; two words of the brand, in either order and among others; or, slips and moved
blanks included, a part that a slip leaves whole along with the letters' number: either half of the run-together brand, or an end
of each of two words. Keys of parts carry the brand, which is compared where the keys meet, so that no pair
whose brands differ by more than slips goes any further. Each pair is a variable between 0 and 1. Weighted rules say how far
evidence speaks for or against it, each rule a squared hinge:

    name(l, c) and place(l, c)        -> match(l, c)
    same_number(l, c) and support     -> match(l, c)
    other_number / other_place / other_name -> not match(l, c);   not match(l, c) for want of evidence
    exclusive:  the matches of a record c sum to at most 1
    transitive: match(l, c1) and same(c1, c2) -> match(l, c2)

The sum is convex. Alternating directions minimise it: the rules of single pairs, the exclusive rules by record and the
transitive rules by entity and set of like records each keep copies of the variables with closed minima, and
a consensus joins the copies, until no copy is further than ``RESIDUAL`` from it and it moves by no more. Rules bind only pairs
whose records are alike, so that the problem falls apart into one for each class of like records. A task solves the classes that
it holds, many at once; a class of more than ``LARGE`` pairs is solved by rounds of grouped sums over all tasks. The minimum is
the same, and the driver sees only counts. The consensus value is the confidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import adler32, crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillstone.llm.names import fold, parse_name, place_code, registration_key
from quillstone.llm.survivor import is_value
from quillstone.operators.intervals import lei
from quillstone.session import Scratch

# Weights of the rules; the penalty and relaxation of the alternating rounds, the largest residual that ends them, and the rounds after which it raises
W_NAME, W_NUMBER, W_PLACE_NOT, W_NUMBER_NOT, W_NAME_NOT, W_PRIOR = 3.0, 4.0, 2.0, 4.0, 1.0, 0.3
W_EXCLUSIVE, W_TRANSITIVE, RHO, RELAX, RESIDUAL, MOST_ROUNDS = 20.0, 1.0, 4.0, 1.8, 0.002, 500
LARGE = 20_000  # pairs of a class of like records beyond which several tasks share it
ACCEPT = 0.54  # two entities with the same evidence share a record at about 0.53 each

_NAME = pa.struct([("brand", pa.string()), ("joined", pa.string()), ("business", pa.string()), ("ordinal", pa.string()), ("form", pa.string())])
_KEY = pa.struct([("k", pa.int64()), ("brand", pa.string())])
_KEY_SQL = "struct<k bigint, brand string>"
_NAME_SQL = "struct<brand string, joined string, business string, ordinal string, form string>"


_umlaut = re.compile("([aou])e")


SHORT = 5  # letters of a word up to which its parts are all of it but one letter


def _halves(word: str, sought: bool) -> set[str]:
    """The word's length with its first and its last letters, of either one less than half: a slip, two letters that change places included, leaves one of them whole.

    Of a short word, the word itself and without any one letter. ``sought``: instead of the word's own, the parts of all words
    that are as long or a letter longer or shorter, as they would stand in this one.
    """
    lengths = (len(word) - 1, len(word), len(word) + 1) if sought else (len(word),)
    out = {f"{m}{x}" for m in lengths if m > SHORT for k in (m // 2 - 1,) for x in (f"<{word[:k]}", f">{word[-k:]}")}
    if min(lengths) <= SHORT:
        out |= {f"={word}", *(f"={word[:i]}{word[i + 1 :]}" for i in range(len(word)))}
    return out


def _ends(word: str) -> tuple[str, str]:
    """The first and the last letters, three or, of a short word, two: a slip leaves one of them as it was."""
    k = 3 if len(word) >= 6 else 2
    return f"<{word[:k]}", f">{word[-k:]}"


def _name_keys(brand: tuple[str, ...], joined: str, sought: bool) -> tuple[set[str], set[str]]:
    """(whole keys, keys of parts). An equal run-together brand shares its parts."""
    whole, parts = {f"P|{min(x, y)}|{max(x, y)}" for i, x in enumerate(brand) for y in brand[:i]}, {f"H|{x}" for x in _halves(joined, sought)}
    if len(brand) == 2:
        parts |= {f"B|{x}|{y}" for x in _ends(brand[0]) for y in _ends(brand[1])}
        if sought:  # a letter more or less makes a short word of a long one
            other = [[f"<{w[:k]}", f">{w[-k:]}"] for w in brand for k in (2 if len(w) == 6 else 3 if len(w) == 5 else 0,) if k]
            ends = [[*_ends(w), *(o for o in other if len(w) in (5, 6) and o[0] == f"<{w[: len(o[0]) - 1]}" for o in o)] for w in brand]
            parts |= {f"B|{x}|{y}" for x in ends[0] for y in ends[1]}
    return whole, parts


def _hashed(key: str) -> int:
    """A collision only adds a pair to look at."""
    return crc32(key.encode()) | adler32(key.encode()) << 31


def _parse(batches: Iterator[pa.RecordBatch], sought: bool = True) -> Iterator[pa.RecordBatch]:
    """(id, names, numbers, places, city, address) to the same, folded and split, and keys (k, brand), the brand empty for a whole key; names, numbers and places are arrays. ``sought``: as in ``_halves``."""
    plain = lambda t: _umlaut.sub(r"\1", "".join(c for c in fold(t) if c.isalnum())) if t else ""
    town = lambda t: plain(" ".join(w for w in re.sub(r",\s*[A-Za-z]{2}\s*$", "", t).split() if not any(c.isdigit() for c in w))) if t else ""
    for b in batches:
        ids, names, numbers, places, cities, lines = (c.to_pylist() for c in b.columns)
        split, regs, firsts, at, ends, hashes, brands = [], [], [], [0], [0], [], []
        for ns, raw in zip(names, numbers):
            row, ks, ps = {}, set(), set()
            for n in ns or ():
                brand, business, ordinal, form = parse_name(n) if n else ((), "", "", "")
                if brand:
                    joined = "".join(brand)
                    row[joined, business, ordinal, form] = " ".join(sorted(brand))
                    whole, parts = _name_keys(brand, joined, sought)
                    ks |= whole
                    ps |= {(k, joined) for k in parts}
            found = sorted({k for k in map(registration_key, raw or ()) if k})
            ks.update("R|" + k.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for k in found)
            firsts += row.values()
            split += row
            at.append(len(split))
            hashes += [_hashed(k) for k in ks]
            brands += [""] * len(ks)
            for k, joined in ps:
                hashes.append(_hashed(k))
                brands.append(joined)
            ends.append(len(hashes))
            regs.append(found)
        text = pa.list_(pa.string())
        struct = pa.StructArray.from_arrays([pa.array(firsts, pa.string()), *(pa.array([x[i] for x in split], pa.string()) for i in range(4))], fields=list(_NAME))
        keys = pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(brands, pa.string())], fields=list(_KEY))
        codes = [sorted({c for c in map(place_code, ps or ()) if c}) for ps in places]
        out = [b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), struct), pa.array(regs, text), pa.array(codes, text), pa.array([town(c) for c in cities], pa.string()), pa.array([plain(x) for x in lines], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys)]
        yield pa.RecordBatch.from_arrays(out, ["id", "names", "numbers", "places", "city", "address", "keys"])


def _parsed(rows: DataFrame, kind: str) -> DataFrame:
    return rows.mapInArrow(_parse, f"id {kind}, names array<{_NAME_SQL}>, numbers array<string>, places array<string>, city string, address string, keys array<{_KEY_SQL}>")


def registry_side(lei_entities: DataFrame) -> DataFrame:
    """One row a LEI with what any of its deliveries says: (id, names, numbers, places, cities, keys), folded; null and blank LEIs left out.

    The sets are gathered before the exchange, so that a LEI delivered very often is no burden.
    """
    low = lambda c: F.nullif(F.trim(F.lower(F.col(c))), F.lit(""))
    rows = lei_entities.select(lei("lei").alias("id"), F.when(is_value(F.col("legal_name")), F.regexp_replace(low("legal_name"), r"\s+", " ")).alias("name"), low("registration_number").alias("number"), low("legal_jurisdiction").alias("place"), low("legal_address_city").alias("city")).where("id <> ''")
    one = rows.groupBy("id").agg(*(F.collect_set(c).alias(c) for c in ("name", "number", "place", "city")))
    # the towns ride along as the address: one text, taken apart again after folding
    flat = one.select("id", "name", "number", "place", F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("t"), "city")
    return _parsed_registry(flat)


def _parsed_registry(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda t: _umlaut.sub(r"\1", "".join(c for c in fold(t) if c.isalnum()))
        for b in batches:
            (out,) = _parse(iter([pa.RecordBatch.from_arrays(b.columns[:6], ["id", "n", "r", "p", "c", "t"])]), sought=False)
            cities = [sorted({x for x in map(plain, cs or ()) if len(x) >= 4}) for cs in b.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(out.column(i) for i in (0, 1, 2, 3)), pa.array(cities, pa.list_(pa.string())), out.column(6)], ["id", "names", "numbers", "places", "cities", "keys"])

    return rows.mapInArrow(run, f"id string, names array<{_NAME_SQL}>, numbers array<string>, places array<string>, cities array<string>, keys array<{_KEY_SQL}>")


def record_side(candidates: DataFrame) -> DataFrame:
    """Provider records, (id, names, numbers, places, city, address, keys): present and other names, stand-ins left out."""
    real = lambda c: F.when(is_value(c), F.trim(c))
    names = F.array_compact(F.concat(F.array(real(F.col("legal_name"))), F.coalesce(F.transform("other_names", real), F.array().cast("array<string>"))))
    a = F.col("legal_address")
    text = F.concat_ws(" ", F.array_join(a["lines"], " "), a["city"])
    rows = candidates.select(F.col("candidate_id").alias("id"), F.struct(names.alias("names"), F.array(real(F.col("registration_id"))).alias("n"), F.array(real(F.col("jurisdiction"))).alias("p"), a["city"].alias("c"), text.alias("t")).alias("r")).where("id is not null")
    once = rows.groupBy("id").agg(F.max("r").alias("r"))  # a repeated row would claim its share twice
    return _parsed(once.select("id", "r.*"), "bigint")


def _met(registry: DataFrame, records: DataFrame) -> DataFrame:
    """(l, candidate_id) that share a whole key, or one of a part with brands no more than slips apart, each once; ``l`` is a number that stands for the LEI."""
    keyed = lambda df, key, name, brand: df.select(key.alias(name), F.explode("keys").alias("x")).select(name, "x.k", F.col("x.brand").alias(brand))
    met = keyed(registry, F.xxhash64("id"), "l", "brand").join(keyed(records, F.col("id"), "candidate_id", "other"), "k")  # LEIs as numbers: keys are many
    return met.where((F.col("brand") == F.col("other")) | ((F.col("brand") != "") & (F.col("other") != "") & _slips(F.col("brand"), F.col("other")))).select("l", "candidate_id").distinct()


def candidate_pairs(registry: DataFrame, records: DataFrame) -> DataFrame:
    """(lei, candidate_id) that are compared."""
    return registry.select(F.col("id").alias("lei"), F.xxhash64("id").alias("l")).join(_met(registry, records), "l").select("lei", "candidate_id")


def _slips(x: Column, y: Column) -> Column:
    """No more apart than by a slip in each of two words; letters that changed places count as one slip."""
    far = F.levenshtein(x, y, 4)  # -1 beyond
    return far.between(0, 3) | ((far == 4) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, ""))))


def _likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _name_score(x: Column, y: Column) -> Column:
    """How far two parsed names are the same company's: brand letters, and the same business, ordinal and form."""
    brand = F.greatest(_likeness(x["brand"], y["brand"]), _likeness(x["joined"], y["joined"]))
    either = (x["business"] == "") | (y["business"] == "")
    slip = F.levenshtein(x["business"], y["business"]) <= F.when(F.length(x["business"]) >= 8, 2).otherwise(1)
    business = F.when(x["business"] == y["business"], 1.0).when(either, 0.85).when(slip, 0.97).otherwise(0.3)
    ordinal = F.when(x["ordinal"] == y["ordinal"], 1.0).otherwise(0.35)
    form = F.when(x["form"] == y["form"], 1.0).when((x["form"] == "") | (y["form"] == ""), 0.97).otherwise(0.5)
    return F.when(brand < 0.72, brand * 0.3).otherwise(brand * business * ordinal * form)


def _either(p: Column, q: Column) -> Column:
    """``p`` is a code of two meanings, one of which fits ``q``."""
    return ((p == "CA?") & (q.isin("US", "US-CA") | (F.left(q, F.lit(2)) == "CA"))) | ((p == "DE?") & (q.isin("US", "US-DE") | (F.left(q, F.lit(2)) == "DE")))


def _evidence(pairs: DataFrame, registry: DataFrame, records: DataFrame) -> DataFrame:
    """Truth values of the rule bodies for every pair."""
    side = registry.select(F.xxhash64("id").alias("l"), F.col("id").alias("lei"), F.col("names").alias("l_names"), F.col("numbers").alias("l_numbers"), F.col("places").alias("l_places"), F.col("cities").alias("l_cities"))
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit("")).alias(c[:-1])
    both = pairs.join(side, "l").join(records.select(F.col("id").alias("candidate_id"), F.col("names").alias("c_names"), first("numbers"), first("places"), "city", "address"), "candidate_id")
    name = F.coalesce(F.array_max(F.flatten(F.transform("l_names", lambda x: F.transform("c_names", lambda y: _name_score(x, y))))), F.lit(-1.0))
    digits = lambda c: F.regexp_replace(c, "^[A-Z]+", "")
    n = F.col("number")
    same_number = (n != "") & F.exists("l_numbers", lambda r: digits(r) == digits(n))
    near = F.exists("l_numbers", lambda r: (F.length(n) >= 5) & ((F.levenshtein(r, n) <= 1) | ((F.levenshtein(r, n) == 2) & (F.array_sort(F.split(r, "")) == F.array_sort(F.split(n, ""))))))
    number = F.when((n == "") | (F.size("l_numbers") == 0), 0.0).when(same_number, 1.0).when(near, 0.6).otherwise(-1.0)
    p = F.col("place")
    one_place = lambda q: F.when(q == p, 1.0).when((F.left(q, F.lit(2)) == p) | (F.left(p, F.lit(2)) == q), 0.9).when(_either(p, q) | _either(q, p), 0.85).when(F.left(q, F.lit(2)) == F.left(p, F.lit(2)), 0.2).otherwise(0.0)
    place = F.when((p == "") | (F.size("l_places") == 0), -1.0).otherwise(F.array_max(F.transform("l_places", one_place)))
    cities = F.coalesce("l_cities", F.array().cast("array<string>"))
    city = F.when((F.col("address") == "") | (F.size(cities) == 0), 0.0).when(F.exists(cities, lambda x: F.contains(F.col("address"), x)), 1.0).when(F.exists(cities, lambda x: F.levenshtein(x, F.col("city")) <= 2), 0.9).when(F.col("city") == "", 0.0).otherwise(-1.0)
    like = F.xxhash64(F.when(n != "", F.concat_ws("|", n, F.left(p, F.lit(2)))).otherwise(F.concat_ws("|", F.col("c_names")[0]["joined"], F.col("c_names")[0]["business"], p, "city")))
    return both.select("lei", "candidate_id", name.alias("name"), number.alias("number"), place.alias("place"), city.alias("city"), like.alias("like"))


def _rules(e: DataFrame) -> DataFrame:
    """(lei, candidate_id, like, s1 .. for, d1 .. against): what each rule of a pair asks of its variable."""
    name, number, place, city = (F.col(c) for c in ("name", "number", "place", "city"))
    known = F.greatest(name, F.lit(0.0))
    where = F.when(place < 0, F.when(city > 0.8, 0.95).when(city < 0, 0.5).otherwise(0.75)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), place + F.when((city > 0.8) & (place > 0.1), 0.1).when((city < 0) & (place < 0.95), -0.1).otherwise(0.0))))
    support = F.greatest(F.when(name < 0, 0.5).otherwise(name), F.when(city > 0.8, 0.75).otherwise(0.0)) + F.when(place >= 0.8, 0.3).when(place < 0, 0.1).otherwise(F.when(place < 0.1, -0.6).otherwise(0.0))
    return e.select(
        "lei", "candidate_id", "like",
        F.greatest(known + where - 1, F.lit(0.0)).alias("s_name"),
        F.when(number > 0, number * F.least(F.lit(1.0), F.greatest(support, F.lit(0.0)))).otherwise(0.0).alias("s_number"),
        F.when(place < 0, 0.0).otherwise(1 - F.greatest(place, F.lit(0.0))).alias("d_place"),
        F.when(number < 0, 1.0).otherwise(0.0).alias("d_number"),
        F.when((name >= 0) & (number <= 0), 1 - known).when(name >= 0, 0.5 * (1 - known)).otherwise(0.0).alias("d_name"),
    )


_RULES = ("s_name", "s_number", "d_place", "d_number", "d_name")


def _least(v: np.ndarray, rho: float, s_name: np.ndarray, s_number: np.ndarray, d_place: np.ndarray, d_number: np.ndarray, d_name: np.ndarray) -> np.ndarray:
    """Minimum over y in [0, 1] of the rules of a pair plus rho/2 (y - v)^2: Newton's method on the active hinges, exact once they hold."""
    for_ = [(s_name, W_NAME), (s_number, W_NUMBER)]
    against = [(1 - d_place, W_PLACE_NOT), (1 - d_number, W_NUMBER_NOT), (1 - d_name, W_NAME_NOT)]
    y = np.clip(v, 0, 1)
    for _ in range(8):
        top, bottom = rho * v, rho + 2 * W_PRIOR
        for s, w in for_:
            on = 2 * w * (s > y)
            top, bottom = top + on * s, bottom + on
        for s, w in against:
            on = 2 * w * (y > s)
            top, bottom = top + on * s, bottom + on
        before, y = y, np.clip(top / bottom, 0, 1)
        if (np.abs(y - before) < 1e-12).all():
            break
    return y


def _step(z: np.ndarray, u: list[np.ndarray], x: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(consensus, scaled multipliers, residual of each pair) after the copies ``x``, over-relaxed."""
    apart = np.max([np.abs(c - z) for c in x], axis=0)
    x = [RELAX * c + (1 - RELAX) * z for c in x]
    after = np.clip(sum(c + w for c, w in zip(x, u)) / 3, 0, 1)
    return after, [w + c - after for c, w in zip(x, u)], np.maximum(apart, np.abs(after - z))


def solve(record: np.ndarray, group: np.ndarray, rules: list[np.ndarray]) -> np.ndarray:
    """Confidences of pairs given by codes of their records and of their sets of (entity, like records): the minimum of all rules together."""
    n_record, n_group = np.bincount(record)[record], np.bincount(group)[group]
    out = _least(np.full(len(record), 0.5), 1e-9, *rules)
    on = np.flatnonzero((n_record > 1) | (n_group > 1))  # the others are bound by their own rules only
    if not len(on):
        return out
    rules, n = [r[on] for r in rules], n_record[on]
    record, group = (np.unique(x[on], return_inverse=True)[1] for x in (record, group))
    z, u, sizes = out[on], [np.zeros(len(on))] * 3, np.bincount(group)
    for _ in range(MOST_ROUNDS):
        v = [z - w for w in u]
        over = np.maximum(np.bincount(record, v[1]) - 1, 0)[record]
        mean = (np.bincount(group, v[2]) / sizes)[group]
        x = [_least(v[0], RHO, *rules), v[1] - over * 2 * W_EXCLUSIVE / (RHO + 2 * W_EXCLUSIVE * n), mean + (v[2] - mean) * RHO / (RHO + 2 * W_TRANSITIVE)]
        z, u, residual = _step(z, u, x)
        if residual.max() <= RESIDUAL:
            out[on] = z
            return out
    raise RuntimeError(f"{(residual > RESIDUAL).sum()} pairs are not settled after {MOST_ROUNDS} rounds")


PAIRS_AT_ONCE = 40_000


def _solve_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole classes of rows sorted by ``like``, at least ``PAIRS_AT_ONCE`` pairs of them at a time but at the end."""
    held: list[pa.RecordBatch] = []

    def solved(t: pa.Table) -> pa.RecordBatch:
        like = t["like"].to_numpy()
        leis, records = (t[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lei", "candidate_id"))
        group = np.unique(np.stack([like, leis]), axis=1, return_inverse=True)[1].ravel()
        z = solve(records, group, [t[r].to_numpy() for r in _RULES])
        return pa.RecordBatch.from_arrays([t["lei"].combine_chunks(), t["candidate_id"].combine_chunks(), pa.array(z)], ["lei", "candidate_id", "confidence"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= PAIRS_AT_ONCE:
            t = pa.Table.from_batches(held)
            like = t["like"].to_numpy()
            cut = int(np.searchsorted(like, like[-1]))  # the last class may go on
            if cut:
                yield solved(t.slice(0, cut))
            held = t.slice(cut).to_batches()
    if held:
        yield solved(pa.Table.from_batches(held))


@F.pandas_udf(DoubleType())
def _single(v: pd.Series, rho: pd.Series, s_name: pd.Series, s_number: pd.Series, d_place: pd.Series, d_number: pd.Series, d_name: pd.Series) -> pd.Series:
    return pd.Series(_least(v.to_numpy(), rho.to_numpy(), *(x.to_numpy() for x in (s_name, s_number, d_place, d_number, d_name))))


def _shared_rounds(rules: DataFrame, scratch: Scratch) -> DataFrame:
    """As ``solve``, by grouped sums: no class, record or set is any single task's."""
    zero = F.lit(0.0)
    n = rules.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_record"))
    state = scratch.write(rules.join(n, "candidate_id").withColumns({"z": _single(F.lit(0.5), F.lit(1e-9), *_RULES), "u1": zero, "u2": zero, "u3": zero}))
    z = F.col("z")
    for _ in range(MOST_ROUNDS):
        total = state.groupBy("candidate_id").agg(F.sum(z - F.col("u2")).alias("total"))
        mean = state.groupBy("lei", "like").agg(F.avg(z - F.col("u3")).alias("mean"))
        x = state.join(total, "candidate_id").join(mean, ["lei", "like"]).withColumns({
            "x1": _single(z - F.col("u1"), F.lit(RHO), *_RULES),
            "x2": z - F.col("u2") - F.greatest(F.col("total") - 1, zero) * 2 * W_EXCLUSIVE / (RHO + 2 * W_EXCLUSIVE * F.col("n_record")),
            "x3": F.col("mean") + (z - F.col("u3") - F.col("mean")) * RHO / (RHO + 2 * W_TRANSITIVE),
        })
        x = x.withColumn("apart", F.greatest(*(F.abs(F.col(f"x{i}") - z) for i in (1, 2, 3)))).withColumns({f"x{i}": RELAX * F.col(f"x{i}") + (1 - RELAX) * z for i in (1, 2, 3)})
        x = x.withColumn("after", F.greatest(zero, F.least(F.lit(1.0), sum((F.col(f"x{i}") + F.col(f"u{i}") for i in (2, 3)), F.col("x1") + F.col("u1")) / 3)))
        x = x.withColumns({**{f"u{i}": F.col(f"u{i}") + F.col(f"x{i}") - F.col("after") for i in (1, 2, 3)}, "apart": F.greatest("apart", F.abs(F.col("after") - z)), "z": F.col("after")})
        after, (left,) = scratch.write_counting(x.select(*state.columns, "apart"), F.count_if(F.col("apart") > RESIDUAL))
        scratch.drop(state)
        state = after.drop("apart")
        if not left:
            return state.select("lei", "candidate_id", F.col("z").alias("confidence"))
    raise RuntimeError(f"{left} pairs are not settled after {MOST_ROUNDS} rounds")


def infer(rules: DataFrame, scratch: Scratch) -> DataFrame:
    """(lei, candidate_id, confidence): the minimum of all rules together. Rules not settled after ``MOST_ROUNDS`` rounds raise."""
    large, (n,) = scratch.write_counting(rules.groupBy("like").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("like"), F.count(F.lit(1)))
    small = rules if not n else rules.join(large, "like", "left_anti")
    out = small.repartition("like").sortWithinPartitions("like").mapInArrow(_solve_classes, "lei string, candidate_id bigint, confidence double")
    return out if not n else out.unionByName(_shared_rounds(rules.join(large, "like", "left_semi"), scratch))


def link(lei_entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(lei, candidate_id, confidence)`` of the pairs that share a key and that evidence doesn't rule out.

    Null and blank names, numbers and places are no evidence; records without any link to nothing. Repeated rows count once.
    """
    scratch = Scratch(lei_entities.sparkSession)
    registry, records = scratch.write(registry_side(lei_entities)), scratch.write(record_side(candidates))
    evidence = scratch.write(_evidence(_met(registry, records), registry, records))  # written, so that its long expressions run once
    return infer(_rules(evidence), scratch)


def found_links(lei_entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(lei, candidate_id)`` with a confidence of at least ``ACCEPT``."""
    return link(lei_entities, candidates).where(F.col("confidence") >= ACCEPT).select("lei", "candidate_id").distinct()
