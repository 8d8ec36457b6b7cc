"""Queries do the whole job: cases that cuts once left out."""

import itertools
import random

from pyspark.sql import functions as F

from quillstone.llm import addresses as A
from quillstone.llm import linkage as L
from tests.conftest import rows
from tests.llm.test_linkage import CAND, LEI

ADDRESS = "address_id string, " + ", ".join(f"{f} string" for f in A.FIELDS)


def pairs(spark, *addresses):
    return rows(A.address_pairs(spark.createDataFrame([(f"a{i}", *x) for i, x in enumerate(addresses)], ADDRESS)))


def test_towns_elsewhere_do_not_hide_the_only_one_that_competes(spark):
    far = [(str(n), "zalukys", "square", "", t, "", "GB") for n, t in enumerate("trilbuno lozurtheim farawayville bocurholton sondthys fomnutry drastind".split(), 200)]
    here = ("112", "zalukys", "square", "", "zeiklyrt", "", "GB"), ("112", "zalukys", "square", "", "", "77120", "GB"), ("112", "zaluks", "square", "", "zeiiklyrt", "", "GB")
    assert pairs(spark, *here, *far) == list(itertools.combinations(["a0", "a1", "a2"], 2))


def test_competing_towns_leave_the_postal_code_to_decide(spark):
    here = ("112", "zalukys", "square", "", "zeiklyrt", "", "GB"), ("112", "zalukys", "square", "", "", "77120", "GB"), ("112", "zalukys", "square", "", "farawayville", "", "GB")
    assert pairs(spark, *here) == []
    assert pairs(spark, *here, ("112", "zalukys", "square", "", "zeiklyr", "77120", "GB")) == [("a0", "a1"), ("a0", "a3"), ("a1", "a3")]


def test_slips_at_both_ends_of_a_street(spark):
    streets = [("lyquavuponk", "lyyquavupolk"), ("gdathar", "godaathar"), ("tanyskand", "tapyskeand")]
    got = pairs(spark, *((str(i), x, "street", "", "zeiklyrt", "", "GB") for i, both in enumerate(streets, 1) for x in both))
    assert got == [("a0", "a1"), ("a2", "a3"), ("a4", "a5")]


def test_streets_two_edits_apart_share_a_block(spark):
    rng = random.Random(7)
    made = []
    for k in range(3000):
        x = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        y = list(x)
        for _ in range(2):
            i = rng.randrange(len(y))
            y[i : i + rng.randint(0, 1)] = [rng.choice("abc")] * (rng.randint(0, 1) or len(y) == 1)
        made.append((k, *sorted(("".join(x), "".join(y)), key=len)))
    df = spark.createDataFrame(made, "k int, short string, long string").where(F.levenshtein("short", "long") <= 2)
    block = lambda c, blocks, name: df.select("k", F.col(c).alias("street"), *(F.lit("1").alias(x) for x in ("number", "kind", "direction"))).select("k", blocks.alias(name))
    met = block("short", A.kept_blocks(), "p").join(block("long", A.sought_blocks(), "q"), "k")
    assert met.count() > 2900 and met.where(~F.arrays_overlap("p", "q")).count() == 0


def test_slips_in_any_brand_meet_their_entity(spark):
    lei = ["Haecerlupuzo Marine Ltd", "Wamynd Brimjebri Insurance AB", "Walkdrei Ljasy", "Grundavel Fosterin Foods Ltd", "Komujiva Tarpolen Media AB"]
    cand = ["Haeerlupuzo Marine Ltd", "Wamyndbrimjberi Insurance AB", "Walkdreil Jsay", "Grudnavel Fostrein Foods Ltd", "Komjuiva Tarploen Media AB"]
    registry = L.registry_side(spark.createDataFrame([(f"L{i}", x, None, None, None) for i, x in enumerate(lei)], LEI))
    records = L.record_side(spark.createDataFrame([(i, x, [], None, None, None) for i, x in enumerate(cand)], CAND))
    assert rows(L.candidate_pairs(registry, records).select("lei", "candidate_id")) == [(f"L{i}", i) for i in range(5)]


def test_one_slip_leaves_a_half():
    rng = random.Random(3)
    for _ in range(5000):
        x = [rng.choice("abc") for _ in range(rng.randint(1, 16))]
        y, i = list(x), rng.randrange(len(x))
        if rng.random() < 0.3:
            y[i : i + 2] = reversed(y[i : i + 2])
        else:
            y[i : i + rng.randint(0, 1)] = rng.choice(([], ["a"], ["b"]))
        assert L._halves("".join(x), False) & L._halves("".join(y), True), (x, y)
