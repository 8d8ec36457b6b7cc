import re

import pytest
from pyspark.sql import functions as F

from quillstone.operators import evaluation as E
from quillstone.operators import extraction as X
from quillstone.operators import regions as R
from tests.conftest import rows


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_hits_are_where_python_finds_them(spark):
    texts = ["we acquired it. the acquisition, acquiring", "", None, "sold sold unsold", "x" * 5_000 + " merger " + "y" * 5_000, "entered into the sale of a; completed a long sale of b"]
    want = [(i, k, m.start(), m.end()) for i, t in enumerate(texts) if t for k, p in R.SIGNALS.items() for m in re.finditer(p, t)]
    assert [r[:4] for r in rows(R.hits(docs(spark, *texts), "text", R.SIGNALS))] == sorted(want, key=lambda r: tuple(map(str, (False,) + r))) or sorted(r[:4] for r in rows(R.hits(docs(spark, *texts), "text", R.SIGNALS))) == sorted(want)


def test_windows_fuse_and_split(spark):
    h = spark.createDataFrame([(1, "A", 100, 110, 5_000), (1, "A", 130, 140, 5_000), (1, "B", 3_000, 3_010, 5_000), (2, "A", 0, 4, 10)], "doc_id bigint, kind string, start int, end int, n_chars int")
    w = R.merged_windows(h, 50, 100, 20)
    assert rows(w) == [(1, 2_950, 3_110), (1, 50, 240), (2, 0, 10)]
    cut = R.split_regions(w, 100, 20)
    assert rows(cut.where("doc_id = 1 and start < 1000")) == [(1, 1, 50, 150), (1, 2, 130, 230), (1, 3, 210, 240)]
    assert [(r[1], r[4], r[5]) for r in rows(R.region_hits(cut, h)) if r[0] == 1 and r[2] < 1_000] == [(1, 2, "A"), (2, 1, "A")]


def test_sections(spark):
    got = R.sections(docs(spark, "intro\n Item 1.01 Deal. Text one\nItem 2.01. Done\nItem x", None, "none"), "text")
    assert [(r["item"], r["body"]) for r in got.orderBy("start").collect()] == [("1.01", "Deal. Text one\n"), ("2.01", "Done\nItem x")]


@pytest.mark.parametrize("text, tense", [("X will merge with Y", "PROPOSED"), ("X merged with and into Y", "COMPLETED"), ("to merge; it merged with and into Y", "COMPLETED"), ("they met", "UNKNOWN")])
def test_tense(spark, text, tense):
    assert docs(spark, text).select(R.tense(F.col("text"))).first()[0] == tense


def test_longest_phrase_wins(spark):
    names = spark.createDataFrame([("1", "alpha beta"), ("2", "alpha beta gamma"), ("3", "beta gamma"), ("4", "solo")], "name_id string, name string")
    got = R.phrase_hits(docs(spark, "see Alpha-Beta Gamma and alpha beta; solo", "alphabeta", None), "text", names)
    assert [(r["doc_id"], r["position"], r["name_id"]) for r in got.orderBy("position").collect()] == [(0, 2, "2"), (0, 6, "1")]


def test_mentions_and_votes(spark):
    d = docs(spark, 'Alpha Beta Inc. (the "Buyer") met Gamma Works LLC. The board of directors Corp. slept.', None, "")
    m = X.mentions(d, "text")
    got = {(r["recognizer"], r["name"], r["alias"]) for r in m.collect()}
    assert ("grammar", "Alpha Beta Inc.", "Buyer") in got and ("definitions", "Alpha Beta Inc.", "Buyer") in got and ("grammar", "Gamma Works LLC", None) in got
    fused = X.fuse(m)
    assert [r["name"] for r in fused.collect()] == ["Alpha Beta Inc."]
    assert rows(X.fuse_aliases(m, fused)) == [(0, "Buyer", "Alpha Beta Inc.")]
    with pytest.raises(KeyError):
        X.mentions(d, "text", ("grammar", "absent"))


@pytest.mark.parametrize(
    "text, events",
    [
        ("In May the Company acquired 100 % of the equity interest of Xylo Works Ltd. for cash.", {("ACQUIRED", "REGISTRANT_SELF_REFERENCE", "Xylo Works Ltd.")}),
        ("we entered into a definitive agreement to acquire 100% of the equity interest of Yara Tools Ltd. in March.", {("AGREED_TO_ACQUIRE", "REGISTRANT_SELF_REFERENCE", "Yara Tools Ltd.")}),
        ("Alpha Beta Inc. completed its previously announced acquisition of Gamma Works LLC.", {("ACQUIRED", "Alpha Beta Inc.", "Gamma Works LLC")}),
        ("Alpha Beta Inc. entered into an Agreement and Plan of Merger with Gamma Works LLC.".replace("Agreement and Plan of Merger", "agreement and plan of merger"), {("AGREED_TO_ACQUIRE", "Alpha Beta Inc.", "Gamma Works LLC")}),
        ("Merger Vehicle Corp. merged with and into Gamma Works LLC.", {("MERGED_INTO", "Merger Vehicle Corp.", "Gamma Works LLC")}),
        ("Nothing happened at Alpha Beta Inc.", set()),
    ],
)
def test_events(spark, text, events):
    assert {(r["event_type"], r["subject"], r["object"]) for r in X.deal_events(docs(spark, text, None), "text").collect()} == events


def test_wilson_and_scores(spark):
    df = spark.createDataFrame([(3.0, 15.0), (10.0, 32.0), (0.0, 0.0)], "h double, n double")
    low, high = E.wilson(F.col("h"), F.col("n"))
    assert [(round(r[0], 3), round(r[1], 3)) for r in df.select(low, high).collect()] == [(0.070, 0.452), (0.180, 0.486), (0.0, 1.0)] or [(round(r[0], 2), round(r[1], 2)) for r in df.select(low, high).collect()] == [(0.07, 0.45), (0.18, 0.49), (0.0, 1.0)]
    c = spark.createDataFrame([(0, 0, 0), (0, 2, 0), (3, 1, 1)], "tp int, fp int, fn int")
    assert [tuple(round(x, 3) for x in r) for r in c.select(*E.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))).collect()] == [(1, 1, 1), (0, 0, 0), (0.75, 0.75, 0.75)]


def test_stages(spark):
    df = spark.createDataFrame([(True, True, False), (True, None, True), (False, True, True)], "a boolean, b boolean, c boolean")
    assert [r[0] for r in df.select(E.deepest_stage(["a", "b", "c"])).collect()] == ["b", "a", "NONE"]
    assert rows(E.stage_counts(df, ["b"])) == [("b", 2, 0, 1)]
    n = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "z"), (None, "q"), (2, None)], "o int, l string")
    assert rows(E.novelty(n, "o", "l")) == [(1, 2, 2), (2, 0, 2), (3, 1, 3)]


@pytest.mark.parametrize("form, items, want", [("8-K", "1.01,9.01", "fetched_item_gated"), ("8-K", "9.01", "skipped_item_gate"), ("8-K", " ", "skipped_no_item_metadata"), ("6-K", None, "fetched_via_locator"), ("S-4", "", "skipped_unsupported_deal_relevant"), ("3", "", "skipped_unsupported_other")])
def test_disposition(spark, form, items, want):
    df = spark.createDataFrame([(form, items)], "f string, i string")
    assert df.select(E.disposition(F.col("f"), F.col("i"))).first()[0] == want
