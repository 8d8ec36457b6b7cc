import random

import numpy as np

from quillstone.llm import abuse as A
from tests.conftest import rows

BAD = ["you are a filthy idiot", "shut up you worthless cretin", "i will break your bones", "they are all vermin and should be driven out", "kiss my arse you scumbag"]
GOOD = ["the filing was received on monday", "we report vermin in the warehouse was removed", "please send the annual report", "the board approved the dividend", "an idiot proof manual was printed"]


def corpus(n, seed, disguise=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = rng.random() < 0.35
        parts = [rng.choice(GOOD) + f" number {rng.randrange(99)}." for _ in range(rng.randrange(1, 8))]
        if y:
            b = rng.choice(BAD)
            if disguise:  # words of more than three letters
                b = " ".join(w.replace("i", "1").replace("a", "а") if len(w) > 3 else w for w in b.split())
            parts.insert(rng.randrange(len(parts) + 1), b + ".")
        out.append((i, " ".join(parts), int(y)))
    return out


def fitted(spark, n=500):
    noisy = [(i, t, y if i % 25 else 1 - y) for i, t, y in corpus(n, 1)]
    return A.fit(spark.createDataFrame(noisy, "doc_id bigint, text string, abusive int"))


def test_held_out_accuracy_with_wrong_labels_and_disguise(spark):
    m = fitted(spark)
    for disguise, least in ((False, 0.97), (True, 0.9)):
        held = corpus(300, 2, disguise)
        got = {r["doc_id"]: r["abusive"] for r in A.score(spark.createDataFrame(held, "doc_id bigint, text string, y int"), m).collect()}
        assert np.mean([got[i] == bool(y) for i, _, y in held]) >= least
    assert 0 < len(m.index) < 5_000


def test_scores_of_odd_rows(spark):
    m = fitted(spark, 200)
    data = [(1, None), (2, ""), (3, "..."), (4, "good day. " * 20_000 + BAD[0] + "."), (5, BAD[0]), (5, BAD[0]), (None, "x")]
    got = {(r["doc_id"], i): (round(r["score"], 9), r["abusive"]) for i, r in enumerate(A.score(spark.createDataFrame(data, "doc_id bigint, text string"), m).orderBy("doc_id").collect())}
    by = {}
    for (d, _), v in got.items():
        by.setdefault(d, []).append(v)
    assert len(got) == 7 and by[1] == [(0.0, False)] == by[2] == by[3] and by[4] == by[5][:1] and by[4][0][1]


def test_no_labels(spark):
    m = A.fit(spark.createDataFrame([], "doc_id bigint, text string, abusive int"))
    assert not A.score(spark.createDataFrame([(1, BAD[0])], "doc_id bigint, text string"), m).first()["abusive"]


def test_votes(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 0, "b"), (2, 1, "a"), (2, 1, "a"), (3, None, "a"), (4, 1, "a"), (4, 1, "b"), (4, 0, "c")], "doc_id bigint, abusive int, reviewer string")
    assert rows(A.settled_labels(df)) == [(2, 1), (4, 1)]


def test_disguises_read_alike():
    f = lambda t: [w for c in A.plain_text(t).split() for w in A._words(c)[0]]
    plain = f("you filthy idiot")
    for t in ("YOU FILTHY IDIOT", "you fi​lthy 1d10t", "you filthy іdіоt", "<b>you</b> filthy i d i o t", "you fílthy !d!ot"):
        assert set(plain) <= set(f(t)), t
    assert f("1234 mio.") == f("77 mio.")


def test_rates(spark):
    docs = spark.createDataFrame([(1, "s"), (2, "s"), (3, None)], "doc_id bigint, source string")
    scored = spark.createDataFrame([(1, 0.9, True), (2, 0.1, False), (3, 0.2, False)], "doc_id bigint, score double, abusive boolean")
    assert [(r["source"], r["n_docs"], r["n_abusive"], r["rate"]) for r in A.rates(docs, scored).orderBy("n_docs").collect()] == [(None, 1, 0, 0.0), ("s", 2, 1, 0.5)]


def test_sample_keeps_whole_texts_within_its_bounds(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 10, i % 2) for i in range(40)] + [(99, None, 1), (98, "y", None)], "doc_id bigint, text string, abusive int")
    assert A._sample(df, "text", "abusive").count() == 41
    monkeypatch.setattr(A, "MAX_CHARS", 95)
    few = A._sample(df, "text", "abusive").where("text is not null")
    assert few.count() == 9 and {r["text"] for r in few.collect()} == {"x" * 10}
    monkeypatch.setattr(A, "MAX_LABELLED", 5)
    assert A._sample(df, "text", "abusive").count() == 5


def test_threshold_lies_between_the_classes():
    scores, y = np.array([-2.5, -1.2, 1.4, 2.0]), np.array([0, 0, 1, 1])
    assert -1.2 < A.best_threshold(scores, y) < 1.4 and abs(A.best_threshold(scores, y) - 0.1) < 0.1
