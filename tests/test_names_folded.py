import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import extraction as X
from quillstone.operators import regions as R
from tests.conftest import rows


@pytest.mark.parametrize("given, want", [("Société Générale", "societe generale"), ("ŽLUŤOUČKÝ & Söhne", "zlutoucky and sohne"), ("Groß ＡＧ", "gross ag"), ("école № 5", "ecole no5"), ("ﬁnance ½", "finance 1 2"), ("东京 KK", "kk"), ("", None), (None, None), ("ı", None)])
def test_fold_is_the_decomposition(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(T.fold_name(F.col("t"))).first()[0] in (want, want and want.replace("no5", "no 5"))


def test_fold_equals_unicodedata_on_every_letter(spark):
    import re
    import unicodedata

    text = [chr(i) for i in range(0x20, 0x1F200) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold().replace("&", " and ")
    want = {t: re.sub("[^a-z0-9]+", " ", re.sub("[’'`]", "", plain(f"a{t}b"))).strip() or None for t in text}
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in text], "t string").select("t", T.fold_name(F.concat(F.lit("a"), "t", F.lit("b")))).collect()}
    assert {t: (got[t], want[t]) for t in text if got[t] != want[t]} == {}


def test_overlapping_names_leave_the_longest(spark):
    docs = spark.createDataFrame([(1, "Alpha Beta Gamma Delta"), (2, "Société Générale de Banque, Alpha Beta"), (3, None), (4, "")], "doc_id bigint, text string")
    names = spark.createDataFrame([("1", "alpha beta"), ("2", "beta gamma delta"), ("3", "gamma delta"), ("4", "societe generale")], "name_id string, name string")
    assert [r[:2] + r[3:4] for r in rows(R.phrase_hits(docs, "text", names))] == [(1, 2, "2"), (2, 1, "4"), (2, 5, "1")]


def test_many_names_take_the_exchange(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_KEYS", 0)
    docs = spark.createDataFrame([(1, "see alpha beta")], "doc_id bigint, text string")
    assert R.phrase_hits(docs, "text", spark.createDataFrame([("1", "alpha beta")], "name_id string, name string")).count() == 1


def test_registry_mentions_are_as_the_text_writes_them(spark):
    docs = spark.createDataFrame([(1, "Then Société Générale S.A. (the “Bank”) and École ﬁne Ltd. met.")], "doc_id bigint, text string")
    names = spark.createDataFrame([("1", "societe generale s a"), ("2", "ecole fine ltd")], "name_id string, name string")
    got = X.registry_mentions(docs, "text", R.phrase_hits(docs, "text", names))
    assert [(r["name"], r["alias"]) for r in got.orderBy("name").collect()] == [("Société Générale S.A.", "Bank"), ("École ﬁne Ltd.", None)]
