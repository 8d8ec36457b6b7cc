import pytest
from pyspark.sql import functions as F

from quillstone.functions import dates, text


def value(spark, column, *args):
    df = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(column(*(F.col(f"c{i}") for i in range(len(args)))).alias("v")).first()[0]


@pytest.mark.parametrize(
    "column, given, expected",
    [
        (text.fold_ascii, "O’Neil & Sons, Inc.", "oneil and sons inc"), (text.fold_ascii, "  ", None), (text.fold_ascii, None, None), (text.fold_unicode, "Ｃafé ﬁn", "cafe fin"), (text.fold_unicode, None, None),
        (lambda c: text.strip_suffixes(text.fold_ascii(c)), "Alpha Corp. Ltd. Co", "alpha"), (lambda c: text.strip_suffixes(text.fold_ascii(c)), "Inc", None), (lambda c: text.strip_suffixes(text.fold_ascii(c)), "Coop Bank", "coop bank"),
        (text.resolver_name, "Delta (Dormant) S.A.", "delta"), (text.resolver_name, "Gamma Pty (fka Old Gamma)", "gamma"), (text.resolver_name, None, ""), (text.identity_key, "The Service Corp International /NEW/", "service international"), (text.identity_key, "Einride AB (publ)", "einride"),
        (text.address_key, "12 Main Street, Suite 5", "12 main st ste 5"), (text.jurisdiction_code, "United Kingdom", "GB"), (text.jurisdiction_code, " Narnia ", "Narnia"), (text.jurisdiction_code, "", None),
        (text.plain_bool, " Yes ", True), (text.plain_bool, "0", False), (text.plain_bool, "maybe", None), (text.url_host, "HTTPS://user@WWW.Example.com:8080/x?y", "www.example.com"), (text.url_host, "not a host", None),
        (lambda c: text.registrable_domain(c), "a.b.example.co.uk", "example.co.uk"), (lambda c: text.registrable_domain(c), "www.example.com", "example.com"), (lambda c: text.registrable_domain(c), "me.github.io", "me.github.io"),
        (text.strip_html, "<p>a &amp; b</p><script>x</script><div>c</div>", "a & b\n c"), (text.word_name, "Žluť  & Co.", "žluť co"),
    ],
)
def test_functions(spark, column, given, expected):
    assert value(spark, column, given) == expected


def test_phrases_match_whole_words_only(spark):
    hit = lambda name: value(spark, lambda n: text.has_phrase(text.word_name(n), F.lit("ntt")), name)
    assert all(hit(n) for n in ("NTT DATA", "NTT Ltd.", "ABC NTT Holdings")) and not any(hit(n) for n in ("Anttila", "Planttech", "Advantte", None))


@pytest.mark.parametrize("query, name, expected", [("acme", "acme", 1.0), ("acme", "acme one", 0.95), ("acme", "the acme one", 0.9), ("acme two", "the acme one", 0.5), ("acme", None, 0.0), ("a b", "b a", 0.74)])
def test_name_likeness(spark, query, name, expected):
    assert value(spark, text.name_likeness, query, name) == pytest.approx(expected)


def test_ids_ratios_and_nulls(spark):
    import hashlib

    assert value(spark, lambda a, b: text.stable_id("ent", a, b), " acme", None) == "ent:" + hashlib.sha256(b"acme|").hexdigest()[:24]
    assert value(spark, text.levenshtein_ratio, "abcd", "abxd") == 0.75 and value(spark, text.levenshtein_ratio, "", "x") is None
    assert value(spark, text.token_jaccard, "a b", "b c") == pytest.approx(1 / 3) and value(spark, text.token_jaccard, None, "x") is None


def test_decoding(spark):
    df = spark.createDataFrame([("“é”".encode(),), ("“é”".encode("cp1252"),), (None,)], "b binary")
    assert [r[0] for r in df.select(text.decoded(F.col("b"))).collect()] == ["“é”", "“é”", None]


@pytest.mark.parametrize("given, expected", [("2020-02-29T10:00:00Z", "2020-02-29"), ("20200229", "2020-02-29"), ("3-mar-2001", "2001-03-03"), ("March 3, 2001", "2001-03-03"), ("Sep 4, 2006", "2006-09-04"), ("2021-02-29", None), ("0000-00-00", None), ("", None), (None, None), ("9999-12-31", "9999-12-31"), ("soon", None)])
def test_calendar_day(spark, given, expected):
    got = value(spark, dates.calendar_day, given)
    assert (got.isoformat() if got else None) == expected


def test_utc_micros(spark):
    at = lambda s: value(spark, dates.utc_micros, s)
    assert at("2020-01-01T00:30:00+01:00") == at("2019-12-31 23:30:00") == at("2019-12-31T23:30:00.000Z") and at("x") is None and at("1970-01-02") == 86_400_000_000
