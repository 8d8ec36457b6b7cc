import itertools

import pytest

from quillstone.llm import addresses as A
from tests.conftest import rows

ADDR = "struct<lines array<string>, city string, region string, country string, postal_code string>"


@pytest.mark.parametrize(
    "lines, city, region, country, postal, parsed",
    [
        (["397, boulevard de Drewel"], "Trilbueño", "DL", "ES", "82471", ("397", "drewel", "boulevard", "", "trilbuno", "82471", "ES")), (["E Rostalu Sq, 209", "bocurholton"], None, "LE", "US", None, ("209", "rostalu", "square", "e", "bocurholton", "", "US")),
        (["212 Drastind Street, 22th Floor, Sondthys 8910, SG"], None, None, None, None, ("212", "drastind", "street", "", "sondthys", "8910", "SG")), (["Harbour House", "190, Fomnutryweg"], "Lozurtheim", "FL", "DE", "57693", ("190", "fomnutry", "weg", "", "lozurtheim", "57693", "DE")),
        (["c/o The Company Secretary", "71, Lilagoplatz"], "79276 Trijiburg", None, None, None, ("71", "lilago", "platz", "", "trijiburg", "79276", "")), (["Stulkpris-Allee 19"], "St. Olk, BH", "DE-BH", "Germany", None, ("19", "stulkpris", "allee", "", "stolk", "", "DE")), (["Suite 5"], None, None, None, None, ("", "", "", "", "", "", "")),
        ([], None, None, None, None, ("", "", "", "", "", "", "")),
    ],
)
def test_parse(spark, lines, city, region, country, postal, parsed):
    df = spark.createDataFrame([("a", (lines, city, region, country, postal))], f"id string, address {ADDR}")
    assert rows(A.parsed_addresses(df, "id", "address")) == [("a", *parsed)]


def test_pairs(spark):
    same = [
        (["112 Zalukys Square"], "Zeiklyrt", "GF", "UK", "ZE77 1GH"), (["112 Zaluks Sq."], "ZE77 1GH zeiklyrt", None, "GB", None), (["Zalukys Sq, 112", "Unit 15B"], "Zeiiklyrt", None, "UK", None), (["Attn: Legal", "112 Zalukys Square"], None, None, "GB", "ZE77 1GH"), (["112 Zalukys Square"], "Zeiklyrt", "GF", "UK", "ZE77 1GH"),
    ]
    other = [(["113 Zalukys Square"], "Zeiklyrt", None, "UK", None), (["112 Zalukys Street"], "Zeiklyrt", None, "UK", None), (["112 N. Zalukys Square"], "Zeiklyrt", None, "UK", None), (["112 Zalukys Square"], "Farawayville", None, "UK", "AA11 1AA"), (["112 Zalukys Square"], "Zeiklyrt", None, "FR", None), (["Zalukys Square"], "Zeiklyrt", None, "UK", None), None, ([], None, None, None, None)]
    a = spark.createDataFrame([(f"a{i}", x, 1) for i, x in enumerate(same)] + [("a0", same[0], 1), (None, same[0], 1)], f"address_id string, headquarters_address {ADDR}, form int")
    b = spark.createDataFrame([(f"b{i}", x, 1) for i, x in enumerate(other)], f"address_id string, legal_address {ADDR}, street int")
    got = rows(A.found_pairs(a, b))
    assert got == sorted(itertools.combinations([f"a{i}" for i in range(5)], 2))


def test_all_copies_come_out_and_empty(spark):
    x = (["5 Long Road"], "Town", None, "GB", None)
    a = spark.createDataFrame([(f"h{i:02}", x) for i in range(20)], f"address_id string, headquarters_address {ADDR}")
    e = spark.createDataFrame([], f"address_id string, legal_address {ADDR}")
    assert A.found_pairs(a, e).count() == 190
    assert A.found_pairs(a.limit(0), e).count() == 0


def test_hot_blocks_are_narrowed_and_lose_nothing(spark, monkeypatch):
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    slip = lambda w, on: w[:on] + "x" + w[on + 1 :]
    made = []
    for town in ("zeiklyrt", "morvandel"):
        for street in [word(rng.randrange(6, 12)) for _ in range(25)]:
            made += [("5", street, "road", "", town, "", "GB"), ("5", slip(street, rng.randrange(len(street))), "road", "", town, "", "GB"), ("5", street, "road", "", slip(town, 3), "", "GB"), ("5", street, "road", "", "", f"{rng.randrange(9)}77", "GB")]
    df = spark.createDataFrame([(f"a{i:03}", *x) for i, x in enumerate(made)], "address_id string, " + ", ".join(f"{f} string" for f in A.FIELDS))
    want = rows(A.address_pairs(df))
    assert len(want) > 100
    for most in (0, 5, 40):
        monkeypatch.setattr(A, "HOT_BLOCK", most)
        assert rows(A.address_pairs(df)) == want


def test_groups_hold_copies_once(spark):
    x = ("5", "long", "road", "", "town", "", "GB")
    df = spark.createDataFrame([(f"a{i}", *x) for i in range(50)] + [("b", "5", "lonq", "road", "", "town", "", "GB")], "address_id string, " + ", ".join(f"{f} string" for f in A.FIELDS))
    members, links = A.place_groups(df)
    assert members.count() == 51 and links.count() == 1


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([("a", (["5 Long Road"], "Town", None, "GB", None))], f"address_id string, headquarters_address {ADDR}")
    text = A.parsed_addresses(df, "address_id", "headquarters_address")._jdf.queryExecution().toString()
    assert "Python" not in text and "MapInArrow" not in text
