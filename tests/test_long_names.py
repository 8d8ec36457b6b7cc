from quillstone.operators import regions as R
from tests.conftest import rows


def test_names_of_more_than_twelve_words_hit(spark):
    name = " ".join(f"word{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"See {name}, today"), (2, name.rsplit(" ", 1)[0])], "doc_id bigint, text string")
    names = spark.createDataFrame([("a", name), ("b", "word0 word1")], "name_id string, name string")
    assert rows(R.phrase_hits(docs, "text", names).select("doc_id", "position", "name_id")) == [(1, 2, "a"), (2, 1, "b")]
