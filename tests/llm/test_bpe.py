import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import bpe
from tests.conftest import rows

PATH = f"{bpe.TOKENIZERS}/{bpe.BYTE_BPE}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def replay():
    return bpe.MergeReplay(PATH)


CASES = ["", " ", "a", "aaa aaaa aaaaaaa", "<|endoftext|> is text", "  \n\n x\t", "l'été n'est 123456", "日本語のテスト。", "🇩🇪👨‍👩‍👧 é̀", "\x00\x7f", "x" * 3_000, "ab " * 2_000]


def test_cases(library, replay):
    assert replay.encode(CASES) == library(CASES)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn")), max_size=60), max_size=6))
def test_any_text(library, replay, texts):
    assert replay.encode(texts) == library(texts)


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    r = bpe.MergeReplay(PATH)
    texts = ["one two three four five", "one two six", "three seven one"]
    assert [r.encode([t])[0] for t in texts] == library(texts)


def test_tables(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHARS_AT_ONCE", 20)
    data = [(1, "hello world", "c"), (2, None, "c"), (3, "", "c"), (1, "hello world", "c"), (4, "long " * 500, "c"), (None, "x", "c")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    got = rows(bpe.token_ids(df))
    assert got == sorted(((i, library([t or ""])[0]) for i, t, _ in data), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows(bpe.token_counts(df)) == sorted(((i, len(x)) for i, x in got), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows(bpe.corpus_token_ids(df)) == got
    assert bpe.token_ids(df.where("doc_id > 9")).count() == 0 == bpe.corpus_token_ids(df.where("doc_id > 9")).count()
