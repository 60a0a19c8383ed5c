import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chainlake.llm import tokens

LIBRARY = Tokenizer.from_file(tokens.vocabulary_path())
COUNTER = tokens.merge_counter(tokens.vocabulary_path())


def by_library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize(
    "text",
    ["", " ", "  ", "a", " a", "a  b", "a \n b", "\n\n x", "the cat's  whiskers", "ééé für São", "日本語 テキスト", "x" * 3000, "ab" * 500, "1234 56,78", "a<|endoftext|> b<|endoftext|>", "<|endoftext|>", "tab\t tab", "\x1c \x85 \xa0 　 z", "a　 b", "end ", "end\n"],
)
def test_counts_equal_the_library(text):
    assert COUNTER.count(text) == by_library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeTh  \n\t'sé1,.<|>ü 日"), max_size=60))
def test_counts_equal_the_library_on_mixed_text(text):
    assert COUNTER.count(text) == by_library(text)


def test_table_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: by_library(r.text) for r in docs.collect()}
    got = tokens.token_counts(docs).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, 9), (None, "a b", 9), (2, "", 9), (2, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs).collect())
    assert got == [(-1, 3, 2, False), (1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False)]
    assert tokens.token_counts(docs.limit(0)).collect() == []
