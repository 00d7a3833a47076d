"""Problem 6 against the tokenizer itself, and round trips."""

import random

import pytest

from strandloom.llm.tokens import decoded, encoding, token_counts, token_ids

SCHEMA = "doc_id long, text string, ids string, _id long"


def texts():
    draw = random.Random(3)
    alphabet = ["a", "b", " ", "  ", "\n", "\r\n", "'ll", "'s", "'", "1", "23", "é", "語", "🙂", "​", " ", ".", "-->", "<|endoftext|>", "word ", " the"]
    out = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(400))) for _ in range(60)]
    return [*out, None, "", " ", "\n" * 500, "a" * 3000, "ab " * 900, "'" * 700, "1" * 900, "x" * 100 + " " * 600 + "y" * 100]


@pytest.mark.parametrize(("chunk", "overlap"), [(16_384, 512), (100, 40), (50, 12), (64, 64)])
def test_chunks_give_the_ids_of_the_whole(spark, chunk, overlap):
    enc = encoding("byte_bpe_50k")
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())]
    found = {r.doc_id: r.ids for r in token_ids(spark.createDataFrame(rows, SCHEMA), chunk=chunk, overlap=overlap).collect()}
    assert found == {i: enc.encode_ordinary(t or "") for i, t, *_ in rows}


def test_counts_and_decoding(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA)
    ids = token_ids(df, chunk=200, overlap=50)
    counts = {r.doc_id: r.tokens for r in token_counts(df, chunk=200, overlap=50).collect()}
    assert counts == {r.doc_id: len(r.ids) for r in ids.collect()}
    assert {r.doc_id: r.text for r in decoded(ids).collect()} == {i: t or "" for i, t, *_ in rows}


def test_decoding_of_null_and_empty_lists(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decoded(df).collect()} == {1: None, 2: ""}


def test_empty_table(spark):
    assert token_ids(spark.createDataFrame([], SCHEMA)).count() == 0
