import random

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import tokens


def test_long_blanks_are_cut_as_the_pattern_cuts_them():
    e, r = tokens.encoding(tokens.VOCABULARY), random.Random(1)
    for _ in range(300):
        t = "".join(r.choice(["a", "Ab ", "1", ".", " ", "  ", "\n", "\t \n  ", "\xa0\u2003 ", "é", "\x1c"]) * r.randint(1, 6) for _ in range(12))
        assert tokens.encode_length(e, t, 3) == tokens.encode_length(e, t, 2) == len(e.encode_ordinary(t))


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 1_000_000, "x" + "\n" * 300_000 + " y", "ab " * 300_000, "é" * 300_000, "." * 300_000])
def test_very_long_texts(text):
    assert 0 < tokens.count_tokens(text) <= len(text.encode())


def test_sizes(spark):
    docs = spark.createDataFrame([(1, "one two", "s", 5), (1, "one two", "s", 5), (2, "", None, 5), (3, None, "s", 5), (None, "x", "s", 5)], "doc_id long, text string, source string, tokens long")
    got = {(r.id, r.tokens, r.source, r.copies) for r in tokens.document_sizes(docs, "doc_id", "text", ["source"]).collect()}
    assert got == {(1, 2, "s", 2), (2, 0, None, 1), (None, 1, "s", 1)}
    assert docs.select(tokens.token_count(F.col("text")).alias("n")).where("n is null").count() == 1
