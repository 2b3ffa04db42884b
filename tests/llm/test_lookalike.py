import random
import unicodedata
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import lookalike as la

COUNTS = dict.fromkeys("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZéúíãõ -", 1000) | dict.fromkeys("ⅼｒｂｅɡеաоοօ​⁠  ­᠎́́ﬁⅳ‐．", 3)


@pytest.mark.parametrize(
    "text, form",
    [
        ("ｂrｅ", "bre"), ("gⅼеոn", "glenn"), ("⁠gre​n­ ", "gren"), ("ééé", "ééé"), ("a b", "a b"), (" a   b ", "a b"),
        ("ﬁn", "fin"), ("ⅳ", "iv"), ("x‐y", "x-y"), ("", ""), (" ​ ", ""), ("Ab", "Ab"), ("é", "é"), ("e", "e"), ("о​́", "ó"), (None, None),
    ],
)
def test_rewriting(text, form):
    assert la.Rewriter(la.representatives(COUNTS))(text) == form


def test_representative_is_the_most_frequent_member():
    greek = la.representatives({"ο": 50, "o": 2, "о": 3})
    assert greek["o"] == greek["о"] == "ο" and "ο" not in greek


def test_classes_are_transitive():
    assert {frozenset(c) for c in la.classes([("a", "b"), ("c", "b"), ("x", "y"), ("c", "d")])} == {frozenset("abcd"), frozenset("xy")}


def test_rewriting_is_idempotent_and_handles_long_text():
    r = random.Random(1)
    rewrite = la.Rewriter(la.representatives(COUNTS))
    for _ in range(200):
        t = "".join(r.choice(list(COUNTS)) for _ in range(30))
        assert rewrite(rewrite(t)) == rewrite(t)
    long = "ｂ​e" * 100_000
    assert rewrite(long) == "be" * 100_000


def test_case_and_accents_are_kept_apart():
    rewrite = la.Rewriter(la.representatives(COUNTS))
    forms = [rewrite(x) for x in ("a", "A", "á", "ã", "Á")]
    assert len(set(forms)) == 5 and all(unicodedata.is_normalized("NFC", f) for f in forms)


def test_pairs_against_brute_force(spark):
    rows = [(1, "en", "grel", "x"), (2, "en", "gre​l", "x"), (3, "en", "gre​l", "x"), (4, "en", "ɡrel", None), (5, "es", "grel", "x"), (6, "es", "grél", "x"), (7, "en", None, "x"), (8, "en", " ", "x"), (9, "en", "​", "x"), (10, "en", "Grel", "x")]
    rows += rows[:1]
    df = spark.createDataFrame(rows, "id long, lang string, word string, key string")
    counts = la.character_counts(df, "word")
    assert counts["g"] == 6
    form = la.unifier(counts)
    f = df.withColumn("f", form("word")).where("f <> ''")
    got = sorted((r.lang, r.id_a, r.id_b) for r in la.look_alike_pairs(f, "id", ["lang"], "f", "word").collect())
    forms = {r.id: (r.lang, r.f, r.word) for r in f.collect()}
    want = sorted((forms[a][0], a, b) for a, b in combinations(sorted(forms), 2) if forms[a][:2] == forms[b][:2] and forms[a][2] != forms[b][2])
    assert got == want == [("en", 1, 2), ("en", 1, 3), ("en", 1, 4), ("en", 2, 4), ("en", 3, 4)]


def test_empty(spark):
    df = spark.createDataFrame([], "id long, lang string, word string")
    assert la.character_counts(df, "word") == {}
    assert la.look_alike_pairs(df.withColumn("f", la.unifier({})(F.col("word"))), "id", ["lang"], "f", "word").count() == 0


def test_confusables_table(tmp_path):
    f = tmp_path / "table.txt"
    f.write_text("﻿# comment\n0430 ;\t0061 ;\tMA\t# a\n0031 ; 006C ; MA\nA732 ; 0041 0041 ; MA # two\n\n", encoding="utf-8")
    table = la.read_confusables(str(f))
    assert table == [("а", "a"), ("Ꜳ", "AA")]
    assert ("1", "l") in la.read_confusables(str(f), latin_only=False)
    rewrite = la.Rewriter(la.representatives({"A": 5, "a": 9, "а": 1, "Ꜳ": 1}, table))
    assert rewrite("ПаꜲ") == "ПaAA" and rewrite("о") == "о"


def test_classes(spark):
    rows = [(1, "en", "k", "x"), (2, "en", "k", "y"), (3, "en", "k", "x"), (3, "en", "k", "x"), (4, "en", "only", "z"), (5, "en", "only", "z"), (6, "es", "k", "x"), (7, "en", None, "x"), (8, None, "k", "x"), (9, None, "k", "y")]
    df = spark.createDataFrame(rows, "id long, lang string, key string, raw string").withColumn("k1", F.lit("clash"))
    got = la.look_alike_classes(df, "id", ["lang"], "key", "raw").collect()
    assert sorted((r.id, r.class_id, r.texts, r.members) for r in got) == [(1, 1, 2, 3), (2, 1, 2, 3), (3, 1, 2, 3)]
    assert la.look_alike_classes(df.where("false"), "id", ["lang"], "key", "raw").collect() == []
