import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphloom.functions import chars, distance, locale
from glyphloom.functions.folding import compose_accents, fold_word


def col(spark, values, fn):
    """fn applied to each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_delimiters(spark):
    assert len(chars.WHITESPACE + chars.PUNCTUATION) == len(set(chars.WHITESPACE + chars.PUNCTUATION)) == 34
    every = [chr(c) for c in range(1, 128)] + list("é…«» ")
    got = col(spark, every, chars.is_delimiter)
    assert [c for c, d in zip(every, got) if d] == [c for c in every if c in chars.WHITESPACE + chars.PUNCTUATION]
    assert col(spark, [" ", "\n", "\r", "\t", ",", "'", "-", "a"], chars.classify_delimiter) == ["Space", "Enter", "Enter", "Tab", "Punctuation", None, None, None]


def test_word_characters(spark):
    assert col(spark, list("aé9'-_.😀…"), chars.is_word_char) == [True] * 5 + [False] * 4


def test_accent_codec(spark):
    assert col(spark, ["niño", "über", "schön", ""], chars.encode_accents) == ["niNo", "Wber", "schön", ""]
    assert col(spark, ["niNo", "I"], chars.decode_accents) == ["niño", "í"]
    assert col(spark, ["también", "maçã", "è"], chars.strip_accents) == ["tambien", "maca", "è"]


@pytest.mark.parametrize("o, c, out", [("Teh", "the", "The"), ("TEH", "THE", "The"), ("teh", "The", "the"), ("éa", "ÉB", "éb"), ("Éa", "éb", "Éb"), ("", "A", "a"), ("1A", "BC", "bc")])
def test_preserve_case(spark, o, c, out):
    assert spark.createDataFrame([(o, c)], "o string, c string").select(chars.preserve_case(F.col("o"), F.col("c"))).first()[0] == out


def test_titlecase_upper_and_edges(spark):
    assert col(spark, ["wORLD x", "éa", ""], chars.titlecase) == ["WORLD x", "Éa", ""]
    assert col(spark, ["AB", "É", "A1", "A-B", "", "Ab"], chars.is_all_upper) == [True, True, False, False, False, False]
    assert [tuple(x) for x in col(spark, ["-teh-", "'a-b''", "--'", "x", ""], chars.edge_parts)] == [("-", "teh", "-"), ("'", "a-b", "''"), ("--'", "", ""), ("", "x", ""), ("", "", "")]


def test_long_inner_runs_take_linear_time(spark):
    from glyphloom.operators.orphans import fold_key

    blanks, hyphens = "A" + " " * 300_000 + "b  ", "-a" + "-" * 300_000 + "b'"
    assert col(spark, [blanks, None], fold_key) == [blanks.lower().strip(), None]
    assert [tuple(x) for x in col(spark, [hyphens], chars.edge_parts)] == [("-", hyphens[1:-1], "'")]


def buffer_of(text, limit=64):
    held = ""
    for c in text:
        held = held + c if len(held) < limit else held[1:]
    return held


def test_bounded_token_is_what_the_buffer_holds(spark):
    words = ["".join(chr(97 + (i * 7) % 26) for i in range(n)) for n in [0, 1, 63, 64, 65, 66, 67, 100, 127, 128, 129, 130, 300]] + ["é" * 70, "😀a" * 50]
    assert col(spark, words, chars.bounded_token) == [buffer_of(w) for w in words]
    assert col(spark, words, lambda c: chars.bounded_token(c, 7)) == [buffer_of(w, 7) for w in words]


@pytest.mark.parametrize(
    "a, b, limit, out",
    [
        ("hello", "hello", 2, 0), ("qeu", "que", 1, 1), ("hte", "the", 1, 1), ("hola", "holaa", 1, 1), ("", "a", 1, 1), ("cat", "dog", 2, 3), ("hello", "helo", 2, 1),
        ("abc", "xyz", 1, 2), ("abc", "", 2, 3), ("naïve", "naive", 1, 1), ("日本語", "日本", 1, 1), ("Hello", "hello", 1, 1), ("caab", "abca", 2, 3), ("don't", "dont", 1, 1), ("ca", "abc", 3, 2),
    ],
)
def test_damerau(a, b, limit, out):
    assert distance.damerau(a, b, limit) == distance.damerau(b, a, limit) == out


@pytest.mark.parametrize(
    "a, b, out, shared",
    [("teh", "the", 10, True), ("tge", "the", 5, True), ("rge", "the", 10, False), ("hellp", "hello", 5, True), ("helo", "hello", 10, True), ("jello", "hello", 5, True), ("tambien", "también", 10, True), ("qwe", "wer", 15, True), ("sos", "osd", 15, True), ("ca", "abc", 20, True)],
)
def test_keyboard_distance_and_overlap(a, b, out, shared):
    assert distance.keyboard_distance(a, b, 2) == out
    assert distance.overlap_ok(a, b) is shared


def test_adjacency_is_symmetric_and_complete():
    assert len(distance._NEAR) == 55
    assert distance.key_cost("q", "W") == distance.key_cost("w", "q") == 5
    assert distance.key_cost("A", "a") == 10 and distance.key_cost("a", "a") == 0


word = st.text(alphabet="abcdeé'", max_size=9)


@settings(max_examples=1500, deadline=None)
@given(word, word)
def test_distance_properties(a, b):
    d = distance.damerau(a, b, 20)
    assert d == distance.damerau(b, a, 20)
    assert (d == 0) == (a == b)
    assert distance.keyboard_distance(a, b, 20) <= 10 * d
    assert [distance.damerau(a, b, k) for k in (0, 1, 2)] == [min(d, k + 1) for k in (0, 1, 2)]
    assert d == distance._table(a, b, 1, lambda x, y: int(x != y))  # nothing is lost by cutting common ends


def test_small_limits_exhaustively():
    """All pairs of words up to four letters of a small alphabet, against the full table."""
    from itertools import product

    words = ["".join(w) for n in range(5) for w in product("abc", repeat=n)]
    r = random.Random(2)
    for a in words:
        for b in r.sample(words, 60):
            d = distance._table(a, b, 1, lambda x, y: int(x != y))
            assert [distance.damerau(a, b, k) for k in (0, 1, 2, 3)] == [min(d, k + 1) for k in (0, 1, 2, 3)], (a, b)


def test_columns_equal_scalars(spark):
    r = random.Random(1)
    pairs = [("".join(r.choice("abcqw") for _ in range(r.randint(0, 6))), "".join(r.choice("abcqw") for _ in range(r.randint(0, 6)))) for _ in range(150)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    rows = df.select(distance.damerau_col(F.col("a"), F.col("b"), 2), distance.keyboard_distance_col(F.col("a"), F.col("b"), 2), distance.overlap_ok_col(F.col("a"), F.col("b"))).collect()
    assert [tuple(x) for x in rows] == [(distance.damerau(a, b, 2), distance.keyboard_distance(a, b, 2), distance.overlap_ok(a, b)) for a, b in pairs]


def test_sql_functions(spark):
    distance.register_sql(spark)
    r = spark.sql("select damerau_distance('teh','the',2) a, keyboard_distance('tge','the',2) b, char_overlap_ok('rge','the') c, damerau_distance(null,'a',1) d").first()
    assert tuple(r) == (1, 5, False, None)


def test_compose_accents(spark):
    import unicodedata

    words = ["cafe\u0301", "ni\u006e\u0303o", "plain", "", None, "a\u0323\u0302", "\u0301x", "s\u030co\u0308"]
    assert col(spark, words, compose_accents) == [w if w is None else unicodedata.normalize("NFC", w) for w in words]


def test_fold_word(spark):
    assert col(spark, ["É-ñ ỗ3", "ẹ́", "", None], fold_word) == ["eno3", "e", "", None]


@pytest.mark.parametrize("tag, out", [("en", "en"), ("es-MX", "es"), ("pt_BR", "pt"), ("zh-Hans-CN", "zh"), ("", "en"), ("-x", "en"), ("EN", "en"), (None, None)])
def test_base_language(spark, tag, out):
    assert col(spark, [tag], locale.base_language) == [out]


@pytest.mark.parametrize("pref, tag, sup, out", [("es", "en-US", ["en", "es"], ("es", "UserPreference")), (None, "es-ES", ["en", "es"], ("es", "SystemLocale")), (None, "de-DE", ["en"], ("en", "DefaultFallback")), ("zz", None, ["en"], ("en", "DefaultFallback")), ("zz", "es_ES", ["en", "es"], ("es", "SystemLocale"))])
def test_resolve_language(spark, pref, tag, sup, out):
    df = spark.createDataFrame([(pref, tag, sup, "en")], "p string, t string, s array<string>, d string")
    assert tuple(df.select(locale.resolve_language(F.col("p"), F.col("t"), F.col("s"), F.col("d")).alias("r")).first().r) == out
