import json
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphloom.llm import formatdup as fd

SCHEMA = "raw_id long, lang string, payload string, id string, h1 string"


def records(spark, rows):
    return fd.canonical_records(spark.createDataFrame([(i, l, p, "x", "y") for i, l, p in rows], SCHEMA), "raw_id", "payload", "lang")


def pairs(spark, rows):
    return {(r.first_id, r.copy_id) for r in fd.copies_of_first(records(spark, rows)).collect()}


def test_formats_of_one_record(spark):
    same = [
        '{"word": "gril", "frequency": 1234}',
        '{ "Frequency ":"1.234." ,\n " WORD":"  GRIL\\n"}',
        "frequency=1 234; word=gr-il",
        "word: «Gril!» | frequency: 1'234",
        "Frequency = 1234\nWord = gr il",
        '{"word":"\\"g\\tril\\"","frequency":"001234"}',
        '{"word": "gril", "frequency": 1234, "word": "other"}',
    ]
    other = ['{"word": "grîl", "frequency": 1234}', '{"word": "gril", "frequency": 1235}', '{"word": "gril"}', '{"word": "...", "frequency": 1}', '{"wo', "", "word=", None, '{"word": null, "frequency": 1234}', '{"word":"gril","frequency":"12x34"}']
    rows = [(i, "en", p) for i, p in enumerate(same + other)] + [(100, "es", same[0]), (101, None, same[0]), (102, None, same[2])]
    assert pairs(spark, rows) == {(0, i) for i in range(1, 7)} | {(101, 102)}


def test_accents_composed_or_not(spark):
    rows = [(1, "es", '{"word":"níl","frequency":1}'), (2, "es", "word=ni\u0301l; frequency=1"), (3, "es", '{"word":"NI\u0301L","frequency":1}'), (4, "es", '{"word":"nil","frequency":1}')]
    assert pairs(spark, rows) == {(1, 2), (1, 3)}


def test_marks_inside_loose_values(spark):
    assert pairs(spark, [(1, "en", "word=a;b; frequency=3"), (2, "en", '{"word":"ab","frequency":3}'), (3, "en", "frequency=3;word=a;b:")]) == {(1, 2), (1, 3)}


def test_empty_null_long_and_repeated(spark):
    assert pairs(spark, []) == set()
    long = "x" * 200_000
    rows = [(1, "en", json.dumps({"word": long, "frequency": 1})), (2, "en", json.dumps({"frequency": "1", "word": long.upper()})), (None, "en", json.dumps({"word": long, "frequency": 1}))]
    assert pairs(spark, rows) == {(1, 2)}


def test_long_runs_in_loose_notation(spark):
    rows = [(1, "en", "word=a" + " \n" * 200_000 + "b; frequency=3"), (2, "en", "\n" * 200_000), (3, "en", "frequency=3" + " " * 200_000 + ";word=ab"), (4, "en", ";" * 200_000), (5, "en", '{"word":"a b","frequency":3}')]
    assert pairs(spark, rows) == {(1, 3), (1, 5)}


def test_hot_record_keeps_every_copy(spark):
    rows = [(i, "en", f'{{"word": "hot{"!" * (i % 3)}", "frequency": 1}}') for i in range(600)] + [(1000 + i, "en", f"word=w{i // 2}; frequency=2") for i in range(100)]
    got = pairs(spark, rows)
    assert got == {(0, i) for i in range(1, 600)} | {(1000 + i, 1001 + i) for i in range(0, 100, 2)}


def test_collisions_stay_apart(spark):
    r = spark.createDataFrame([(1, 7, 7, 1), (2, 7, 7, 2), (3, 7, 7, 1)], "id long, h1 long, h2 long, h3 long")
    assert {tuple(x) for x in fd.copies_of_first(r).collect()} == {(1, 3)}
    assert [x.forms for x in fd.collisions(fd.count_copies(r)).collect()] == [2]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abé -.,;'\" \tAB", min_size=0, max_size=8), st.integers(0, 3)), max_size=25))
def test_against_brute_force(spark, items):
    import unicodedata

    rows = [(i, "en", json.dumps({"word": w, "frequency": n}, ensure_ascii=False)) for i, (w, n) in enumerate(items)]
    groups = defaultdict(list)
    for i, (w, n) in enumerate(items):
        key = "".join(c for c in w.lower() if not unicodedata.category(c).startswith("P") and not c.isspace())
        if key:
            groups[key, n].append(i)
    want = {(g[0], i) for g in groups.values() for i in g[1:]}
    assert pairs(spark, rows) == want


def test_canonical_whole(spark):
    df = spark.createDataFrame([("007",), ("-5",), ("1,2 3",), ("x",), ("",), (None,), ("0",)], "s string")
    assert [r[0] for r in df.select(fd.canonical_whole(F.col("s"))).collect()] == ["7", "5", "123", None, None, None, "0"]


@pytest.mark.parametrize("word", ["й", "ά", "가", "ệ", "İ", "か\u3099", "क\u093c"])
def test_copies_in_both_normal_forms(spark, word):
    import unicodedata

    forms = [unicodedata.normalize(f, f"x{word}y") for f in ("NFC", "NFD")] + [f"x{word}y"]
    assert pairs(spark, [(i, "en", json.dumps({"word": w, "frequency": 3}, ensure_ascii=False)) for i, w in enumerate(forms)]) == {(0, 1), (0, 2)}


def test_collision_report(spark):
    r = spark.createDataFrame([(1, 7, 7, "a"), (2, 7, 7, "b"), (3, 8, 7, "c"), (4, 8, 7, "c")], "id long, h1 long, h2 long, canonical string")
    assert tuple(fd.collision_report(r).first()) == (4, 2, 1)
    assert tuple(fd.collision_report(r.where("false")).first()) == (0, 0, 0)
