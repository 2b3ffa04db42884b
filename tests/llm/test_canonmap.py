import random
import unicodedata

import pytest

from glyphloom.functions.distance import damerau
from glyphloom.llm import canonmap as cm

REFS = [(1, "fopertitidi"), (2, "fesfoselo"), (3, "rirpacõntu"), (4, "pitupelul"), (5, "salrotirdiro"), (6, "pitumelol")]


def run(spark, values, refs=REFS, **kw):
    v = spark.createDataFrame([(x, "c", 1) for x in values], "value string, ref string, uses int")
    e = spark.createDataFrame([(i, w, "z") for i, w in refs], "word_id long, word string, value string")
    return {r.value: (r.ref_id, r.status, r.uses) for r in cm.map_values(v, "value", e, "word_id", "word", **kw).collect()}


def test_what_stands_for_an_entry(spark):
    got = run(spark, ["fesfoselo", "FES foselo", "fesf0sel0", "fesfoselooooooo", "fesfos.", "fesfo.", "fesfos", "fsefsoelo", "rirpacontu", "'Rirpacõ̃ntu!'", None, None, "", "§", "zzzzzzzzz", "salrotirdiroo"] + ["fesfoselo"] * 2)
    assert got["fesfoselo"] == (2, "exact", 3)
    for v, i in [("FES foselo", 2), ("fesf0sel0", 2), ("fesfoselooooooo", 2), ("fesfos.", 2), ("fsefsoelo", 2), ("rirpacontu", 3), ("'Rirpacõ̃ntu!'", 3), ("salrotirdiroo", 5)]:
        assert got[v][:2] == (i, "mapped"), v
    for v in ("fesfo.", "fesfos", "", "§", "zzzzzzzzz"):
        assert got[v][:2] == (None, "unmatched"), v
    assert None not in got


def test_ambiguous_and_margin(spark):
    assert run(spark, ["pitupelol"])["pitupelol"][1] == "ambiguous"  # one slip from two entries
    assert run(spark, ["pitupellul"])["pitupellul"][:2] == (4, "mapped")


def test_empty_tables(spark):
    assert run(spark, []) == {}
    assert run(spark, ["abc"], [])["abc"][1] == "unmatched"


def test_very_long_value(spark):
    long = "fesfosel" + "o" * 50_000
    assert run(spark, [long, "x" * 50_000]) == {long: (2, "mapped", 1), "x" * 50_000: (None, "unmatched", 1)}


@pytest.mark.parametrize("bound", [20_000, 7])
def test_recall_against_brute_force(spark, monkeypatch, bound):
    """Every entry within two slips is found, in one index and in blocks."""
    monkeypatch.setattr(cm, "MAX_INDEXED", bound)
    r = random.Random(6)
    syl = ["fo", "per", "ti", "sal", "rot", "mun", "le", "cu", "dan", "ri"]
    words = sorted({"".join(r.choice(syl) for _ in range(4)) for _ in range(40)})
    refs = list(enumerate(words))

    def slip(w):
        k, c = r.randrange(len(w)), r.choice("abcdefgh3")
        return r.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]])

    values = sorted({slip(slip(r.choice(words))) for _ in range(150)} - set(words))
    got = run(spark, values, refs)
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if c.isalnum())
    for v in values:
        near = sorted((damerau(fold(v), w, 2), i) for i, w in refs if damerau(fold(v), w, 2) <= 2)
        if near and (len(near) == 1 or near[0][0] < near[1][0]):
            assert got[v][:2] == (near[0][1], "mapped"), v
        elif near:
            assert got[v][1] == "ambiguous", v


@pytest.mark.parametrize("bound", [20_000, 0])
def test_values_that_share_nothing_with_the_list(spark, monkeypatch, bound):
    monkeypatch.setattr(cm, "MAX_INDEXED", bound)
    assert run(spark, ["qqq"], [(1, "abc"), (2, "zzzz")]) == {"qqq": (None, "unmatched", 1)}
    assert run(spark, ["qqqqqqqqq"])["qqqqqqqqq"][1] == "unmatched"
    assert run(spark, ["xby", "x"], [(1, "abc"), (2, "zzzzzz")]) == {"xby": (1, "mapped", 1), "x": (None, "unmatched", 1)}


def test_values_alone_in_their_chunk(monkeypatch):
    monkeypatch.setattr(cm, "CELLS", 3)
    index = cm.GramIndex([(i, w, w) for i, w in enumerate(["fesfoselo", "pitupelul", "rirpacontu"])])
    words = ["fesfosello", "qqq", "pitupelul", "rirpaccontu", "zzzz", "fesfosel"]
    assert [h[:2] for h in cm.look_up(index, words, words)] == [("fesfosello", 0), ("pitupelul", 1), ("rirpaccontu", 2), ("fesfosel", 0)]


def _slip(r, w):
    k, c = r.randrange(len(w) + 1), r.choice("abcdefgh3")
    return r.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]])


def test_recall_of_entries_of_all_lengths(spark, monkeypatch):
    """Entries of 1 to 12 letters against brute force; the joins give what the index gives."""
    r = random.Random(3)
    words = sorted({"".join(r.choice("abcdefgh") for _ in range(n)) for n in range(1, 13) for _ in range(6)})
    values = sorted({v for w in words for _ in range(4) if (v := _slip(r, _slip(r, w)))} | {w[: r.randrange(6, len(w))] + "." for w in words if len(w) > 7} | {w + w[-1] * 4 for w in words})
    refs = list(enumerate(words))
    v = spark.createDataFrame([(x,) for x in values], "value string")
    e = spark.createDataFrame(refs, "word_id long, word string")
    ask = lambda: sorted((h.value, h.ref_id or -1, h.slips or 0, round(h.cosine or 0, 9), h.status) for h in cm.map_values(v, "value", e, "word_id", "word").collect())
    got = ask()
    monkeypatch.setattr(cm, "MAX_INDEXED", 0)
    assert ask() == got
    index = cm.GramIndex([(i, w, w) for i, w in refs])
    folded = ["".join(c for c in x if c.isalnum()) for x in values]
    found = {(h[0], h[1]) for h in cm.look_up(index, values, folded)}
    truth = {(x, i) for x, f in zip(values, folded) for i, w in refs if cm.exact_slips(x, f, w, 2, 6) is not None}
    assert found == truth  # whatever the length: recall 1
