"""The fuzzy search's keys, many for every word, are never broadcast, however small the tables are said to be."""

import random
import re

import pytest

from glyphloom import core_queries
from glyphloom.functions.distance import ADJACENT_KEYS, keyboard_distance, overlap_ok
from glyphloom.operators import correct, similarity
from glyphloom.plans import keystrokes, pipeline

QUERIES = [
    "fuzzy_candidates", "correct_text", "correct_words", "pipeline_json", "fuzzy_topk", "edit_script", "suggestions", "web_results", "pipeline_results", "pipeline_events",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def key_joins(text):
    """(join, its keys) of the joins on keys of the fuzzy search."""
    return re.findall(r"(\w+Join) \[(?:[^\[\]]*, )?((?:v|m)#\d+L?)", text)


@pytest.mark.parametrize("name", QUERIES)
def test_keys_are_merged_not_broadcast(spark, sf, monkeypatch, name):
    found = []
    for search in (similarity.candidates, similarity.close_pairs):
        monkeypatch.setattr(similarity, search.__name__, lambda *args, search=search: found.append(search(*args)) or found[-1])
    for m in (correct, keystrokes, pipeline):
        monkeypatch.setattr(m, "cut_lineage", lambda df: df)  # the plan is looked at, not run
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10 << 20  # these tables are far below it
    core_queries.QUERIES[name](spark, sf)
    assert found
    for df in found:
        joins = [j for j, _ in key_joins(plan(df))]
        assert joins and set(joins) == {"SortMergeJoin"}


def test_keys_of_far_words_are_merged_too(spark):
    words = spark.sql("select * from values ('en', 'wrold'), ('en', 'sea') as t(lang, word_q)")
    dictionary = spark.sql("select * from values ('en', 'world'), ('es', 'sea') as t(lang, word_enc)")
    df = similarity.candidates(words, dictionary, 3)
    assert {j for j, _ in key_joins(plan(df))} == {"SortMergeJoin"}
    assert [tuple(r) for r in df.collect()] == [("en", "wrold", "world")]


def test_neighbouring_keys_share_a_group(spark):
    pairs = spark.createDataFrame([tuple(p) for p in (ADJACENT_KEYS + ADJACENT_KEYS.upper()).split()], "a string, b string")
    same = [similarity._grouped(pairs.a, s) == similarity._grouped(pairs.b, s) for s in (0, 1)]
    assert pairs.where(~(same[0] | same[1])).count() == 0


def test_one_edit_against_brute_force(spark):
    r, near = random.Random(7), [tuple(p) for p in ADJACENT_KEYS.split()]
    near = {x: [b for a, b in near if a == x] + [a for a, b in near if b == x] for x in "qwertyuiopasdfghjklzxcvbnm"}
    known = sorted({"".join(r.choice("qwertyuiopasdfghjklzxcvbnmé") for _ in range(r.choice([1, 2, 2, 3, 3, 4, 5, 6, 8, 9, 13, 16, 17, 33, 40]))) for _ in range(150)})
    asked = set(known[:10])
    for w in known:
        for _ in range(6):
            x = list(w)
            for i in r.sample(range(len(x)), min(2, len(x))):  # two neighbouring keys
                x[i] = r.choice(near.get(x[i], [x[i]]))
            asked.add("".join(x))
            i = r.randrange(len(w))
            asked |= {w[:i] + w[i + 1 :], w[:i] + "k" + w[i:], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]}
    asked -= {""}
    d = spark.createDataFrame([("en", w, w.replace("é", "E"), 5) for w in known], "lang string, word string, word_enc string, freq long")
    got = similarity.find_similar(spark.createDataFrame([("en", w) for w in asked], "lang string, word string"), d, 1, 0).collect()
    want = {(a, b, n) for a in asked for b in known if abs(len(a) - len(b)) < 2 and overlap_ok(a, b) and (n := keyboard_distance(a, b, 1)) <= 10}
    assert len(got) == len({(x.word, x.candidate) for x in got}) and {(x.word, x.candidate, x.distance) for x in got} == want
    assert len([1 for *_, n in want if n == 10]) > 300
