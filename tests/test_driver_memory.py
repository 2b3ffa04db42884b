"""Queries over the dictionary broadcast no table that grows, and do not move tokens to look words up."""

import re
from functools import partial

import pytest

from glyphloom import core_queries
from glyphloom.operators import correct, detect
from glyphloom.plans import pipeline
from glyphloom.skew import attach_known

QUERIES = ["correct_text", "pipeline_json", "fuzzy_topk", "edit_script", "suggestions", "web_results", "pipeline_events", "pipeline_results"]


@pytest.mark.parametrize("name", QUERIES)
def test_only_bounded_tables_are_broadcast(spark, sf, monkeypatch, name):
    plans = []
    for m in (correct, detect, pipeline):
        monkeypatch.setattr(m, "cut_lineage", lambda df, cut=m.cut_lineage: plans.append(df) or cut(df))
    plans.append(core_queries.QUERIES[name](spark, sf))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10 << 20  # these tables are far below it
    for text in (df._jdf.queryExecution().executedPlan().toString() for df in plans):
        for join in re.findall(r"Broadcast\w+Join.*", text):
            # attach_known, attach_by_key; of typed tokens also the few beyond the bound, whose size Spark estimates
            assert re.search(r"\[_[hl]?k_" if name == "edit_script" else r"\[_h?k_", join.replace(" ", "[")), join
        if name != "edit_script":
            assert "_salt" not in text


@pytest.mark.parametrize("small", [0, 100])
def test_attach_known_is_a_left_join(spark, small):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a"), (5, "z")], "id long, k string")
    groups = spark.createDataFrame([("a", 2, 10), ("b", 1, None), ("c", 1, 12)], "k string, n long, v int")
    out = attach_known(rows, groups, ["k"], ["v"], "n", ["id"], small)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 10), (2, "b", None), (3, None, None), (4, "a", 10), (5, "z", None)]


def test_texts_of_one_id_are_put_together(spark):
    from glyphloom.sources.resources import demo_resources

    docs = spark.createDataFrame([(1, "wrold wrold."), (2, ""), (3, None), (None, "Wrold!"), (4, "hello"), (4, " ")], "doc_id long, text string")
    out = correct.correct_text(docs, demo_resources(spark), "en", "doc_id", "text").collect()
    assert len(out) == 4 and {r.doc_id: r.corrected_text for r in out} == {1: "world world.", 2: "", None: "World!", 4: " hello"}


#: Queries that attach words to tokens.
BEYOND = ["web_results", "pipeline_results", "pipeline_events"]


@pytest.mark.parametrize("name", BEYOND)
def test_words_beyond_the_bound_are_merged(spark, sf, monkeypatch, name):
    plans = []
    for m in (correct, detect, pipeline):
        monkeypatch.setattr(m, "cut_lineage", lambda df, cut=m.cut_lineage: plans.append(df) or cut(df))
        monkeypatch.setattr(m, "attach_known", partial(attach_known, small=0))
    plans.append(core_queries.QUERIES[name](spark, sf))
    joins = re.findall(r"\w+Join .*", "".join(df._jdf.queryExecution().executedPlan().toString() for df in plans).replace(" [", " "))
    assert [x for x in joins if re.match(r"SortMergeJoin.* _lk_", x)]
    assert not [x for x in joins if re.match(r"Broadcast.* _lk_", x)]
