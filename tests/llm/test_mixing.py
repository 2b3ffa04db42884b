import random

from glyphloom.llm import mixing


def test_water_fill():
    f = mixing.water_fill
    assert f({"a": 0.5, "b": 0.5}, {"a": 10, "b": 100}, 40) == {"a": 10.0, "b": 30.0}
    assert f({"a": 0.2, "b": 0.8}, {"a": 100, "b": 100}, 50) == {"a": 10.0, "b": 40.0}
    assert f({"a": 0.5, "b": 0.5}, {"a": 5, "b": 6}, 40) == {"a": 5.0, "b": 6.0}
    assert f({"a": 1.0, "b": 0.0}, {"a": 5, "b": 6}, 4) == {"a": 4.0, "b": 0.0}
    three = f({"a": 0.4, "b": 0.3, "c": 0.3}, {"a": 10, "b": 30, "c": 1000}, 100)
    assert three["a"] == 10 and three["b"] == 30 and abs(three["c"] - 60) < 1e-9


def run(spark, rows, targets, **kw):
    df = spark.createDataFrame([(i, s, t, 1) for i, s, t in rows], "id long, source string, tokens long, repeats int")
    chosen, shares = mixing.mix(df, targets, **kw)
    return chosen.collect(), {r.source: r for r in shares.collect()}


def corpus(seed=1):
    r = random.Random(seed)
    return [(i, r.choice(["big"] * 7 + ["mid"] * 2 + ["small", None, "other"]), r.randint(1, 200)) for i in range(3000)]


def test_shares_and_limits(spark):
    rows = corpus()
    targets = [("big", 0.3, 1), ("mid", 0.4, 2), ("small", 0.3, 4), ("absent", 0.1, 3), ("none", None, 3)]
    chosen, shares = run(spark, rows, targets)
    size = {s: sum(t for _, x, t in rows if x == s) for s in ("big", "mid", "small")}
    total = sum(size.values())
    w = {"big": 0.3 / 1.1, "mid": 0.4 / 1.1, "small": 0.3 / 1.1, "absent": 0.1 / 1.1, "none": 0.0}
    want = mixing.water_fill(w, {"big": size["big"], "mid": 2 * size["mid"], "small": 4 * size["small"], "absent": 0, "none": 0}, total)
    for s, m in (("big", 1), ("mid", 2), ("small", 4)):
        mine = [x for x in chosen if x.source == s]
        assert max(x.repeats for x in mine) <= m
        assert len({x.id for x in mine}) == len(mine)
        got = sum(x.repeats * x.tokens for x in mine)
        assert abs(got - want[s]) <= 200
        assert shares[s].mixed_tokens == got
    assert shares["absent"].mixed_tokens == 0 and shares["absent"].actual_share == 0
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    assert {x.source for x in chosen} == {"big", "mid", "small"}


def test_seeded_and_independent_of_row_order(spark):
    rows = corpus(2)
    t = [("big", 0.5, 1), ("small", 0.5, 3)]
    key = lambda got: sorted((x.id, x.repeats) for x in got[0])
    assert key(run(spark, rows, t)) == key(run(spark, rows[::-1] + rows[:50], t))
    assert key(run(spark, rows, t)) != key(run(spark, rows, t, seed=99))


def test_empty_and_all_clamped(spark):
    chosen, shares = run(spark, [], [("a", 1.0, 2)])
    assert chosen == [] and shares["a"].actual_share == 0
    chosen, shares = run(spark, [(1, "a", 10), (2, "a", 0)], [("a", 1.0, 2)], total=1000)
    assert sum(x.tokens * x.repeats for x in chosen) == 20
