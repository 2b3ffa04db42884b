import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from glyphloom.operators.orphans import fold_key, orphan_keys, orphan_references, orphan_report
from glyphloom.skew import attach_by_key

C = "cid long, key string, at timestamp, child_id string, status int"
P = "key string, start timestamp, end timestamp, n int"


def day(k):
    return None if k is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=k)


def run(spark, children, parents):
    c = spark.createDataFrame([(i, k, day(a), "x", 1) for i, k, a in children], C)
    p = spark.createDataFrame([(k, day(s), day(e), 1) for k, s, e in parents], P)
    return orphan_references(c, p, "cid", fold_key(F.col("key")), "at", fold_key(F.col("key")), "start", "end")


def brute(children, parents):
    out = set()
    fold = lambda k: k.strip().lower()
    for i, k, a in children:
        if k is None:
            continue
        v = [(s, e) for pk, s, e in parents if pk is not None and fold(pk) == fold(k)]
        if not v:
            out.add((i, "missing"))
        elif a is not None:
            live = any(s is not None and s <= a and (e is None or e > a) for s, e in v)
            came = any(s is not None and s <= a for s, e in v)
            if not live:
                out.add((i, "deleted" if came else "later"))
    return out


def test_statuses_and_times(spark):
    children = [(1, "A ", 5), (2, "b", 5), (3, "c", 5), (4, None, 5), (5, "d", None), (6, "zz", None), (7, "", 5), (8, "c", 10), (9, "c", 20)]
    parents = [("a", 0, None), ("b", 6, None), ("c", 0, 5), ("c", 10, 20), ("d", 9, None), (None, 0, None), ("a", 0, None)]
    got = {(r.child_id, r.status) for r in run(spark, children, parents).collect()}
    assert got == brute(children, parents) == {(2, "later"), (3, "deleted"), (6, "missing"), (7, "missing"), (9, "deleted")}


def test_random_histories_against_brute_force(spark):
    r = random.Random(5)
    keys = ["hot"] * 6 + list("abcdefgh")
    children = [(i, r.choice([*keys, None, "none"]), r.choice([None, *range(0, 400, 7)])) for i in range(400)]
    parents = []
    for _ in range(120):
        s = r.choice([None, *range(0, 400, 7)])
        parents.append((r.choice([*keys[5:], None]), s, None if s is None or r.random() < 0.3 else s + r.choice([0, -7, 7, 70, 140])))
    rows = run(spark, children, parents).collect()
    assert len(rows) == len({x.child_id for x in rows})
    assert {(x.child_id, x.status) for x in rows} == brute(children, parents)


def test_empty_tables(spark):
    assert run(spark, [], [("a", 0, None)]).count() == 0
    assert {(r.child_id, r.status) for r in run(spark, [(1, "a", 1)], []).collect()} == {(1, "missing")}


def test_repeated_rows_and_report(spark):
    children = [(1, "x", 5), (1, "x", 5), (2, "x", 40), (3, "y", None)]
    o = run(spark, children, [("q", 0, None)])
    assert o.count() == 4
    rep = {(r.period and r.period.month, r.status): (r.references, r["keys"]) for r in orphan_report(o, "t").collect()}
    assert rep == {(1, "missing"): (2, 1), (2, "missing"): (1, 1), (None, "missing"): (1, 1)}


def test_orphan_keys_are_distinct(spark):
    c = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    p = spark.createDataFrame([("b",), (None,)], "k string")
    assert [r.key for r in orphan_keys(c, p, "k", "k").collect()] == ["a"]


@pytest.mark.parametrize("heavy", [1, 3, 1000])
def test_attach_by_key_is_a_left_join(spark, heavy):
    r = random.Random(1)
    rows = [(i, r.choice(["h", "h", "h", "a", "b", "c", None, "u"])) for i in range(300)]
    groups = [("h", 150, 10), ("a", 40, 20), ("b", 40, None), ("c", 40, 30)]
    out = attach_by_key(spark.createDataFrame(rows, "id long, k string"), spark.createDataFrame(groups, "k string, n long, v int"), ["k"], ["v"], "n", ["id"], heavy)
    want = {k: v for k, _, v in groups}
    assert sorted((x.id, x.k, x.v) for x in out.collect()) == sorted((i, k, want.get(k)) for i, k in rows)


def test_a_hot_key_within_one_hour_is_spread(spark):
    """Thousands of questions of one key within an hour fall into several pieces; the answers stay right."""
    import datetime as dt
    import random

    r = random.Random(4)
    t0 = dt.datetime(2024, 5, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    spans = sorted(r.sample(range(3600), 20))
    versions = [("hot", at(a), at(b)) for a, b in zip(spans[::2], spans[1::2])] + [("cold", at(100), None)]
    asks = [(i, "hot", at(r.randrange(3600))) for i in range(4000)] + [(5000, "cold", at(50)), (5001, "cold", at(150)), (5002, "none", at(1)), (5003, "none", None), (5004, "hot", None), (5005, None, at(1))]
    children = spark.createDataFrame(asks, "id long, k string, at timestamp")
    parents = spark.createDataFrame(versions, "k string, s timestamp, e timestamp")
    got = {x.child_id: x.status for x in orphan_references(children, parents, "id", F.col("k"), "at", F.col("k"), "s", "e").collect()}
    want = {5000: "later", 5002: "missing", 5003: "missing"}
    for i, k, t in asks[:4000]:
        if not any(a <= t < b for _, a, b in versions[:-1]):
            want[i] = "deleted" if any(a <= t for _, a, _ in versions[:-1]) else "later"
    assert got == want
