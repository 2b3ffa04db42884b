import random

from glyphloom.llm import packing


def plain_ffd(sizes, cap):
    free, out = [], []
    for s in sizes:
        for k, f in enumerate(free):
            if f >= s:
                break
        else:
            k = len(free)
            free.append(cap)
        free[k] -= s
        out.append(k)
    return out


def test_tree_equals_plain_first_fit():
    r = random.Random(1)
    for _ in range(200):
        cap = r.randint(1, 50)
        sizes = sorted((r.randint(0, cap) for _ in range(r.randint(0, 60))), reverse=True)
        assert packing.first_fit_decreasing(sizes, cap) == plain_ffd(sizes, cap)


def run(spark, rows, caps, **kw):
    df = spark.createDataFrame([(i, t, c, "x") for i, t, c in rows], "id long, tokens long, copies long, container string")
    return packing.pack(df, caps, **kw).collect()


def test_nothing_is_lost_split_or_overfull(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0, 1, 5, 60, 99, 100, 101, 250, 1000, None]), 1) for i in range(300)] + [(None, 30, 40), (7, 50, 3)]
    got = run(spark, rows, [(1, 100), (2, 400), (3, None), (4, 0)], group_items=50)
    assert {x.pack_id for x in got} == {1, 2}
    for p, cap in ((1, 100), (2, 400)):
        mine = [x for x in got if x.pack_id == p]
        parts, bins = {}, {}
        for x in mine:
            parts.setdefault((x.id, x.copy), {}).setdefault(x.piece, (x.first_token, x.tokens))
            bins.setdefault(x.container, []).append((x.start, x.tokens))
        assert sum(x.tokens for x in mine) == sum(t * c for _, t, c in rows if t)
        for b in bins.values():
            end = 0
            for s, t in sorted(b):
                assert s == end or t == 0
                end = max(end, s + t)
            assert end <= cap
        for x in mine:
            assert x.first_token == x.piece * cap
            assert x.tokens <= cap
        whole = {(i, t): c for i, t, c in rows if t is not None and t <= cap}
        for (i, t), c in whole.items():
            assert sum(1 for x in mine if x.id == i and x.tokens == t and x.piece == 0) >= c


def test_fill_is_high_and_reported(spark):
    r = random.Random(3)
    got = run(spark, [(i, r.randint(10, 300), 1) for i in range(4000)], [(1, 512)], group_items=1000)
    df = spark.createDataFrame(got)
    rep = packing.fill_report(df, [(1, 512)]).first()
    assert rep.fill > 0.97 and rep.containers >= rep.least_containers


def test_row_order_and_empty(spark):
    rows = [(i, 10 + i % 7, 1) for i in range(200)]
    key = lambda got: sorted((x.container, x.id, x.start) for x in got)
    assert key(run(spark, rows, [(1, 64)])) == key(run(spark, rows[::-1], [(1, 64)]))
    assert run(spark, [], [(1, 64)]) == []
    assert run(spark, rows, []) == []
