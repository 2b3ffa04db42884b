import random

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import topn

SCHEMA = "original string, word string, distance int, frequency long, rank int, s0 string, g string"
LEAST = (1 << 63) - 1


def run(spark, rows, n=3):
    df = spark.createDataFrame([(*x, 1, "q", "r") for x in rows], SCHEMA)
    coarse = F.col("s0") * 66 + topn.log2_bin(F.when(F.col("s1") != LEAST, -F.col("s1")))
    out = topn.top_n(df, "original", "word", [F.col("distance").cast("long"), F.coalesce(-F.col("frequency"), F.lit(LEAST))], coarse, n)
    return sorted((r.original, r["rank"], r.word) for r in out.collect())


def brute(rows, n=3):
    best = {}
    for o, w, d, f in rows:
        if None in (o, w, d):
            continue
        s = (d, LEAST if f is None else -f, w.encode())
        best.setdefault(o, {})
        best[o][w] = min(best[o].get(w, s), s)
    return sorted((o, i + 1, w) for o, ws in best.items() for i, w in enumerate(sorted(ws, key=ws.get)[:n]))


def test_dirt_and_ties(spark):
    rows = [("a", "x", 10, 5), ("a", "x", 10, 9), ("a", "x", 20, 99), ("a", "y", 10, 9), ("a", "é", 10, 9), ("a", "Z", 10, 9), ("a", "n", 10, None), ("a", "q", None, 7), ("a", None, 1, 1), (None, "w", 1, 1), ("A", "x", 5, 0), (" a", "x", 5, -3)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_hot_group_and_many_ties_against_brute_force(spark):
    r = random.Random(7)
    rows = [("hot" if r.random() < 0.5 else f"g{r.randint(0, 40)}", f"w{r.randint(0, 900)}", r.choice([5, 10, 10, 15, None]), r.choice([None, 1, 2, 3, 1000, 10**12])) for _ in range(4000)]
    for n in (1, 3, 50):
        assert run(spark, rows, n) == brute(rows, n)


def test_all_equal_scores(spark):
    rows = [("g", f"w{i:04}", 10, 1) for i in range(1000)] * 2
    assert run(spark, rows) == [("g", 1, "w0000"), ("g", 2, "w0001"), ("g", 3, "w0002")]


@pytest.mark.parametrize("n", [1, 3, 9, 40, 1200])
def test_any_n_on_a_hot_group(spark, monkeypatch, n):
    """Limits by column, by row, and beyond Spark's own cut; groups that share a slot; ties by the thousand."""
    monkeypatch.setattr(topn, "SLOTS", 4)
    r = random.Random(n)
    rows = [("hot", f"w{r.randrange(2500)}", r.choice([5, 10, 20]), r.choice([None, 0, 3, 900])) for _ in range(9000)]
    rows += [(f"g{r.randrange(30)}", f"w{r.randrange(40)}", r.choice([5, 10]), r.randrange(9)) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, i string, d int, f long")
    top = (1 << 63) - 1
    coarse = F.col("s0") * 66 + topn.log2_bin(F.when(F.col("s1") != top, -F.col("s1")))
    got = topn.top_n(df, "g", "i", [F.col("d").cast("long"), F.coalesce(-F.col("f"), F.lit(top))], coarse, n)
    best = {}
    for g, i, d, f in rows:
        s = (d, top if f is None else -f)
        best[g, i] = min(best.get((g, i), s), s)
    want = []
    for g in {g for g, _ in best}:
        want += [(g, i, k + 1) for k, (_, i) in enumerate(sorted((s, i) for (h, i), s in best.items() if h == g)[:n])]
    assert sorted((x.g, x.i, x.rank) for x in got.collect()) == sorted(want)
