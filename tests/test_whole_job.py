"""Nothing is left out: rows, characters and sizes that the registered queries once cut away."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphloom import core_queries
from glyphloom.functions import distance
from glyphloom.operators import detect, feedback
from glyphloom.plans import keystrokes
from glyphloom.sources import keyevents
from glyphloom.sources import resources as res
from glyphloom.sources.resources import MAX_LEARNED
from glyphloom.streaming import keystrokes as streaming


def test_learned_map_keeps_every_entry(spark, tmp_path):
    n, t0 = MAX_LEARNED + 1, dt.datetime(2024, 1, 1)
    rows = [(i, "en", f"typo{i}", f"word{i}", "user", t0 + dt.timedelta(seconds=i)) for i in range(n)]
    rows += [(n, "en", "typo0", None, "user", t0 + dt.timedelta(days=9)), (n + 1, "en", "typo1", "x", "static", None)]
    e = spark.createDataFrame(rows, "error_id long, lang string, typo string, correction string, source string, learned_at timestamp")
    e.write.parquet(str(tmp_path / "errors.parquet"))
    got = core_queries.learned_map(spark, str(tmp_path))
    assert {(r.typo, r.correction) for r in got.collect()} == {(f"typo{i}", f"word{i}") for i in range(1, n)}
    assert feedback.most_recent(got, 3).count() == 3


PAIRS = [
    ("Também", "tambem"), ("coraçao", "coração"), ("niño", "nino"), ("teh", "the"), ("Łódź", "lodz"), ("日本語", "日本"), ("😀ab", "😀ba"), ("é", "è"), ("tge", "thé"), ("е́", "e"),
    ("", ""), ("", "á"), ("x" * 70, "x" * 69 + "é"), ("señor" * 20, "senor" * 20), ("teh", "the"), (None, "a"), ("b", None),
]


def test_pairs_of_all_words(spark, tmp_path):
    spark.createDataFrame(PAIRS, "original string, corrected string").write.parquet(str(tmp_path / "token_result.parquet"))
    rows = {n: [tuple(r) for r in core_queries.QUERIES[n](spark, str(tmp_path)).collect()] for n in ("damerau_pairs", "keyboard_pairs", "overlap_pairs")}
    pairs = {(a.lower(), b.lower()) for a, b in PAIRS if a is not None and b is not None}
    assert sorted(rows["damerau_pairs"]) == sorted((a, b, min(distance._table(a, b, 1, lambda x, y: int(x != y)), 3)) for a, b in pairs)
    assert sorted(rows["keyboard_pairs"]) == sorted((a, b, min(distance._table(a, b, 10, distance.key_cost), 21)) for a, b in pairs)
    assert sorted(rows["overlap_pairs"]) == sorted((a, b, sum((Counter(a) & Counter(b)).values()), distance.overlap_ok(a, b)) for a, b in pairs)


@pytest.mark.parametrize("name", ["damerau_pairs", "keyboard_pairs", "overlap_pairs"])
def test_the_sql_has_all_words(name, same):
    """The SQL takes words of any characters, as the query does."""
    _, _, ours, theirs = same(name, core_queries.QUERIES, core_queries.SQL)
    assert ours == theirs
    assert not all(x.isascii() for row in theirs for x in row)


def test_fuzzy_candidates_of_all_words(spark, tmp_path):
    words = ["straße", "żółw", "мир", "e\u0301t", "ｆｕｌｌ", "café", "naïve", "hello", "😀smile", "über" * 8]
    typed = ["strase", "zółw", "мlр", "et\u0301", "ｆｕlｌ", "cafè", "naive", "hеllo", "😀smlie", "uber" + "über" * 7, "mundø"]
    spark.createDataFrame([(i, "en", w, 5) for i, w in enumerate(words)], "entry_id long, lang string, word string, freq long").write.parquet(str(tmp_path / "dictionary.parquet"))
    spark.createDataFrame([(w, None) for w in [*typed, *words]], "original string, detected_language struct<code:string>").write.parquet(str(tmp_path / "token_result.parquet"))
    code = str.maketrans("áéíóúñüãõçâêôà", "AEIOUNWBCDFGJL")
    want = {("en", t.translate(code), w.translate(code)) for t in typed for w in words if levenshtein(t.translate(code), w.translate(code)) <= 2}
    got = [tuple(r) for r in core_queries.fuzzy_candidates(spark, str(tmp_path)).collect()]
    assert len(want) >= 10 and sorted(got) == sorted(want)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_stream_detects_by_dictionaries_of_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "MAX_EVIDENCE", 1, raising=False)
    keyevents.simulate(spark, [(1, k) for k in "mundo hola mundo hola mundo hola "]).coalesce(1).write.parquet(str(tmp_path / "src"))
    tokens = streaming.stream_tokens(keyevents.stream_events(spark, str(tmp_path / "src")), "window_id", res.demo_resources(spark), "en")
    q = tokens.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("ord").collect()
    assert [r.detected for r in out if r.detected] == ["es"] and out[-1].lang == "es"


def test_stream_languages_equal_the_batch_detector(spark, sf):
    r = core_queries._resources(spark, sf)
    t = keystrokes.typed_tokens(core_queries._events(spark, sf)).withColumn("pos", F.row_number().over(Window.partitionBy("window_id").orderBy("last_order")))
    found = detect.detect(t.select(F.col("window_id").alias("doc_id"), "pos", "token"), r.stopwords, r.dictionary, r.languages(), "en")
    at = {(x.doc_id, x.pos): (x.language, round(x.confidence, 9)) for x in found.collect()}
    want, lang, last = [], "en", None
    for x in t.orderBy("window_id", "pos").collect():
        lang, last = (lang if x.window_id == last else "en"), x.window_id
        new, sure = at.get((x.window_id, x.pos), (None, None))
        want.append((x.window_id, x.last_order, x.token, lang, new, sure))
        lang = new or lang
    out = core_queries.stream_languages(spark, sf).orderBy("window_id", "last_order").collect()
    assert at and [(x.window_id, x.last_order, x.token, x.lang, x.detected, x.confidence and round(x.confidence, 9)) for x in out] == want


def test_saved_file_has_every_learned_entry(spark, tmp_path):
    n = MAX_LEARNED + 1
    e = spark.range(n).selectExpr("'en' lang", "concat('typo', id) typo", "concat('word', id) correction", "'user' source")
    res.save_learned(e, str(tmp_path / "en.json"), "en")
    assert json.loads((tmp_path / "en.json").read_text()) == {f"typo{i}": f"word{i}" for i in range(n)}


def test_long_words_are_compared(monkeypatch):
    long = "abcde" * 400
    for limit in (1, 2, 3, 30):
        assert distance.damerau(long, "x" + long[1:-1] + "x", limit) == min(2, limit + 1)
        assert distance.damerau(long, long[:999] + "é" + long[999:], limit) == 1
    monkeypatch.setattr(distance, "MAX_CELLS", 0)  # near the diagonal only
    r = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(9))) for _ in range(2))
        d = distance._table(a, b, 1, lambda x, y: int(x != y))
        assert [distance.damerau(a, b, k) for k in (1, 2, 3, 4, 6)] == [min(d, k + 1) for k in (1, 2, 3, 4, 6)], (a, b)
