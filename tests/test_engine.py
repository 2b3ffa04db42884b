"""Tokenizer, resources, fuzzy search, correction, detection, pipeline."""

import json
import random

import pytest
from pyspark.sql import functions as F

from glyphloom.config import Config, CorrectionConfig, DetectorConfig, PipelineConfig
from glyphloom.functions import distance
from glyphloom.operators import correct, detect, feedback, lookup, similarity, tokenize
from glyphloom.plans import pipeline
from glyphloom.sources import resources as res
from glyphloom.streaming.keystrokes import KeyState, evidence_of


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, token string")


# --------------------------------------------------------------- tokenizer
@pytest.mark.parametrize(
    "text, out",
    [("hola mundo cruel", ["hola", "mundo", "cruel"]), ("a, b ", ["a", "", "b"]), ("café.", ["café"]), ("😀 ", ["😀"]), ("don't-stop ", ["don't-stop"]), ("a_b ", ["a", "b"]), ("é ", ["é"]), ("﻿hi ", ["﻿hi"]), ("", []), (" ", [""]), ("x" * 100 + " ", ["x" * 64])],
)
def test_tokenize(spark, text, out):
    rows = tokenize.tokenize(docs(spark, text, None), "doc_id", "text").orderBy("pos").collect()
    assert [r.token for r in rows] == out and [r.pos for r in rows] == list(range(len(out)))
    assert [r.pending for r in rows] == [i == len(out) - 1 and text[-1] not in " ._," for i in range(len(out))]


def test_paste_and_pieces(spark):
    d = docs(spark, "   \t\n  ", " hello  world \t", "Teh wrold, TEH! a_b «x»")
    assert [r[0] for r in d.orderBy("doc_id").select(tokenize.paste_tokens(F.col("text"))).collect()] == [[], ["hello", "world"], ["Teh", "wrold", "TEH", "a", "b", "«x»"]]
    p = tokenize.explode_pieces(d, "doc_id", "text").where("doc_id = 2").orderBy("pos").collect()
    assert "".join(r.piece for r in p) == "Teh wrold, TEH! a_b «x»"
    assert [r.piece for r in p if r.is_word] == ["Teh", "wrold", "TEH", "a", "b", "x"]


def test_buffer_events(spark):
    e = tokenize.buffer_events(docs(spark, "ab " + "c" * 70 + " d"), "doc_id", "text").orderBy("pos", "event").collect()
    assert [(r.event, len(r.token), r.discarded) for r in e] == [("TokenExtracted", 2, 0), ("BufferTruncated", 64, 6), ("TokenExtracted", 64, 0), ("BufferCleared", 1, 0)]


# --------------------------------------------------------------- resources
def test_build_dictionary(spark):
    w = spark.createDataFrame([("en", "The", 5, 0), ("en", "the", 9, 1), ("es", "niño", 0, 2), ("es", None, 1, 3), ("es", "", 1, 4), ("es", "que", None, 5)], "lang string, word string, freq long, pos int")
    got = {(r.lang, r.word, r.word_enc, r.freq) for r in res.build_dictionary(w, "lang", "word", "freq", ["pos"]).collect()}
    assert got == {("en", "the", "the", 5), ("es", "niño", "niNo", 1), ("es", "que", "que", 1)}


def test_files_round_trip(spark, tmp_path):
    for d in ("dictionaries", "stopwords", "errors"):
        (tmp_path / d).mkdir()
    (tmp_path / "dictionaries/en.json").write_text(json.dumps({"words": [{"word": "Hello", "frequency": 7}, {"word": "hello"}, {"word": "sun"}]}))
    (tmp_path / "stopwords/en.json").write_text(json.dumps({"language": "en", "stopwords": ["The", "the", "a"]}))
    (tmp_path / "errors/es.json").write_text(json.dumps({"errors": {"QEU": "Que", "x" * 51: "y", "ahora": "ahora"}}))
    r = res.Resources.load(spark, str(tmp_path), ["en", "es", "pt"])
    assert {(x.lang, x.word, x.freq) for x in r.dictionary.collect()} == {("en", "hello", 7), ("en", "sun", 1)}
    assert {(x.lang, x.word) for x in r.stopwords.collect()} == {("en", "the"), ("en", "a")}
    assert {(x.lang, x.typo, x.correction) for x in r.errors.collect()} == {("es", "qeu", "Que"), ("es", "ahora", "ahora")}
    res.write_dictionary(r.dictionary, str(tmp_path / "d.parquet"))
    assert res.read_dictionary(spark, str(tmp_path / "d.parquet")).count() == 2
    learned = r.add_errors(res.errors_from_json(spark, "es", '{"Foo": "Bar"}', "user")).errors
    res.save_learned(learned, str(tmp_path / "u.json"), "es")
    assert json.loads((tmp_path / "u.json").read_text()) == {"foo": "bar"}
    assert res.load_learned(spark, str(tmp_path / "u.json"), "es").count() == 1
    assert res.load_learned(spark, str(tmp_path / "none.json"), "es").count() == 0


def test_blobs():
    assert res.unwrap_blob(res.wrap_blob(b"x" * 20)) == b"x" * 20
    for bad in (b"short", b"NOPE" + b"x" * 20):
        with pytest.raises(ValueError):
            res.unwrap_blob(bad)


def test_importers(spark, tmp_path):
    (tmp_path / "freq.txt").write_text("the 100\nThe 5\nx 3\nab1 4\nword 7 8\nok 9\n")
    f = {(r.word, r.freq) for r in res.import_frequency_list(spark, str(tmp_path / "freq.txt"), "en").collect()}
    assert f == {("a", 100_000_000), ("I", 100_000_000), ("the", 100), ("ok", 9)}
    (tmp_path / "words.txt").write_text("Hello!\n'quoted'\na\nhello\nco-op\n")
    (tmp_path / "counts.txt").write_text("hello 3\nHELLO 5\nbad x\n")
    w = {(r.word, r.freq) for r in res.import_expanded_words(spark, str(tmp_path / "words.txt"), "en", str(tmp_path / "counts.txt"), 2).collect()}
    assert w == {("hello", 5), ("quoted", 2), ("co-op", 2)}
    assert {r.word for r in res.import_word_list(spark, str(tmp_path / "words.txt"), "en", 3).collect()} == {"Hello!", "'quoted'"}


def test_errors_and_weights(spark):
    e = spark.createDataFrame([("es", "qeu", "que", "static", 1), ("es", "QEU", "Qué", "user", 2), ("es", "qeu", "quo", "user", 1), ("es", "tengo", "Tengo", "user", 1), ("en", "x", None, "static", 1)], "lang string, typo string, correction string, source string, t timestamp_ntz".replace("timestamp_ntz", "long"))
    clean = res.clean_errors(e.withColumn("t", F.timestamp_seconds("t")), "t")
    assert {(r.lang, r.typo, r.correction, r.source) for r in clean.collect()} == {("es", "qeu", "qué", "user")}
    s = spark.createDataFrame([("en", "No"), ("es", "no"), ("en", "NO"), ("pt", "a")], "lang string, word string")
    assert {r.word: r.weight for r in res.stopword_weights(s).collect()} == {"no": 0.5, "a": 1.0}


def test_compile_static(spark):
    r = res.demo_resources(spark)
    e = res.errors_from_json(spark, "es", '{"errors":{"hola":"ola","habia":"había","qeu":"que"}}')
    d = r.add_dictionary(res.dictionary_from_rows(spark, "es", {"habia": 3})).dictionary
    assert {x.typo for x in res.compile_static(e, d).collect()} == {"habia", "qeu"}


# ------------------------------------------------------------ fuzzy search
def test_candidates_are_complete(spark):
    r = random.Random(3)
    make = lambda n: "".join(r.choice("abcde") for _ in range(n))
    base = [make(r.choice([0, 1, 2, 3, 5, 8, 12, 22, 23, 24, 25, 26, 30, 40, 70])) for _ in range(120)]

    def slip(w):
        k = r.randrange(len(w) + 1)
        return r.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :]])

    words = sorted({slip(slip(b)) for b in base} | {slip(b) for b in base} | set(base[:20]))
    q = spark.createDataFrame([("l", w) for w in words], "lang string, word_q string")
    d = spark.createDataFrame([("l", w) for w in set(base)] + [("m", "abc")], "lang string, word_enc string")
    for t in (1, 2):
        a = {tuple(x) for x in similarity.candidates(q, d, t).collect()}
        assert a == {tuple(x) for x in similarity.candidates_by_length(q, d, t).collect()}
        assert len(a) > 100


def top(spark, word, words, max_distance, k=3):
    d = res.dictionary_from_rows(spark, "en", words)
    q = spark.createDataFrame([("en", word)], "lang string, word string")
    return [(r.candidate, r.distance, r.frequency) for r in similarity.find_similar(q, d, max_distance, k).orderBy("rank").collect()]


UNIT = {"and": 9000, "hello": 1000, "hola": 900, "is": 8000, "que": 500, "the": 10000, "world": 800}


@pytest.mark.parametrize(
    "word, words, limit, out",
    [
        ("wrold", UNIT, 1, [("world", 10, 800)]), ("ths", UNIT, 1, [("the", 5, 10000)]), ("holla", UNIT, 1, [("hola", 10, 900)]), ("holla", UNIT, 2, [("hola", 10, 900), ("hello", 20, 1000)]),
        ("helo", {"hallo": 400, "hello": 1000, "jello": 800, "yello": 600}, 1, [("hello", 10, 1000)]), ("helo", {"hella": 600, "hello": 1000, "jello": 800}, 2, [("hello", 10, 1000), ("jello", 15, 800), ("hella", 15, 600)]),
        ("tambien", {"también": 3}, 1, [("también", 10, 3)]), ("xyzzyab", UNIT, 2, []),
    ],
)
def test_find_similar(spark, word, words, limit, out):
    assert top(spark, word, words, limit) == out


def test_find_similar_against_brute_force(spark):
    r = random.Random(4)
    words = {"".join(r.choice("qweas") for _ in range(r.randint(2, 6))): r.randint(1, 50) for _ in range(60)}
    queries = ["".join(r.choice("qweas") for _ in range(r.randint(2, 6))) for _ in range(30)]
    d = res.dictionary_from_rows(spark, "en", words)
    got = {}
    for x in similarity.find_similar(spark.createDataFrame([("en", q) for q in set(queries)], "lang string, word string"), d, 2, 4).collect():
        got.setdefault(x.word, []).append((x.rank, x.candidate, x.distance))

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, x, b, i)
        return row[-1]

    def _next(row, x, b, i):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    for q in set(queries):
        want = sorted((distance.keyboard_distance(q, w, 2), -f, w) for w, f in words.items() if lev(q, w) <= 2 and distance.overlap_ok(q, w) and distance.keyboard_distance(q, w, 2) <= 20)[:4]
        assert sorted(got.get(q, [])) == [(i + 1, w, c) for i, (c, _, w) in enumerate(want)]


# --------------------------------------------------------------- correction
def decide(spark, r, *words, lang="en", **kw):
    q = spark.createDataFrame([(lang, w) for w in words], "lang string, word string")
    return {x.word: (x.corrected, x.source) for x in correct.correct_words(q, r, CorrectionConfig(**kw)).collect()}


def test_correct_words(spark):
    r = res.demo_resources(spark)
    got = decide(spark, r, "h", "hello", "HELLO", "teh", "TEH", "-teh-", "Wrold", "WROLD", "mundo", "--", "", "😀", "a" * 1000, "xyzzyab", "-wrold'")
    none = (None, "None")
    assert got == {"h": none, "hello": none, "HELLO": none, "teh": ("the", "UserKnown"), "TEH": ("the", "UserKnown"), "-teh-": ("-the-", "UserKnown"), "Wrold": ("World", "Dictionary"), "WROLD": ("WORLD", "Dictionary"), "mundo": none, "--": none, "": none, "😀": none, "a" * 1000: none, "xyzzyab": none, "-wrold'": ("-world'", "Dictionary")}
    x = correct.correct_words(spark.createDataFrame([("en", "-teh-")], "lang string, word string"), r).first().candidates
    assert [(c.word, c.distance, c.frequency, c.source) for c in x] == [("-the-", 0, 1000, "UserKnown")]


def test_protection_accents_and_learning(spark):
    r = res.demo_resources(spark).add_errors(res.errors_from_json(spark, "es", '{"errors":{"ahora":"ahora","habia":"había"}}'))
    assert decide(spark, r, "ahora", "habia", lang="es") == {"ahora": (None, "None"), "habia": (None, "None")}
    assert decide(spark, r, "habia", lang="es", enforce_accents=True) == {"habia": ("había", "UserKnown")}
    r2 = r.add_errors(res.errors_from_json(spark, "es", '{"qeu":"qué","mytypo":"my typo"}', "user"))
    assert decide(spark, r2, "qeu", "mytypo", lang="es") == {"qeu": ("qué", "UserKnown"), "mytypo": ("my typo", "UserKnown")}
    assert decide(spark, r, "teh", lang="") == {"teh": (None, "None")}


def test_correct_text(spark):
    out = correct.correct_text(docs(spark, "hello, world!", "Teh wrold, TEH!", "", "…😀 –"), res.demo_resources(spark), "en", "doc_id", "text")
    assert [r.corrected_text for r in out.orderBy("doc_id").collect()] == ["hello, world!", "The world, The!", "", "…😀 –"]


def test_suggestions(spark):
    r = res.demo_resources(spark)
    q = spark.createDataFrame([("en", "Teh"), ("en", "wrold"), ("en", "hello"), ("en", None)], "lang string, word string")
    got = [(x.word, x.rank, x.candidate, x.distance, x.frequency, x.source) for x in correct.suggestions(q, r).orderBy("word", "rank").collect()]
    assert got == [("Teh", 1, "the", 0, 1000, "UserKnown"), ("Teh", 2, "the", 10, 10000, "Dictionary"), ("wrold", 1, "world", 10, 800, "Dictionary")]
    assert correct.suggestions(q, r, CorrectionConfig(max_candidates=0)).count() == 0


def test_lookups(spark):
    r = res.demo_resources(spark)
    q = spark.createDataFrame([("en", "hello"), ("en", "hola"), ("es", "qeu"), ("en", "the")], "lang string, word string")
    assert {x.word: x.freq for x in lookup.exact_frequency(q, r.dictionary).collect()} == {"hello": 1000, "hola": None, "qeu": None, "the": 10000}
    assert {x.word for x in lookup.unknown_words(q, r.dictionary).collect()} == {"qeu"}
    assert {x.word for x in lookup.known_words(q, r.dictionary).collect()} == {"hello", "hola", "the"}
    assert {x.word for x in lookup.known_typos(q, r.errors).collect()} == {"qeu"}
    assert {x.word for x in lookup.is_stopword(q, r.stopwords).collect()} == {"the"}
    assert {x.lang: x.words for x in lookup.dictionary_size(r.dictionary).collect()} == {"en": 4, "es": 3}


def test_feedback(spark):
    rows = [("es", "Qeu", "Que", 1, "learn"), ("es", "qeu", "qué", 2, "learn"), ("es", "a", "a", 3, "learn"), ("es", "b", "c", 3, "learn"), ("es", "b", None, 4, "unlearn"), ("en", "x", "y", 1, "learn"), ("en", None, None, 2, "clear"), ("en", "z", "w", 3, "learn"), ("en", "q", "r" * 51, 3, "learn")]
    log = spark.createDataFrame(rows, "lang string, typo string, correction string, at long, action string")
    m = feedback.learned_map(log)
    assert {(r.lang, r.typo, r.correction) for r in m.collect()} == {("es", "qeu", "qué"), ("en", "z", "w")}
    assert feedback.most_recent(m, 0).count() == 0
    e = res.demo_resources(spark).errors
    assert [(r.typo, r.correction) for r in feedback.all_typos(e).where("lang = 'en'").collect()] == [("teh", "the"), ("qeu", "que")]
    assert {r.lang: (r.static_errors, r.user_errors) for r in feedback.map_statistics(e).collect()} == {"en": (3, 0), "es": (3, 0)}


# ---------------------------------------------------------------- detection
def run_detect(spark, words, stops, dictionary=None, initial="en", **cfg):
    s = spark.createDataFrame([(l, w) for l, ws in stops.items() for w in ws.split()] or [], "lang string, word string")
    d = res.Resources.empty(spark).dictionary
    for l, ws in (dictionary or {}).items():
        d = d.unionByName(res.dictionary_from_rows(spark, l, dict.fromkeys(ws.split(), 1)))
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate(words.split(" "))], "doc_id long, pos int, token string")
    c = DetectorConfig(**cfg)
    got = [(r.pos, r.language, round(r.confidence, 3)) for r in detect.detect(t, s, d, sorted(stops), initial, c).orderBy("pos").collect()]
    r = res.Resources(d, s, res.Resources.empty(spark).errors)
    state = KeyState(initial, 64, c, evidence_of(r, sorted(stops)), sorted(stops))
    seq = []
    for i, w in enumerate(words.split(" ")):
        f = state.detect(w)
        if f:
            seq.append((i, f[0], round(f[1], 3)))
    assert got == seq  # batch and stream agree
    return got


def test_detection_traces(spark):
    five = {"window_size": 5}
    assert run_detect(spark, "el la", {"es": "el la", "en": "the"}, confidence_threshold=0.6, hysteresis_zone=0.0, min_words_before_switch=2, **five) == [(1, "es", 1.0)]
    assert run_detect(spark, "el la", {"es": "el la"}, confidence_threshold=0.9, min_words_before_switch=3) == []
    both = " ".join(f"word{i}" for i in range(10))
    assert run_detect(spark, "word1 el word2", {"es": both + " el la", "en": both}, confidence_threshold=0.9, hysteresis_zone=0.2, min_words_before_switch=3) == []
    demo = {"en": "the a an is are and or but", "es": "el la de que es y en un"}
    assert run_detect(spark, "the el hola mundo la de y que", demo, {"en": "and hello the world", "es": "hola mundo que"}) == [(5, "es", 1.0)]


def test_detection_against_the_sequential_rule(spark):
    r = random.Random(8)
    stops = {"en": "the of no a", "es": "el de no a", "pt": "o de no as"}
    words = {"en": "sun sea", "es": "sol mar", "pt": "sol mar"}
    vocab = " ".join([*stops.values(), *words.values()]).split() + ["", "zzz"]
    for k in range(3):
        text = " ".join(r.choice(vocab) for _ in range(150))
        run_detect(spark, text, stops, words, window_size=4 + k, confidence_threshold=0.6, hysteresis_zone=0.3, min_words_before_switch=3)


# ----------------------------------------------------------------- pipeline
def test_pipeline(spark):
    r = res.demo_resources(spark)
    d = docs(spark, "teh el hola mundo la de y qeu qeu")
    out = pipeline.process_texts(d, r, "en", config=Config(pipeline=PipelineConfig(language_mode="propagate_next"))).orderBy("pos").collect()
    assert [x.original for x in out] == "teh el hola mundo la de y qeu qeu".split()
    assert [x.pos for x in out if x.detected_language] == [4] or [x.pos for x in out if x.detected_language] == [5]
    assert out[0].corrected == "the" and out[7].corrected == "que" and out[8].detected_language is None
    off = pipeline.process_texts(docs(spark, "teh wrold"), r, "en", config=Config(pipeline=PipelineConfig(auto_correct=False, strict_remainder=True))).orderBy("pos").collect()
    assert [x.corrected for x in off] == [None, "world"]
    plain = pipeline.process_texts(docs(spark, "teh wrold"), r, "en", config=Config(pipeline=PipelineConfig(auto_correct=False, detect_language=False))).orderBy("pos").collect()
    assert [x.corrected for x in plain] == [None, None]
    sug = pipeline.process_texts(docs(spark, "Teh"), r, "en", remainder="suggest").first()
    assert sug.corrected == "the"


def test_pipeline_events_and_json(spark):
    r = pipeline.process_texts(docs(spark, "teh sky "), res.demo_resources(spark), "en")
    e = [(x.pos, x.event, x.corrected) for x in pipeline.pipeline_events(r).orderBy("pos", "step").collect()]
    assert e == [(0, "WordExtracted", None), (0, "WordCorrected", "the"), (1, "WordExtracted", None)]
    j = [json.loads(x[0]) for x in r.orderBy("pos").select(pipeline.result_json()).collect()]
    assert j[0] == {"original": "teh", "corrected": "the", "detected_language": None}


# ------------------------------------------------------------------- config
def test_config(tmp_path):
    c = Config()
    assert c.detector.confidence_threshold == 0.9 and c.correction.max_edit_distance == 1
    c.to_file(tmp_path / "c.json")
    assert Config.from_file(tmp_path / "c.json") == c == Config.load_or_default(tmp_path / "none.json")
    assert Config.from_json('{"correction": {"max_edit_distance": 2}, "unknown": 1}').correction == CorrectionConfig(max_edit_distance=2)
    for bad in ({"supported_languages": []}, {"default_language": "zz"}, {"user_preferred_language": "zz"}, {"detector": {"confidence_threshold": 1.5}}, {"pipeline": {"max_token_chars": 0}}, {"pipeline": {"language_mode": "x"}}):
        with pytest.raises(ValueError):
            Config.from_dict(bad)
    with pytest.warns(UserWarning):
        Config.from_dict({"correction": {"max_edit_distance": 3}})


@pytest.mark.parametrize("threshold", [1, 2, 3, 4])
def test_candidates_of_any_distance(spark, threshold):
    import random

    r = random.Random(threshold)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 12)))
    q = spark.createDataFrame(sorted({("en", word()) for _ in range(150)}), "lang string, word_q string")
    d = spark.createDataFrame(sorted({("en", word()) for _ in range(150)}), "lang string, word_enc string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(similarity.candidates(q, d, threshold)) == rows(similarity.candidates_by_length(q, d, threshold).distinct())
