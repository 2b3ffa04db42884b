import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import langid

TEXTS = {
    "en": ["The committee heard the witnesses and every one of them spoke.", "We were told that the matter would be settled within a week.", "Nobody in this house denies that the plan was wrong from the first page."],
    "es": ["La comisión escuchó a los testigos y todos ellos hablaron ayer.", "Nos aseguraron que el asunto quedaría resuelto en una semana.", "Nadie en esta cámara niega que el plan estaba equivocado desde la primera página."],
    "pt": ["A comissão ouviu as testemunhas e todas elas falaram ontem.", "Garantiram-nos que o assunto ficaria resolvido em uma semana.", "Ninguém nesta câmara nega que o plano estava errado desde a primeira página."],
    "fr": ["La commission a entendu les témoins et tous ont parlé hier.", "On nous avait assuré que l'affaire serait réglée en une semaine.", "Personne dans cette chambre ne nie que le plan était faux dès la première page."],
    "de": ["Der Ausschuss hat die Zeugen gehört und alle haben gestern gesprochen.", "Man hat uns versichert, die Sache werde innerhalb einer Woche erledigt.", "Niemand in diesem Haus bestreitet, dass der Plan von der ersten Seite an falsch war."],
}
SCHEMA = "doc_id long, text string, lang string, id string, passage int"


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(0)
    rows, i = [], 0
    for lang, ts in TEXTS.items():
        for _ in range(30):
            label = lang if r.random() < 0.9 else r.choice(langid.LANGS)  # some wrong labels
            rows.append((i, " ".join(r.sample(ts, 3)), label, "x", 1))
            i += 1
    return langid.fit(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "lang")


def passages(spark, model, rows):
    df = spark.createDataFrame([(i, t, l, "x", 1) for i, t, l in rows], SCHEMA)
    return langid.label_passages(df, model, "doc_id", "text", "lang")


@pytest.mark.parametrize("label, lang", [("en", "en"), ("EN", "en"), (" en-GB ", "en"), ("es_419", "es"), ("Português", "pt"), ("por", "pt"), ("Deutsch", "de"), ("ger", "de"), ("fre", "fr"), ("pt/fr", None), ("mul", None), ("und", None), ("", None), (None, None), ("it", None), ("english text", None), ("-", None), ("en" + "-aa" * 100_000, None)])
def test_labels(spark, label, lang):
    assert spark.createDataFrame([(label,)], "l string").select(langid.label_language(F.col("l"))).first()[0] == lang


def test_sentences_and_asides():
    t = "One two three four five. (Interruption: Shame on you all now!) Short one. – A. Name: Isso não é verdade! – The next sentence goes on and on.\n\nSchluss aus und jetzt noch was"
    assert [s[2] for s in langid.sentences(t)] == ["one two three four five", "the next sentence goes on and on", "schluss aus und jetzt noch was"]
    assert langid.sentences("") == [] and langid.sentences("a b") == []
    assert [s[2] for s in langid.sentences("the chif-\nfres were known in spring")] == ["the chiffres were known in spring"]


def test_odd_long_texts_take_linear_time():
    for t in ("!" * 500_000, "\n" * 500_000, "(" * 500_000, "– " * 200_000, "a" * 500_000, "*" * 500_000, "." + "'" * 500_000, "! " * 200_000):
        assert langid.sentences(t) == []


def test_texts_passages_and_mislabelled(spark, model):
    mixed = f"{TEXTS['en'][0]} {TEXTS['en'][1]} «{TEXTS['pt'][1]} {TEXTS['pt'][2]}» {TEXTS['en'][2]}"
    rows = [(1, TEXTS["es"][0], "es-MX"), (2, TEXTS["es"][1], "pt"), (3, TEXTS["fr"][2], None), (4, mixed, "en"), (5, None, "en"), (6, "", "en"), (7, "ja", "de"), (8, TEXTS["de"][0] + " (Interruption: That is not true at all!)", "de"), (8, TEXTS["de"][0], "xx")]
    p = passages(spark, model, rows)
    by = {}
    for r in p.collect():
        by.setdefault(r.id, []).append(r)
    assert [(r.lang, r.sentences) for r in sorted(by[4], key=lambda r: r.passage)] == [("en", 2), ("pt", 2), ("en", 1)]
    assert by[4][0].text_lang == "en" and by[4][0].text_langs == 2
    assert by[4][1].text_confidence >= 0.5 and mixed[by[4][1].start : by[4][1].end].strip().startswith("«Garantiram")
    assert all(by[k][0].lang is None and len(by[k]) == 1 for k in (5, 6, 7))
    got = sorted((r.id, r.lang) for r in langid.mislabelled(p).collect())
    assert got == [(2, "es"), (3, "fr"), (4, "en"), (4, "pt"), (8, "de")]


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fitted = langid.fit(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang")
    p = langid.label_passages(docs.where("doc_id % 2 = 1"), fitted, "doc_id", "text", "lang")
    rows = p.where("label_lang is not null and (passage = 0 or passage is null)").select("label_lang", "text_lang").collect()
    assert len(rows) > 20 and sum(r.label_lang == r.text_lang for r in rows) / len(rows) > 0.9  # some labels are wrong


def test_filter_has_no_false_negatives_and_corrects_false_positives():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    m = r.integers(1, 32, len(h)).astype(np.uint8)
    f = langid.LanguageFilter(h, m)
    assert np.all(f.masks(h) & m == m)
    other = r.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    rate = np.mean((f.masks(other) & 1) > 0)
    assert abs(rate - f.false[0]) < 0.003


def test_without_labels_and_long_text(spark, model):
    empty = langid.fit(spark.createDataFrame([(1, "some text that has no label at all.", None, "x", 1)], SCHEMA), "doc_id", "text", "lang")
    assert {r.lang for r in passages(spark, empty, [(1, TEXTS["en"][0], "en")]).collect()} == {None}
    long = " ".join([TEXTS["en"][0]] * 20_000 + [TEXTS["de"][0]])
    got = sorted((r.passage, r.lang, r.sentences) for r in passages(spark, model, [(1, long, "en")]).collect())
    assert got == [(0, "en", 20_000), (1, "de", 1)]


def test_asides_of_any_length():
    aside = "the members over there went on and on about it. " * 40
    for a in (f"({aside})", f"[{aside}]", f"*{aside.strip()}*", f"— a member: {aside}—"):
        assert [s[2] for s in langid.sentences(f"one two three {a} four five. a b.")] == ["one two three four five"], a[:20]
    assert len(langid.sentences("it was ( said here that day.\n\nand so it went on for long) they said again.")) == 2


def test_labels_of_any_length(spark):
    asked = {" " * 5000 + "en-GB" + " " * 5000: "en", "en-" + "x" * 9: None, "en--gb": None, "en-": None, "zh_Hans_CN": None, "pt-Latn-BR": "pt", "de-1996": "de", "de-DE-1996-abcde": "de", "en-gb-us": None}
    got = spark.createDataFrame([(x,) for x in asked], "l string").select("l", langid.label_language(F.col("l")).alias("x"))
    assert {r.l: r.x for r in got.collect()} == asked


def test_short_texts_and_many_languages(spark):
    r = random.Random(5)
    labels = {f"l{k:02}": [f"l{k:02}", f"language {k}"] for k in range(12)}
    words = {l: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(25)] for l in labels}
    text = lambda l, n: " ".join(r.choice(words[l]) for _ in range(n)).capitalize() + "."
    rows = [(i, " ".join(text(l, 8) for _ in range(4)), f"Language {k}") for i, (k, l) in enumerate((k, l) for k, l in enumerate(labels) for _ in range(12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, "doc_id", "text", "lang", labels)
    assert model.kind is np.uint16
    ask = spark.createDataFrame([(k, text(l, 3), None) for k, l in enumerate(labels)] + [(98, "", None), (99, "§§ 12", None)], "doc_id long, text string, lang string")
    got = {x.id: (x.text_lang, x.sentences, x.text_confidence) for x in langid.label_passages(ask, model, "doc_id", "text", "lang", labels).collect()}
    assert [got[k][0] for k in range(12)] == list(labels)
    assert all(got[k][1] == 0 and 0 < got[k][2] <= 1 for k in range(12))
    assert got[98][0] is None and got[99][0] is None
