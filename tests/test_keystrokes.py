import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from glyphloom import schemas
from glyphloom.plans import keystrokes as ks
from glyphloom.sources import keyevents as ke
from glyphloom.sources import resources as res
from glyphloom.streaming import keystrokes as streaming


def script(text):
    """Characters, or key names in angle brackets."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "<":
            j = text.index(">", i)
            out.append(text[i : j + 1])
            i = j + 1
        else:
            out.append(text[i])
            i += 1
    return out


def typed(spark, text, window=1, **kw):
    e = ke.simulate(spark, [(window, k) for k in script(text)])
    return [(r.token, r.delimiter, r.applied) for r in ks.typed_tokens(e, **kw).orderBy("last_order").collect()]


def sequential(text, limit=64):
    s, out = streaming.KeyState("en", limit), []
    for k in script(text):
        name = k[1:-1] if len(k) > 1 else None
        kind = "Char" if name is None else "Control" if name in schemas.CONTROL_KEYS else "Special"
        got = s.step(1, kind, None if name else k, name)
        if got:
            out.append(got[:3])
    return out


@pytest.mark.parametrize(
    "text",
    ["abc", "hel<Backspace>lo ", "teh ", "teh<Enter>", "a, b ", "<Shift>a<Left>b<Tab>c<Escape>", " ", "x" * 70 + " y ", "é😀 ", "a<Delete>b ", "a<Backspace><Backspace> b "],
)
def test_typed_tokens_are_what_the_sequential_rule_gives(spark, text):
    assert typed(spark, text) == typed(spark, text, piece=3) == sequential(text)


def test_random_scripts_in_small_pieces(spark):
    r = random.Random(5)
    for _ in range(3):
        text = "".join(r.choice(["a", "b", "c", "d", " ", ",", "<Backspace>", "<Enter>", "<Ctrl>"]) for _ in range(300))
        assert typed(spark, text, piece=7) == sequential(text)
        long = "".join(r.choice("abcdefg") for _ in range(400)) + " x "
        assert typed(spark, long, piece=50, limit=9) == sequential(long, 9)


def test_edit_script(spark):
    e = ke.simulate(spark, [(1, k) for k in script("teh, wrold<Enter>teh<Tab>Wrold hello ")])
    out = ks.edit_script(ks.typed_tokens(e), res.demo_resources(spark), "en").orderBy("last_order").collect()
    assert [(r.backspaces, r.insert_text) for r in out] == [(4, "the,"), (6, "World ")]


def test_focus_sessions(spark):
    t0 = dt.datetime(2024, 1, 1, 23, 59)
    rows = [(i, u, w, None if s is None else t0 + dt.timedelta(seconds=s)) for i, (u, w, s) in enumerate([(1, "a", 0), (1, "a", 30), (1, "b", 70), (1, "a", 80), (2, "a", 5), (2, "a", 200_000), (2, "c", 200_000), (1, "a", None), (None, "a", 1), (1, None, 75)])]
    e = spark.createDataFrame(rows, "event_id long, user_id long, w string, ts timestamp")
    got = {r.event_id: r.session for r in ks.focus_sessions(e, "user_id", "w", "ts", "event_id").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 0, 5: 0, 6: 1}


def test_focus_change_empties_the_buffer():
    s = streaming.KeyState("en")
    events = [(1, "t"), (1, "e"), (2, "h"), (2, " "), (1, "x"), (1, " ")]
    got = [s.step(w, "Char", c, None) for w, c in events]
    assert [g and g[0] for g in got] == [None, None, None, "h", None, "x"]
    assert streaming.KeyState("en").restore(s.save()).save() == s.save()


def test_keymaps(spark):
    rows = ke.keymap(spark, "windows").collect()
    at = {(r.code, r.shift, r.caps_lock): (r.ch, r.key) for r in rows}
    assert at[0x41, False, False] == ("a", None) and at[0x41, True, False] == ("A", None) and at[0x41, True, True] == ("a", None)
    assert at[0x31, True, False] == ("!", None) and at[0x30, True, False] == (")", None) and at[0xDE, True, False] == ('"', None)
    assert at[0x0D, False, False] == (None, "Enter") and at[0x65, False, False] == ("5", None)
    codes = spark.createDataFrame([(24, False, False), (38, True, False), (36, False, False), (200, False, False)], "code int, shift boolean, caps_lock boolean")
    got = {r.code: (r.kind, r.ch, r.key) for r in ke.decode_keycodes(codes, "linux").collect()}
    assert got == {38: ("Char", "A", None), 36: ("Special", None, "Enter")}


def test_sources(spark, tmp_path):
    ke.simulate(spark, [(1, "a"), (1, "<Enter>")]).write.parquet(str(tmp_path / "e"))
    assert ke.create_source(spark, "batch", str(tmp_path / "e")).count() == 2
    assert ke.create_source(spark, "disabled").count() == 0
    assert ke.create_source(spark, "stream", str(tmp_path / "e")).isStreaming
    for bad in (("batch", None), ("other", "x")):
        with pytest.raises(ValueError):
            ke.create_source(spark, *bad)


def test_stream_keeps_state_and_equals_batch(spark, tmp_path):
    """Three files arrive one after the other; words run over file ends."""
    text = script("the el hola mun") + script("do la de y qeu teh ") + script("wrold<Enter>qeu teh ")
    cuts, src = [0, 15, 34, len(text)], tmp_path / "src"
    full = ke.simulate(spark, [(1, k) for k in text])
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        full.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(str(src))
        import time

        time.sleep(1.1) if i < 2 else None
    r = res.demo_resources(spark)
    tokens = streaming.stream_tokens(ke.stream_events(spark, str(src)), "window_id", r, "en")
    q = tokens.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("ord").collect()
    batch = ks.typed_tokens(full).orderBy("last_order").collect()
    assert [(x.ord, x.token, x.delimiter, x.applied) for x in out] == [(x.last_order, x.token, x.delimiter, x.applied) for x in batch]
    assert [x.detected for x in out if x.detected] == ["es"]
    langs = [x.lang for x in out]
    assert langs[0] == "en" and langs[-1] == "es"
    edits = []
    q = streaming.correct_stream(spark.readStream.schema(streaming.OUTPUT).parquet(str(tmp_path / "out")), r, lambda b, n: edits.extend((e.backspaces, e.insert_text) for e in b.collect()), str(tmp_path / "cp2"))
    q.processAllAvailable()
    q.stop()
    assert sorted(edits) == sorted([(4, "que "), (4, "que ")])


def test_watermarked_additions(spark, tmp_path):
    ke.simulate(spark, [(1, "a")] * 30).coalesce(1).write.parquet(str(tmp_path / "w"))
    q = streaming.counts_per_window(ke.stream_events(spark, str(tmp_path / "w"))).writeStream.format("memory").queryName("per_window").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(events) from per_window").first()[0] == 30
    q = streaming.typing_sessions(ke.stream_events(spark, str(tmp_path / "w"))).writeStream.format("memory").queryName("sess").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [r.events for r in spark.sql("select events from sess").collect()] == [30]
