"""Keystroke streams: a stateful tokenizer and detector, corrections per micro-batch.

``KeyState.step`` is the whole sequential logic as a pure function of state and
event; the streaming operator and the tests drive the same one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphloom.config import CorrectionConfig, DetectorConfig
from glyphloom.functions.chars import PUNCTUATION, WHITESPACE
from glyphloom.operators.correct import correct_tokens
from glyphloom.operators.detect import unit, word_evidence
from glyphloom.sources.resources import Resources

DELIMITERS = set(WHITESPACE + PUNCTUATION)
ENDING_KEYS = {"enter", "tab", "escape"}

OUTPUT = "device long, ord long, token string, delimiter string, applied boolean, lang string, detected string, confidence double"
STATE = "saved string"


class KeyState:
    """Buffer, word window, language and focused window of one device."""

    def __init__(self, language: str, limit: int = 64, config: DetectorConfig = DetectorConfig(), evidence: dict | None = None, langs: list[str] | None = None):
        self.language, self.limit, self.config = language, limit, config
        self.evidence, self.langs = evidence or {}, langs or []
        self.buffer, self.words, self.focus = "", [], 0

    def save(self) -> str:
        return json.dumps([self.buffer, self.words, self.language, self.focus])

    def restore(self, saved: str) -> KeyState:
        self.buffer, self.words, self.language, self.focus = json.loads(saved)
        return self

    def push(self, ch: str) -> str | None:
        """A token if ``ch`` ends one; at the bound a character is dropped and the oldest leaves."""
        if ch in DELIMITERS:
            token, self.buffer = self.buffer, ""
            return token
        self.buffer = self.buffer + ch if len(self.buffer) < self.limit else self.buffer[1:]
        return None

    def detect(self, token: str) -> tuple[str, float] | None:
        """The new language and its score if it changes with this token."""
        self.words = [*self.words, token.lower()][-self.config.window_size :]
        if len(self.words) < self.config.min_words_before_switch or not self.langs:
            return None
        k = len(self.langs)
        nothing = [0] * (2 * k)
        rows = [self.evidence.get(w, nothing) for w in self.words]
        totals = [sum(r[i] + r[k + i] for r in rows) for i in range(k)]
        whole = sum(totals)
        if whole <= 0:
            return None
        scores = [t / whole for t in totals]
        top = max(scores)
        best = [lang for lang, s in zip(self.langs, scores) if s == top]
        new = self.language if self.language in best else best[0]
        if new == self.language or top < self.config.confidence_threshold - self.config.hysteresis_zone:
            return None
        if top < self.config.confidence_threshold:
            now = sum(r[self.langs.index(self.language)] for r in rows) / (len(rows) * unit(self.langs)) if self.language in self.langs else 0.0
            if top <= now * 1.2:
                return None
        self.language = new
        return new, top

    def step(self, window: int, kind: str, ch: str | None, key: str | None) -> tuple | None:
        """(token, delimiter, applied, language, detected, confidence) if the event ends a token."""
        if self.focus != 0 and window != self.focus:
            self.buffer = ""
        self.focus = window
        name = "".join(c for c in (key or "").lower() if c.isalpha())
        if kind == "Char" and ch is not None:
            end, applied = ch, True
        elif kind == "Special" and name in ENDING_KEYS:
            end, applied = " ", False
        else:
            if kind == "Special" and name == "backspace":
                self.buffer = ""
            return None
        token = self.push(end)
        if token is None:
            return None
        lang = self.language  # a detection counts from the next word on
        found = self.detect(token)
        return token, end, applied, lang, found and found[0], found and found[1]


def evidence_of(resources: Resources, langs: list[str]) -> dict[str, tuple[int, ...]]:
    """word -> stopword weights and dictionary hits per language, sent to every task whatever the dictionary's size.

    Spark takes one applyInPandasWithState a stream, so tokens cannot be joined
    between tokenizer and detector.  Equal rows are one object, so a word costs
    little more than its text.
    """
    cols = [f"{k}_{lang}" for k in "sd" for lang in langs]
    plain = F.translate("word_enc", "AEIOUNWBCDFGJL", "áéíóúñüãõçâêôà")
    out, rows = {}, {}
    for batch in word_evidence(resources.stopwords, resources.dictionary, langs).select(plain.alias("w"), *cols).toArrow().to_batches():
        for word, *row in zip(*[c.to_pylist() for c in batch.columns]):
            out[word] = rows.setdefault(tuple(row), tuple(row))
    return out


def stream_tokens(events: DataFrame, device: str, resources: Resources | None, initial: str, order: str = "seq", window: str = "window_id", config: DetectorConfig = DetectorConfig(), limit: int = 64) -> DataFrame:
    """Tokens of a stream of key events, with the language that each is to be corrected in.

    State per device: buffer, word window, language, focused window.  Events of
    a micro-batch are taken in order of ``order``; later batches continue.
    """
    langs = resources.languages() if resources else []
    evidence = events.sparkSession.sparkContext.broadcast(evidence_of(resources, langs) if resources and langs else {})

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = KeyState(initial, limit, config, evidence.value, langs)
        if state.exists:
            s.restore(state.get[0])
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("ord", kind="stable").drop_duplicates("ord")  # delivered again
        out = []
        for o, w, kind, ch, k in zip(pdf["ord"], pdf["win"], pdf["kind"], pdf["ch"], pdf["key"]):
            got = s.step(int(w), kind, ch, k)
            if got is not None:
                out.append((key[0], int(o), *got))
        state.update((s.save(),))
        yield pd.DataFrame(out, columns=["device", "ord", "token", "delimiter", "applied", "lang", "detected", "confidence"])

    e = events.where(F.col(device).isNotNull() & F.col(order).isNotNull()).select(
        F.col(device).cast("long").alias("device"), F.col(order).cast("long").alias("ord"), F.coalesce(F.col(window).cast("long"), F.lit(0)).alias("win"), "kind", "ch", "key"
    )
    return e.groupBy("device").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def correct_stream(tokens: DataFrame, resources: Resources, sink: Callable[[DataFrame, int], None], checkpoint: str, config: CorrectionConfig = CorrectionConfig()):
    """Starts a query that corrects each micro-batch of tokens and gives the edits to ``sink``.

    Edits: (device, ord, backspaces, insert_text).
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        done = correct_tokens(batch, resources, config, ("device", "ord")).where(F.col("corrected").isNotNull() & F.col("applied"))
        sink(done.select("device", "ord", (F.length("token") + 1).alias("backspaces"), F.concat("corrected", "delimiter").alias("insert_text")), number)
        batch.unpersist()

    return tokens.writeStream.foreachBatch(one).outputMode("append").option("checkpointLocation", checkpoint).start()


def counts_per_window(events: DataFrame, at: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An addition for operations: events per time window and kind, with a watermark for late ones."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "kind").agg(F.count(F.lit(1)).alias("events"))


def typing_sessions(events: DataFrame, at: str = "ts", gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """An addition for operations: sessions of a window by inactivity, with a watermark."""
    return events.withWatermark(at, late).groupBy("window_id", F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("events"))
