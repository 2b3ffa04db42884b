"""Schemas of inputs, resources and results."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


MODIFIERS = _struct(shift=B, ctrl=B, alt=B, caps_lock=B)
KEY_EVENT = _struct(event_id=L, window_id=L, seq=L, ts=TS, kind=S, ch=S, key=S, modifiers=MODIFIERS)

DICTIONARY = _struct(lang=S, word=S, word_enc=S, freq=L)
STOPWORDS = _struct(lang=S, word=S)
ERRORS = _struct(lang=S, typo=S, correction=S, source=S)

DETECTED = _struct(code=S, confidence=D)
TOKEN_RESULT = _struct(doc_id=L, pos=I, original=S, corrected=S, source=S, detected_language=DETECTED)
CANDIDATE = _struct(doc_id=L, pos=I, rank=I, word=S, distance=I, frequency=L, source=S)
DETECTION = _struct(doc_id=L, pos=I, language=S, confidence=D, all_scores=T.MapType(S, D))
EDIT = _struct(window_id=L, ts=TS, backspaces=I, insert_text=S)

# file formats
DICTIONARY_FILE = _struct(language=S, version=S, words=T.ArrayType(_struct(word=S, frequency=L)))
STOPWORDS_FILE = _struct(language=S, stopwords=T.ArrayType(S))
ERRORS_FILE = _struct(language=S, errors=T.MapType(S, S))

# Keys of a keyboard event.
CONTROL_KEYS = ["Shift", "Ctrl", "Alt", "CapsLock", "NumLock"]
SPECIAL_KEYS = ["Enter", "Tab", "Backspace", "Delete", "Escape", "Home", "End", "PageUp", "PageDown", "ArrowUp", "ArrowDown", "ArrowLeft", "ArrowRight"]
