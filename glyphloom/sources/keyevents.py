"""Key events: sources (files, streams, simulated), keycode tables, edit sinks.

Operating-system hooks are not part of a cluster engine; what they deliver is
read from files or a stream with ``schemas.KEY_EVENT``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom import schemas

# Digits with Shift, in the order 1234567890.
SHIFTED_DIGITS = "!@#$%^&*()"

# Virtual key code (hex), plain character, character with Shift.
WINDOWS_PUNCTUATION = """
BD - _
BE = +
DB [ {
DC \\ |
DD ] }
DE ' "
BF / ?
C0 ` ~
BA ; :
BC , <
BB . >
"""

# Special keys per platform and their key codes.
SPECIAL_CODES = {
    "windows": "Enter=0x0D Tab=0x09 Backspace=0x08 Delete=0x2E Escape=0x1B Home=0x24 End=0x23 PageUp=0x21 PageDown=0x22 ArrowUp=0x26 ArrowDown=0x28 ArrowLeft=0x25 ArrowRight=0x27",
    "linux": "Enter=36 Tab=23 Backspace=22 Delete=119 Escape=9 Home=110 End=115 PageUp=112 PageDown=117 ArrowUp=111 ArrowDown=116 ArrowLeft=113 ArrowRight=114",
    "macos": "Enter=0x24 Tab=0x30 Backspace=0x33 Delete=0x75 Escape=0x35 Home=0x73 End=0x77 PageUp=0x74 PageDown=0x79 ArrowUp=0x7E ArrowDown=0x7D ArrowLeft=0x7B ArrowRight=0x7C",
}

#: First key code of the letters, of the digit row (and its first digit), and the space bar.
_LAYOUT = {"windows": (0x41, 0x30, "0123456789", 0x20), "linux": (38, 10, "1234567890", 65), "macos": (0x00, 0x1D, "1234567890", 0x31)}


def keymap_rows(platform: str) -> list[tuple]:
    """(platform, code, shift, caps_lock, ch, key) for every key and modifier state."""
    letters, digit_at, digits, space = _LAYOUT[platform]
    special = {int(c, 0): k for k, c in (x.split("=") for x in SPECIAL_CODES[platform].split())}
    rows = {}
    for shift in (False, True):
        for caps in (False, True):
            chars = {letters + i: chr((65 if shift != caps else 97) + i) for i in range(26)}
            for i, d in enumerate(digits):
                chars.setdefault(digit_at + i, SHIFTED_DIGITS["1234567890".index(d)] if shift else d)
            if platform == "windows":
                chars |= {0x60 + i: str(i) for i in range(10)}
                for line in WINDOWS_PUNCTUATION.split("\n"):
                    if line:
                        code, plain, shifted = line.split(" ")
                        chars[int(code, 16)] = shifted if shift else plain
            chars[space] = " "
            for code, ch in chars.items():
                if code not in special:
                    rows[code, shift, caps] = (platform, code, shift, caps, ch, None)
            for code, key in special.items():
                rows[code, shift, caps] = (platform, code, shift, caps, None, key)
    return [rows[k] for k in sorted(rows)]


def keymap(spark: SparkSession, platform: str) -> DataFrame:
    return spark.createDataFrame(keymap_rows(platform), "platform string, code int, shift boolean, caps_lock boolean, ch string, key string")


def decode_keycodes(codes: DataFrame, platform: str) -> DataFrame:
    """``codes`` (code, shift, caps_lock, ...) with kind, ch and key; unknown codes are dropped."""
    m = keymap(codes.sparkSession, platform).drop("platform")  # a few hundred rows by construction
    return codes.join(F.broadcast(m), ["code", "shift", "caps_lock"]).withColumn("kind", F.when(F.col("ch").isNotNull(), "Char").otherwise("Special"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.KEY_EVENT).parquet(path)


def stream_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Key events from files as they arrive."""
    return spark.readStream.schema(schemas.KEY_EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def create_source(spark: SparkSession, mode: str, path: str | None = None) -> DataFrame:
    """Source by mode: ``batch``, ``stream``, or ``disabled`` (no events)."""
    if mode == "disabled":
        return spark.createDataFrame([], schemas.KEY_EVENT)
    if path is None:
        raise ValueError("this source needs a path")
    if mode == "batch":
        return read_events(spark, path)
    if mode == "stream":
        return stream_events(spark, path)
    raise ValueError(f"unknown source mode {mode!r}")


def simulate(spark: SparkSession, script: Iterable[tuple[int, str]], step_ms: int = 100) -> DataFrame:
    """Events from (window, key) pairs: one character, or a key name in angle brackets.

    ``[(1, "a"), (1, "<Backspace>")]``; numbered and timed in order.
    """
    rows, t0 = [], dt.datetime(2024, 1, 1)
    for i, (window, k) in enumerate(script):
        name = k[1:-1] if len(k) > 2 and k[0] == "<" else None
        kind = "Char" if name is None else "Control" if name in schemas.CONTROL_KEYS else "Special"
        rows.append((i, window, i, t0 + dt.timedelta(milliseconds=i * step_ms), kind, None if name else k, name, (False, False, False, False)))
    return spark.createDataFrame(rows, schemas.KEY_EVENT)


def edit_sink(edits: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a streaming query that gives every micro-batch of edits to ``send(batch, number)``."""
    return edits.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).start()
