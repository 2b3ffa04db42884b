"""Accent and case folding; built-in functions wherever a string has no mark to compose."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@cache
def accent_table() -> tuple[str, str]:
    """Composed Latin, Greek and Cyrillic letters, and what is left without accents.

    Built by rule from the canonical decompositions of the running Python.
    """
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_all_accents(c: Column) -> Column:
    """Accents removed, composed or combining; letters without a decomposition stay."""
    src, dst = accent_table()
    return F.regexp_replace(F.translate(c, src, dst), r"\p{M}+", "")


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: Strings that may not be in composed form: marks, jamo, and letters whose composed form is another letter.
_OPEN = r"[\p{M}\u1100-\u11FF\u0340-\u037E\u0387\u0958-\u0BFF\u0F43-\u0FB9\u1F71-\u1FFD\u2000-\u2001\u2126-\u212B\u2329\u232A\u2ADC\uF900-\uFB4E\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"


def compose_accents(c: Column) -> Column:
    """Composed form (NFC) of every script; Python sees only the strings that may differ from theirs."""
    may = c.rlike(_OPEN)
    return F.when(may, _composed(F.when(may, c))).otherwise(c)


def fold_word(c: Column) -> Column:
    """Letters and digits only, lower case, without accents."""
    return F.regexp_replace(strip_all_accents(F.lower(c)), r"[^\p{L}\p{N}]+", "")
