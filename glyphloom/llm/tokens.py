"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary file is; the file is not part of this repository.
VOCABULARY = os.environ.get("GLYPHLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

#: The split pattern that goes with the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str):
    """One encoder per worker process and file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space as the split pattern understands it; longer runs are cut out, as the pattern's look-ahead recurses over them.
LONG_BLANK = 10_000
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def encode_length(e, text: str, longest: int = LONG_BLANK) -> int:
    """Number of tokens of a text of any length.

    A long run of white space is one piece, but for its last character if
    something follows, which begins the next piece: exactly what the split
    pattern makes of it.
    """
    if len(text) < longest:
        return len(e.encode_ordinary(text))
    n = at = 0
    for m in re.finditer(f"{_BLANK}{{{longest},}}", text):
        end = m.end() - (m.end() < len(text))
        n += len(e.encode_ordinary(text[at : m.start()])) + len(e._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(e.encode_ordinary(text[at:]))


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    return encode_length(encoding(path), text)


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens; null for a null text, 0 for an empty one."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        e = encoding(path)
        return pd.Series([None if t is None else encode_length(e, t) for t in s], dtype="Int64")

    # so marked, a filter on the number is not pushed below it, which would encode every text once more
    return count.asNondeterministic()(text)


def document_sizes(docs: DataFrame, id_col: str, text: str, keep: list[str] | None = None, path: str = VOCABULARY) -> DataFrame:
    """(id, tokens, copies, kept columns): one row per distinct sized row; null texts are left out.

    Rows repeated in full (id, size, kept columns) become one row with their number.
    """
    kept = keep or []
    d = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), *kept, token_count(F.col(text), path).alias("tokens"))
    return d.groupBy("id", "tokens", *kept).agg(F.count(F.lit(1)).alias("copies"))
