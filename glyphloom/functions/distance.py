"""Edit distances: unrestricted Damerau, keyboard-weighted Damerau, character overlap.

The scalar functions are plain Python on code points; the column versions are
Arrow UDFs meant for candidate pairs that built-in filters have thinned out.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Neighbouring keys of a QWERTY keyboard, as unordered pairs.
ADJACENT_KEYS = """
qw we er rt ty yu ui io op
as sd df fg gh hj jk kl
zx xc cv vb bn nm
qa ws ed rf tg yh uj ik ol
az sx dc fv gb hn jm
wa es rd tf yg uh ij ok pl
sz dx fc gv hb jn km
"""
_NEAR = {frozenset(p) for p in ADJACENT_KEYS.split()}

#: Most cells of a whole distance table; larger ones are filled near the diagonal only.
MAX_CELLS = 1_000_000


def key_cost(a: str, b: str) -> int:
    """0 for the same character, 5 for neighbouring keys (ASCII case aside), else 10."""
    if a == b:
        return 0
    low = lambda c: c.lower() if c.isascii() else c
    return 5 if frozenset((low(a), low(b))) in _NEAR else 10


def _table(a: str, b: str, unit: int, substitute) -> int:
    """Unrestricted Damerau distance: insert, delete and swap cost ``unit``.

    A swap may have characters between its two letters, each at ``unit``.
    """
    width = len(b) + 1
    rows = [[j * unit for j in range(width)]]
    seen: dict[str, int] = {}  # character of a -> last row (1-based) that has it
    for i, x in enumerate(a, 1):
        above, here, match = rows[-1], [i * unit], 0
        for j, y in enumerate(b, 1):
            cost = substitute(x, y)
            least = min(above[j - 1] + cost, above[j] + unit, here[j - 1] + unit)
            k = seen.get(y, 0)
            if k and match:
                swap = rows[k - 1][match - 1] + (i - k + j - match - 1) * unit
                if swap < least:
                    least = swap
            here.append(least)
            if cost == 0:
                match = j
        rows.append(here)
        seen[x] = i
    return rows[-1][-1]


def _band(a: str, b: str, limit: int) -> int:
    """Unrestricted Damerau distance, at most ``limit + 1``: cells farther than ``limit`` from the diagonal are above it."""
    top = limit + 1
    rows = [{j: j for j in range(min(len(b), limit) + 1)}]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        above, here, match = rows[-1], {0: i} if i <= limit else {}, 0
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            y = b[j - 1]
            least = min(above.get(j - 1, top) + (x != y), above.get(j, top) + 1, here.get(j - 1, top) + 1)
            k = seen.get(y, 0)
            if k and match:
                least = min(least, rows[k - 1].get(match - 1, top) + i - k + j - match - 1)
            here[j] = min(least, top)
            if x == y:
                match = j
        rows.append(here)
        seen[x] = i
    return rows[-1].get(len(b), top)


def _cut_ends(a: str, b: str) -> tuple[str, str]:
    """What is left when common beginnings and ends are cut off; they cost nothing."""
    first, last = 0, min(len(a), len(b))
    while first < last and a[first] == b[first]:
        first += 1
    end = 0
    while end < last - first and a[-1 - end] == b[-1 - end]:
        end += 1
    return a[first : len(a) - end], b[first : len(b) - end]


def _few(a: str, b: str, limit: int) -> int:
    """Unrestricted Damerau distance for limits up to 2, at most ``limit + 1``.

    Where two words differ first, one of few things happened: a letter was
    added, dropped, replaced or swapped with its neighbour, or (for two) a swap
    has one letter more on one side.  Each is tried with what is left of the limit.
    """
    a, b = _cut_ends(a, b)
    m, n = len(a), len(b)
    if not m or not n:
        return min(m + n, limit + 1)
    if limit == 0 or abs(m - n) > limit:
        return limit + 1
    best = limit
    left = limit - 1
    if m > 1 and n > 1 and a[0] == b[1] and a[1] == b[0]:
        best = min(best, _few(a[2:], b[2:], left))
    best = min(best, _few(a[1:], b[1:], left), _few(a[1:], b, left), _few(a, b[1:], left))
    if limit == 2 and best == 2:
        if m > 1 and n > 2 and a[0] == b[2] and a[1] == b[0]:
            best = min(best, 1 + _few(a[2:], b[3:], 0))
        if m > 2 and n > 1 and a[0] == b[1] and a[2] == b[0]:
            best = min(best, 1 + _few(a[3:], b[2:], 0))
    return best + 1


def damerau(a: str, b: str, limit: int) -> int:
    """Unrestricted Damerau distance, at most ``limit + 1``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if limit <= 2:
        return _few(a, b, limit)
    a, b = _cut_ends(a, b)
    if not a or not b:
        return min(len(a) + len(b), limit + 1)
    if (len(a) + 1) * (len(b) + 1) > MAX_CELLS:
        return _band(a, b, limit)
    return min(_table(a, b, 1, lambda x, y: int(x != y)), limit + 1)


def within(a: str, b: str, limit: int) -> bool:
    return damerau(a, b, limit) <= limit


def keyboard_distance(a: str, b: str, limit: int) -> int:
    """Damerau distance times ten with neighbouring keys at 5, at most ``10 * limit + 1``."""
    top = 10 * limit + 1
    if not a or not b:
        return min(10 * (len(a) + len(b)), top)
    if abs(len(a) - len(b)) * 10 > 10 * limit:
        return top
    return min(_table(a, b, 10, key_cost), top)


def overlap_ok(a: str, b: str) -> bool:
    """At least 60 % of the longer word's characters are shared (any, up to two letters)."""
    longest = max(len(a), len(b))
    if longest == 0:
        return False
    shared = sum((Counter(a) & Counter(b)).values())
    return shared > 0 if longest <= 2 else 5 * shared >= 3 * longest


def _pairwise(fn, kind):
    @F.pandas_udf(kind)
    def udf(a: pd.Series, b: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or m is None else fn(x, y, int(m)) for x, y, m in zip(a, b, limit)], dtype=object)

    return udf


def damerau_col(a: Column, b: Column, limit: int | Column) -> Column:
    return _pairwise(damerau, "int")(a, b, limit if isinstance(limit, Column) else F.lit(limit))


def keyboard_distance_col(a: Column, b: Column, limit: int | Column) -> Column:
    return _pairwise(keyboard_distance, "int")(a, b, limit if isinstance(limit, Column) else F.lit(limit))


def shared_characters(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two words' characters, with built-ins."""
    ca, cb = [F.array_remove(F.split(x, ""), "") for x in (a, b)]  # an empty word splits into one empty string
    count = lambda xs, c: F.size(F.filter(xs, lambda x: x == c))
    return F.aggregate(F.array_intersect(ca, cb), F.lit(0), lambda acc, c: acc + F.least(count(ca, c), count(cb, c)))


def overlap_ok_col(a: Column, b: Column) -> Column:
    """``overlap_ok`` with built-ins."""
    longest = F.greatest(F.length(a), F.length(b))
    shared = shared_characters(a, b)
    return F.when(longest == 0, False).when(longest <= 2, shared > 0).otherwise(5 * shared >= 3 * longest)


def register_sql(spark) -> None:
    """SQL functions damerau_distance, keyboard_distance, char_overlap_ok."""
    spark.udf.register("damerau_distance", _pairwise(damerau, "int"))
    spark.udf.register("keyboard_distance", _pairwise(keyboard_distance, "int"))

    @F.pandas_udf("boolean")
    def char_overlap_ok(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else overlap_ok(x, y) for x, y in zip(a, b)], dtype=object)

    spark.udf.register("char_overlap_ok", char_overlap_ok)
