"""Joining detail rows to one row per key when some keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the broadcast side in ``attach_by_key``.  Any key outside the
#: ``HEAVY_KEYS`` largest holds less than 1 / HEAVY_KEYS of the rows, so it
#: cannot make a straggler; the broadcast is at most this many rows.
HEAVY_KEYS = 1000
#: Up to so many groups are broadcast whole by ``attach_known``: some ten MB of words.
SMALL_GROUPS = 100_000


def attach_by_key(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    payload: Sequence[str],
    weight: str,
    spread: Sequence[str],
    heavy_keys: int = HEAVY_KEYS,
    merge: bool = False,
) -> DataFrame:
    """Left join ``rows`` to ``groups`` (one row per key), safe for hot keys.

    ``weight`` is the column of ``groups`` that says how many detail rows the
    key has.  The ``heavy_keys`` heaviest groups are broadcast (a proven bound,
    whatever the data size); their detail rows then take part in the shuffled
    join under a key made from ``spread`` (columns that tell rows apart), so
    they scatter over all partitions and match nothing there.  All other keys
    go through the ordinary shuffled join.  Every row comes out exactly once;
    rows whose key is null or unknown get null payload columns.  ``merge``: the
    other keys are never broadcast, even where Spark takes them for small.
    """
    keys, payload = list(keys), list(payload)
    heavy = (
        groups.orderBy(F.col(weight).desc(), *[F.col(k).asc() for k in keys])
        .limit(heavy_keys)
        .select(*[F.col(k).alias(f"_hk_{k}") for k in keys], *[F.col(p).alias(f"_hp_{p}") for p in payload], F.lit(True).alias("_heavy"))
    )
    light = groups.select(
        *[F.col(k).alias(f"_lk_{k}") for k in keys], *[F.col(p).alias(f"_lp_{p}") for p in payload], F.lit(0).cast("long").alias("_lk_salt")
    )
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"_hk_{k}")
        cond = c if cond is None else cond & c
    one = rows.join(F.broadcast(heavy), cond, "left")
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    # never 0 for scattered rows, so that they cannot match
    salt = F.when(F.col("_heavy") | any_null, F.greatest(F.pmod(F.xxhash64(*spread), F.lit(1 << 40)), F.lit(1))).otherwise(F.lit(0)).cast("long")
    one = one.withColumn("_salt", salt)
    cond = F.col("_salt") == F.col("_lk_salt")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_lk_{k}"))
    two = one.join(light.hint("merge") if merge else light, cond, "left")
    return two.select(
        *[F.col(c) for c in rows.columns],
        *[F.coalesce(F.col(f"_hp_{p}"), F.col(f"_lp_{p}")).alias(p) for p in payload],
    )


def attach_known(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    payload: Sequence[str],
    weight: str,
    spread: Sequence[str],
    small: int = SMALL_GROUPS,
) -> DataFrame:
    """``attach_by_key`` without a shuffle of ``rows`` where there are few groups.

    ``groups`` should have its lineage cut (it is counted first) and only keys
    that occur.  Up to ``small`` of them are broadcast, more take the way of
    ``attach_by_key``, where they are merged: just below Spark's threshold they
    would be broadcast after all.  The rows that come out are the same.
    """
    if groups.count() > small:
        return attach_by_key(rows, groups, keys, payload, weight, spread, merge=True)
    known = groups.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(p).alias(f"_p_{p}") for p in payload])
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return rows.join(F.broadcast(known), cond, "left").select(*[F.col(c) for c in rows.columns], *[F.col(f"_p_{p}").alias(p) for p in payload])
