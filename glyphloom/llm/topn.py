"""Top N items within every group, for millions of groups and groups of any size.

1. A histogram of a coarse score per group: items fall into ``3 * n`` buckets
   by hash, and each bucket's first coarse value is kept (map-side combined,
   one row per group and task).  Different buckets hold different items, so the
   n-th smallest of these values is a safe limit: at least n items of the group
   are at or below it, and items above it cannot be among the first n.
2. Rows above their group's limit are filtered out where they are, before any
   of them is shuffled.  The ``HEAVY_KEYS`` largest groups get their own limits
   by broadcast; all others get the limit of their slot, of ``SLOTS`` in all,
   which is the loosest limit of the groups in it.  Both tables have a fixed
   bound, whatever the data; a loose limit only lets more rows through.
3. Each item that is left counts once per group, with its best row.
4. The survivors are ranked exactly with all tie keys.  Each task's rows are cut
   to n per group before the last exchange, so even a group of ties only sends n
   rows per task.  For n above Spark's own bound for that (1000) the rows of a
   group are cut within salted parts first.

Defined results
---------------
* Rows with a null group or item, or without a score, are left out.
* Equal scores go by the item, ascending by bytes, so the result is one and the
  same whatever the order of rows; repeated rows change nothing.
* Groups with fewer than N items give all of them.  Empty input: no rows.
* Groups are compared exactly as written (no trimming, letter case counts).
* Extra columns and clashing names are harmless: only named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.skew import HEAVY_KEYS


def log2_bin(c: Column) -> Column:
    """Coarse bin of a count, larger counts first; null after everything else."""
    return F.when(c.isNull(), 65).when(c < 1, 64).otherwise(63 - F.floor(F.log2(c.cast("double")))).cast("long")


#: Slots of the limits of all but the largest groups.
SLOTS = 1 << 18
#: Largest n whose histogram has a column per bucket; beyond it, a row per bucket.
WIDE = 8
#: Largest n that Spark cuts tasks to by itself, and parts of a group beyond it.
SPARK_LIMIT, PARTS = 1000, 64


def _limits(raw: DataFrame, n: int) -> DataFrame:
    """(g, last_bin, items): each group's safe limit, null where n items are not certain, and its number of rows."""
    buckets = 3 * n
    bucket = F.pmod(F.xxhash64("i", F.lit("bucket")), F.lit(buckets))
    nth = lambda mins: F.get(F.sort_array(F.filter(mins, lambda x: x.isNotNull())), F.lit(n - 1))
    if n <= WIDE:
        wide = raw.groupBy("g").agg(F.count(F.lit(1)).alias("items"), *[F.min(F.when(bucket == k, F.col("bin"))).alias(f"m{k}") for k in range(buckets)])
        return wide.select("g", nth(F.array(*[f"m{k}" for k in range(buckets)])).alias("last_bin"), "items")
    long = raw.groupBy("g", bucket.alias("k")).agg(F.min("bin").alias("m"), F.count(F.lit(1)).alias("c"))
    return long.groupBy("g").agg(F.collect_list("m").alias("ms"), F.sum("c").alias("items")).select("g", nth(F.col("ms")).alias("last_bin"), "items")


def top_n(rows: DataFrame, group: str, item: str, score: list[Column], coarse: Column, n: int) -> DataFrame:
    """(group, item, rank, s0, s1, ...): the first ``n`` items of each group.

    ``score``: columns whose ascending order (nulls are not allowed; encode
    them) ranks the items.  ``coarse``: an integer that never falls while the
    score rises, written in terms of ``s0``, ``s1``, ...
    """
    names = [f"s{i}" for i in range(len(score))]
    raw = (
        rows.select(F.col(group).alias("g"), F.col(item).alias("i"), F.struct(*[c.alias(k) for c, k in zip(score, names)]).alias("s"))
        .where("g is not null and i is not null and " + " and ".join(f"s.{k} is not null" for k in names))
        .select("g", "i", "s.*")
        .withColumn("bin", coarse)
    )
    slot = lambda g: F.pmod(F.xxhash64(g, F.lit("slot")), F.lit(SLOTS))
    limits = _limits(raw, n)
    heavy = limits.where("last_bin is not null").orderBy(F.col("items").desc(), "g").limit(HEAVY_KEYS).select(F.col("g").alias("_g"), F.col("last_bin").alias("_own"))
    slots = limits.groupBy(slot("g").alias("_slot")).agg(F.max("last_bin").alias("_loose"), F.count(F.when(F.col("last_bin").isNull(), 1)).alias("_open")).where("_open = 0")
    kept = raw.join(F.broadcast(heavy), F.col("g") == F.col("_g"), "left").join(F.broadcast(slots), slot("g") == F.col("_slot"), "left")
    limit = F.coalesce("_own", "_loose")
    kept = kept.where(limit.isNull() | (F.col("bin") <= limit))
    best = kept.groupBy("g", "i").agg(F.min(F.struct(*names)).alias("s")).select("g", "i", "s.*")
    order = [*names, "i"]
    if n > SPARK_LIMIT:
        part = F.pmod(F.xxhash64("i", F.lit("part")), F.lit(PARTS))
        best = best.withColumn("_k", F.row_number().over(Window.partitionBy("g", part).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
    rank = F.row_number().over(Window.partitionBy("g").orderBy(*order))
    return best.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("g").alias(group), F.col("i").alias(item), "rank", *names)
