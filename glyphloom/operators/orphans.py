"""References to records that do not exist (dangling foreign keys).

``orphan_keys`` finds the distinct non-null keys without a parent by an
anti-join of distinct keys; ``key_history`` and ``orphan_references`` add the
time dimension: a key may exist but not yet, or no longer, when a row refers
to it.  ``orphan_report`` counts per table and period.

Defined results
---------------
* A null key refers to nothing and is never an orphan; a key that is blank
  after trimming is a key like any other.
* A null reference time can only yield ``missing``: without a time, a key that
  has a parent somewhere is not reported.
* A parent version with a null start is never in force.  A version whose end
  is not after its start is never in force, but its start counts as an arrival.
* Repeated child rows are reported once per row; repeated parent rows change
  nothing.
* Empty parents make every non-null key ``missing``; empty children give no row.
* Extra columns and clashing names are harmless: only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.session import cut_lineage
from glyphloom.skew import attach_by_key

#: Stands for a null time, which cannot be a join key: before every other.
_NEVER = "timestamp '0001-01-01'"


def fold_key(c: Column) -> Column:
    """Letter case and outer white space (any Unicode white space) disregarded."""
    # the look-behind lets a run inside the text be tried once, not once per character
    return F.lower(F.regexp_replace(c, r"^\p{IsWhite_Space}+|(?<!\p{IsWhite_Space})\p{IsWhite_Space}+$", ""))


def orphan_keys(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Distinct non-null child keys that no parent has: ``key``.

    Both sides are reduced to distinct keys before the anti-join, so a key that
    a third of all rows refer to costs one row in the join.
    """
    c = children.select(F.col(child_key).alias("key")).where("key is not null").distinct()
    p = parents.select(F.col(parent_key).alias("key")).where("key is not null").distinct()
    return c.join(p, "key", "left_anti")


_ZERO = "cast(0 as bigint)"


def _status_of_pairs(pairs: DataFrame, versions: DataFrame, missing: DataFrame) -> DataFrame:
    """(key, at, n, status) of the distinct questions (key, at, n) that find no parent in force.

    As-of sweep: starts (+1), ends (-1), the marks of missing keys and the
    questions are put on one time line per key and summed up.  The line is cut
    by range of (key, time) into pieces of about equal size, so even a key and
    period that a third of all rows refer to is spread over tasks; what earlier
    pieces leave over of a key is carried by at most one row per piece.
    """
    live = F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start")))
    mark = lambda at, force, came: F.struct(at.alias("at"), force.cast("long").alias("force"), F.lit(came).cast("long").alias("came"))
    marks = versions.select(
        "key", F.inline(F.array(mark(F.col("start"), F.when(live, 1).otherwise(0), 1), mark(F.col("end"), F.when(live & F.col("end").isNotNull(), -1).otherwise(0), 0)))
    ).where("at is not null and (force <> 0 or came <> 0)")
    line = (
        marks.selectExpr("key", "at", "force", "came", f"{_ZERO} as gone", f"{_ZERO} as ask")
        .unionByName(pairs.selectExpr("key", "at", f"{_ZERO} as force", f"{_ZERO} as came", f"{_ZERO} as gone", "n as ask"))
        .unionByName(missing.selectExpr("key", f"{_NEVER} as at", f"{_ZERO} as force", f"{_ZERO} as came", "cast(1 as bigint) as gone", f"{_ZERO} as ask"))
    )
    sums = [F.sum(c).alias(c) for c in ("force", "came", "gone", "ask")]
    line = line.groupBy("key", "at").agg(*sums)
    # kept, so that every reader sees the same pieces
    line = cut_lineage(line.repartitionByRange("key", "at").withColumn("piece", F.spark_partition_id()))
    before = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = line.groupBy("key", "piece").agg(*sums[:3]).select(F.col("key").alias("_k"), F.col("piece").alias("_p"), *[F.sum(c).over(before).alias(f"_{c}") for c in ("force", "came", "gone")])
    carry = F.broadcast(carry.where("_force <> 0 or _came <> 0 or _gone <> 0"))  # a key goes on into a piece only as its first: one row per piece
    within = Window.partitionBy("piece", "key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    swept = line.select("key", "at", "piece", "ask", *[F.sum(c).over(within).alias(c) for c in ("force", "came", "gone")]).where("ask > 0")
    done = swept.join(carry, (F.col("piece") == F.col("_p")) & (F.col("key") == F.col("_k")), "left")
    so_far = lambda c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))
    status = (
        F.when(so_far("gone") > 0, "missing")
        .when((F.col("at") == F.expr(_NEVER)) | (so_far("force") > 0), None)
        .when(so_far("came") > 0, "deleted")
        .otherwise("later")
    )
    return done.select("key", "at", F.col("ask").alias("n"), status.alias("status")).where("status is not null")


def orphan_references(
    children: DataFrame,
    parents: DataFrame,
    child_id: str,
    child_key: Column,
    child_at: str,
    parent_key: Column,
    parent_start: str,
    parent_end: str,
) -> DataFrame:
    """(child_id, key, at, status) of the references without a parent in force.

    ``missing``: no parent has the key at any time.  ``later``: the key arrives
    only after the reference.  ``deleted``: it had arrived, but was gone.
    """
    c = children.select(F.col(child_id).alias("child_id"), child_key.alias("key"), F.col(child_at).cast("timestamp").alias("at")).where("key is not null")
    v = parents.select(parent_key.alias("key"), F.col(parent_start).cast("timestamp").alias("start"), F.col(parent_end).cast("timestamp").alias("end")).where("key is not null")
    c = c.withColumn("at", F.coalesce("at", F.expr(_NEVER)))
    pairs = c.groupBy("key", "at").agg(F.count(F.lit(1)).alias("n"))
    missing = orphan_keys(pairs, v, "key", "key")
    status = cut_lineage(_status_of_pairs(pairs, v, missing))  # the orphans only; read twice below
    out = attach_by_key(c, status, ["key", "at"], ["status"], "n", ["child_id"])
    return out.where("status is not null").select("child_id", "key", F.when(F.col("at") != F.expr(_NEVER), F.col("at")).alias("at"), "status")


def orphan_report(orphans: DataFrame, table: str, period: str = "month") -> DataFrame:
    """Counts per table, period and status: rows, and distinct keys.

    References without a time form the period null.
    """
    per_key = orphans.groupBy(F.date_trunc(period, "at").alias("period"), "status", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("period", "status").agg(F.sum("n").alias("references"), F.count(F.lit(1)).alias("keys")).select(
        F.lit(table).alias("table_name"), "period", "status", "references", "keys"
    )
