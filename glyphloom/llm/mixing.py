"""Mixing sources to target weights of the total size.

Capped water-filling: every source asks for its share of the total; a source
that would need more than its maximum repetitions is clamped there, and what it
cannot give is spread over the others in proportion to their weights, until all
fit.  A source's repetitions are then a whole number for all its documents and
one more for a seeded draw of them whose size is the fractional part, to within
one document.

Defined results
---------------
* Sources without a target, and null sources, take no part (share 0).
* A target that is null or not above 0, or a maximum below 1 or null, gives
  nothing; weights are scaled to sum 1.  A target source without documents is
  clamped at 0.  If all are clamped, the total is what all can give.
* ``total`` defaults to the size of all documents of target sources.
* Rows repeated in full are one document.  Documents of size 0 cost nothing and
  go with the draw.  Ties of the draw go by hash, then id, then size.
* Empty input: no documents, shares 0.  Extra columns and clashing names are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.session import cut_lineage

#: Buckets of the draw per source; only the bucket in which the draw ends is sorted.
BUCKETS = 1 << 14


def water_fill(weights: dict[str, float], limits: dict[str, float], total: float) -> dict[str, float]:
    """Amount of each source: proportional to its weight, at most its limit, in sum ``total`` where possible."""
    out = dict.fromkeys(weights, 0.0)
    open_ = {s for s, w in weights.items() if w > 0 and limits.get(s, 0) > 0}
    left = float(total)
    while open_ and left > 0:
        scale = sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] / scale * left >= limits[s]}
        if not full:
            for s in open_:
                out[s] = weights[s] / scale * left
            break
        for s in full:
            out[s] = float(limits[s])
        left = max(0.0, total - sum(out.values()))
        open_ -= full
    return out


def mix(sizes: DataFrame, targets: list[tuple[str, float, int]], total: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Chosen documents (id, source, tokens, repeats), and shares per target source.

    ``sizes``: (id, source, tokens).  ``targets``: (source, weight, most repetitions).
    """
    spark = sizes.sparkSession
    weights = {s: max(0.0, float(w or 0)) for s, w, _ in targets if s is not None}
    most = {s: max(0, int(m or 0)) for s, _, m in targets if s is not None}
    scale = sum(weights.values()) or 1.0
    d = cut_lineage(
        sizes.where(F.col("source").isin(list(weights)) & F.col("tokens").isNotNull())
        .select("id", "source", "tokens")
        .distinct()
        .withColumn("h", F.xxhash64("id", "tokens", F.lit(seed)))
        .withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    )
    # at most one row per target source and bucket
    by_bucket = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    size = {r["source"]: r["t"] for r in by_bucket.groupBy("source").agg(F.sum("t").alias("t")).collect()}
    total = sum(size.values()) if total is None else total
    amount = water_fill({s: w / scale for s, w in weights.items()}, {s: size.get(s, 0) * most[s] for s in weights}, total)
    plan = []
    for s in weights:
        whole, rest = divmod(amount[s], size[s]) if size.get(s) else (0, 0.0)
        if size.get(s) and size[s] - rest < 0.5:
            whole, rest = whole + 1, 0.0
        plan.append((s, int(whole), float(rest)))
    frame = F.broadcast(spark.createDataFrame(plan, "source string, whole int, rest double"))  # one row per target
    cum = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        by_bucket.join(frame, "source")
        .withColumn("before", F.coalesce(F.sum("t").over(cum), F.lit(0)))
        .where("rest > 0 and before < rest and before + t >= rest")
        .select("source", F.col("bucket").alias("edge"), "before")
    )
    edges = F.broadcast(spark.createDataFrame([(r["source"], r["edge"], r["before"]) for r in edge.collect()], "source string, edge long, before long"))
    d = d.join(frame, "source").join(edges, "source", "left")
    in_order = Window.partitionBy("source").orderBy("h", "id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        d.where("bucket = edge")
        .withColumn("cum", F.col("before") + F.coalesce(F.sum("tokens").over(in_order), F.lit(0)))
        .withColumn("repeats", F.col("whole") + F.when(F.col("cum") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    )
    rest = d.where("edge is null or bucket <> edge").withColumn("repeats", F.col("whole") + F.when(F.col("bucket") < F.col("edge"), 1).otherwise(0))
    cols = ["id", "source", "tokens", "repeats"]
    chosen = rest.select(*cols).unionByName(last.select(*cols)).where("repeats > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.count(F.lit(1)).alias("documents"))
    base = spark.createDataFrame([(s, weights[s] / scale, most[s], int(size.get(s, 0))) for s in weights], "source string, target_share double, max_repeats int, source_tokens long")
    shares = F.broadcast(base).join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "source_tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
    )
    everything = F.sum("mixed_tokens").over(Window.partitionBy())
    shares = shares.withColumn("actual_share", F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(0.0))
    return chosen, shares.withColumn("repetitions", F.when(F.col("source_tokens") > 0, F.col("mixed_tokens") / F.col("source_tokens")).otherwise(0.0))
