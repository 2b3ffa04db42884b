"""Filling containers of fixed capacity with items, with little unused space.

First-fit decreasing with a tournament tree over the containers' free space,
run independently in groups that a seeded hash draws; a group holds about
``GROUP_ITEMS`` items, so work per task does not grow with the data, and each
group wastes at most a few half-empty containers.

Defined results
---------------
* An item above the capacity is cut into pieces of exactly the capacity and a
  rest; other items are never cut.  ``first_token`` says where a piece begins.
* Items of size 0 take no room and go with others; null sizes are left out.
* Equal sizes go by id and piece, so the result is the same for any row order.
* Rows repeated in full are packed once each (as copy 1, 2, ...).
* Capacities that are null or below 1 are left out; equal capacities under
  several pack ids are packed for each.  Empty input: no rows.
* Extra columns and clashing names are harmless: only named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.session import cut_lineage

#: Items per group on average.
GROUP_ITEMS = 20_000


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item; sizes must come in descending order.

    The tree's inner nodes hold the largest free space below them; going left
    wherever it suffices finds the first container that fits in log time.
    """
    n = min(len(sizes), 2 * sum(sizes) // capacity + 2)  # never needs more containers than this
    leaves = 1
    while leaves < n:
        leaves *= 2
    free = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        k = 1
        while k < leaves:
            k *= 2
            if free[k] < size:
                k += 1
        out.append(k - leaves)
        free[k] -= size
        k //= 2
        while k:
            top = free[2 * k] if free[2 * k] >= free[2 * k + 1] else free[2 * k + 1]
            if free[k] == top:
                break
            free[k] = top
            k //= 2
    return out


def pack(sizes: DataFrame, capacities: list[tuple[int, int]], seed: int = 7, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(pack_id, container, id, copy, piece, first_token, tokens, start): contents of every container.

    ``sizes``: (id, tokens, copies).  ``capacities``: (pack_id, capacity).
    ``start`` is the piece's place in its container.
    """
    caps = [(int(p), int(c)) for p, c in capacities if p is not None and c is not None and c > 0]
    sizes = cut_lineage(sizes.where("tokens is not null").select("id", "tokens", "copies"))
    kind = dict(sizes.dtypes)["id"]
    schema = f"pack_id int, container string, id {kind}, copy long, piece long, first_token long, tokens long, start long"
    if not caps:
        return sizes.sparkSession.createDataFrame([], schema)
    pieces = lambda cap: F.greatest(F.ceil(F.col("tokens") / F.lit(cap)), F.lit(1)).cast("long")
    totals = sizes.agg(*[F.sum(pieces(c) * F.col("copies")).alias(f"n{i}") for i, (_, c) in enumerate(caps)]).first()
    packs = F.explode(
        F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).cast("long").alias("cap"), F.lit(max(1, -(-(totals[f"n{i}"] or 0) // group_items))).cast("long").alias("groups")) for i, (p, c) in enumerate(caps)])
    )
    items = (
        sizes.select("id", "tokens", "copies", packs.alias("k"))
        .select("id", "tokens", "k.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr("(tokens + cap - 1) div cap"), F.lit(1)) - 1)).alias("piece"))
        .select(
            "pack_id", "cap", "id", "copy", "piece", (F.col("piece") * F.col("cap")).alias("first_token"),
            F.least(F.col("cap"), F.col("tokens") - F.col("piece") * F.col("cap")).alias("size"),
            F.pmod(F.xxhash64("id", "copy", "piece", F.lit(seed)), F.col("groups")).alias("grp"),
        )
    )

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "copy", "piece"], ascending=[False, True, True, True], kind="stable")
        at = np.array(first_fit_decreasing(pdf["size"].tolist(), int(pdf["cap"].iloc[0])), dtype=np.int64)
        order = np.argsort(at, kind="stable")
        pdf, at = pdf.iloc[order], at[order]
        size = pdf["size"].to_numpy()
        before = np.cumsum(size) - size
        first = np.r_[True, at[1:] != at[:-1]]
        start = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(at)]))
        return pd.DataFrame({"pack_id": pdf["pack_id"].to_numpy(), "container": [f"{key[1]}-{b}" for b in at.tolist()], "id": pdf["id"].to_numpy(), "copy": pdf["copy"].to_numpy(), "piece": pdf["piece"].to_numpy(), "first_token": pdf["first_token"].to_numpy(), "tokens": size, "start": start})

    return items.groupBy("pack_id", "grp").applyInPandas(fill, schema)


def fill_report(packed: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """(pack_id, capacity, containers, tokens, least_containers, fill) per capacity."""
    cap = F.lit(None).cast("long")
    for p, c in capacities:
        cap = F.when(F.col("pack_id") == p, F.lit(c).cast("long")).otherwise(cap)
    per = packed.groupBy("pack_id", "container").agg(F.sum("tokens").alias("t"))
    out = per.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens")).withColumn("capacity", cap)
    return out.select("pack_id", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
