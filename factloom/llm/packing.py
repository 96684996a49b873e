"""Filling containers of fixed capacity with whole texts by sum-of-squares packing (problem 9).

Each item goes where the sum, over all residual gaps, of the squared number of open containers with that gap becomes
smallest; of equal choices to the tightest. Items are packed in shards of bounded size, so that no task sees the corpus;
what the shards leave badly filled is packed again as whole blocks, in ever fewer shards. Two blocks fit together only if
one of them is at most half full, so those go on, and of the fuller ones no more than they can fill, the emptiest first:
a level's shards stay bounded whatever the sizes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut

SHARD_ITEMS = 40_000
FILL_BINS = 64


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (0, 1, ...) of each size, all between 0 and capacity, placed in the order given."""
    opened = np.zeros(capacity + 1, np.int64)  # open containers by gap
    stacks: dict[int, list[int]] = {}
    out, n = np.zeros(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0 and n:
            continue  # an empty text takes no room: it goes to the first container
        gaps = np.flatnonzero(opened[s:]) + s
        best, best_cost = -1, 2 * opened[capacity - s] + 1 if s < capacity else 0
        if len(gaps):
            before, after = opened[gaps], opened[gaps - s]
            cost = 2 * (1 - before) + np.where(gaps > s, 2 * after, -1)
            at = int(np.argmin(cost))
            if cost[at] <= best_cost:
                best = int(gaps[at])
        if best < 0:
            container, gap = n, capacity - s
            n += 1
        else:
            container, gap = stacks[best].pop(), best - s
            opened[best] -= 1
        out[i] = container
        if gap:
            opened[gap] += 1
            stacks.setdefault(gap, []).append(container)
    return out


def placing_order(items: Iterable, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Items over half the capacity first, the largest ahead, as no two of them share a container; the rest by hash,
    since the rule fills best when sizes come mixed. The order depends on the items alone."""
    names = [str(i) for i in items]
    mixed = np.array([zlib.crc32(n.encode()) for n in names], np.int64)
    big = sizes * 2 > capacity
    return np.lexsort((np.array(names, dtype=object).astype(str), np.where(big, -sizes, mixed), ~big))


def _pack_group(level: int, capacities: dict[int, int]) -> Callable:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        profile, shard = key
        pdf = pdf.iloc[placing_order(pdf["item"], pdf["n_tokens"].to_numpy(), capacities[profile])]
        box = sum_of_squares(pdf["n_tokens"].to_numpy(), capacities[profile])
        names = np.array([f"{profile}-{level}-{shard}-{b}" for b in range(int(box.max()) + 1 if len(box) else 0)], object)
        return pd.DataFrame({"profile_id": profile, "item": pdf["item"], "n_tokens": pdf["n_tokens"], "container_id": names[box]})

    return run


def _going_on(filled: DataFrame, capacities: dict[int, int], refill_below: float) -> tuple[DataFrame, int]:
    """The containers (profile_id, container_id, n_tokens) worth packing again, and about how many they are.

    All that are at most half full, and of the fuller ones as many, the emptiest first: whatever can be saved by merging
    blocks can be saved with these. The counts by profile and 64th of the capacity come to the driver.
    """
    capacity = F.create_map(*[F.lit(x) for p, c in capacities.items() for x in (p, float(c))])[F.col("profile_id")]
    share = F.col("n_tokens") / capacity
    marked = filled.filter(share < refill_below).withColumn("bin", F.when(share <= 0.5, -1).otherwise(F.floor(share * FILL_BINS).cast("int")))
    counts: dict[int, dict[int, int]] = {p: {} for p in capacities}
    for r in marked.groupBy("profile_id", "bin").count().collect():
        counts[r["profile_id"]][r["bin"]] = r["count"]
    last, part, total = {}, {}, 0
    for p, of in counts.items():
        room = small = of.get(-1, 0)
        last[p], part[p] = -1, 1.0
        for b in sorted(x for x in of if x >= 0):
            if room <= 0:
                break
            last[p], part[p] = b, min(1.0, room / of[b])
            room -= of[b]
        total += 2 * small - max(room, 0)
    pick = lambda of, kind: F.create_map(*[F.lit(x) for p, v in of.items() for x in (p, kind(v))])[F.col("profile_id")]
    drawn = F.pmod(F.xxhash64("container_id", F.lit(7)), F.lit(1 << 20)) < pick(part, float) * (1 << 20)
    kept = marked.filter((F.col("bin") < pick(last, int)) | (F.col("bin") == -1) | ((F.col("bin") == pick(last, int)) & drawn))
    return kept.select("profile_id", "container_id", "n_tokens"), total


def pack(sizes: DataFrame, profiles: DataFrame, key: str, tokens: str = "n_tokens", refill_below: float = 0.995) -> DataFrame:
    """(profile_id, key, part_no, start_token, n_tokens, container_id): every item in a container of every profile.

    profiles has profile_id and capacity_tokens; it is read on the driver and must hold 1000 rows at most. An item is
    divided only if it alone exceeds the capacity: into full containers of its own and a rest that is packed like any
    item. Items of no or unknown size take no room, but have a container; null keys are no items; profiles without a
    positive capacity are left out. The result doesn't depend on the partitioning of the input.
    """
    rows = profiles.filter(F.col("capacity_tokens") > 0).select("profile_id", "capacity_tokens").distinct().take(1001)
    if len(rows) > 1000:
        raise ValueError("more than 1000 packing profiles")
    capacities = {r[0]: r[1] for r in rows}
    items = cut(
        sizes.filter(F.col(key).isNotNull()).select(F.col(key).alias("item"), F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    )
    n = items.count()
    shards = max(1, math.ceil(n / SHARD_ITEMS))
    listed = F.array(*[F.struct(F.lit(p).alias("profile_id"), F.lit(c).cast("long").alias("capacity")) for p, c in sorted(capacities.items())])
    each = items.select("item", "n", F.inline(listed)) if capacities else items.select("item", "n", F.lit(0).alias("profile_id"), F.lit(1).cast("long").alias("capacity")).limit(0)
    full = F.when(F.col("n") > F.col("capacity"), F.floor(F.col("n") / F.col("capacity"))).otherwise(0)
    parted = each.withColumn("full", full.cast("long")).withColumn("rest", F.col("n") - F.col("full") * F.col("capacity"))
    own = parted.filter("full > 0").select(
        "profile_id", "item", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("part_no"), "capacity"
    ).select(
        "profile_id", "item", "part_no", (F.col("part_no") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"),
        F.concat_ws("-", "profile_id", F.lit("own"), "item", "part_no").alias("container_id"),
    )
    rest = parted.filter("full = 0 or rest > 0")
    shard = lambda col, k: F.pmod(F.xxhash64(col), F.lit(k)).cast("int")
    kind = items.schema["item"].dataType.simpleString()
    pid = each.schema["profile_id"].dataType.simpleString()
    schema = f"profile_id {pid}, item {{}}, n_tokens long, container_id string"
    placed = cut(
        rest.select("profile_id", "item", F.col("rest").alias("n_tokens"), shard("item", shards).alias("shard"))
        .groupBy("profile_id", "shard")
        .applyInPandas(_pack_group(0, capacities), schema.format(kind))
    )
    level = 0
    while shards > 1 and capacities:
        filled = cut(placed.groupBy("profile_id", "container_id").agg(F.sum("n_tokens").alias("n_tokens")))
        loose, n = _going_on(filled, capacities, refill_below)
        fewer = max(math.ceil(shards / 64), math.ceil(n / SHARD_ITEMS))
        if n == 0 or fewer >= shards:
            break
        level, shards = level + 1, fewer
        moved = (
            loose.select("profile_id", F.col("container_id").alias("item"), "n_tokens", shard("container_id", shards).alias("shard"))
            .groupBy("profile_id", "shard")
            .applyInPandas(_pack_group(level, capacities), schema.format("string"))
            .select("profile_id", F.col("item").alias("container_id"), F.col("container_id").alias("new_id"))
        )
        placed = cut(
            placed.join(moved, ["profile_id", "container_id"], "left").select(
                "profile_id", "item", "n_tokens", F.coalesce("new_id", "container_id").alias("container_id")
            )
        )
    whole = F.lit(0).cast("long")
    parts = own.groupBy("profile_id", "item").agg(F.count("*").alias("k"), F.max("n_tokens").alias("capacity"))
    tail = placed.join(parts, ["profile_id", "item"], "left").select(
        "profile_id", "item", F.coalesce("k", whole).alias("part_no"), F.coalesce(F.col("k") * F.col("capacity"), whole).alias("start_token"), "n_tokens", "container_id"
    )
    return own.unionByName(tail).withColumnRenamed("item", key)


def fill_report(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Containers, tokens and the share of room that is used, per profile."""
    total = packed.groupBy("profile_id", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("profile_id").agg(
        F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest")
    )
    return total.join(profiles, "profile_id").select(
        "profile_id", "capacity_tokens", "n_containers", "n_tokens", "fullest",
        F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("used_share"),
    )
