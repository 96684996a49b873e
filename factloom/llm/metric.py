"""Exact radius join of texts under a true edit metric, by metric-space partitioning (problem 6).

The metric is the unrestricted Damerau-Levenshtein distance (insert, delete, replace, swap of neighbours), which keeps
the triangle inequality. Every text belongs to the cell of a nearest pivot. Of two members within the radius, take the one
nearer to its pivot: the other can be no farther from that pivot than its own nearest pivot plus the radius, so every text
is sent as a guest to all cells whose pivot lies within that bound (plus the radius again where it is a guest already, as
then only the member's cell counts). Each cell then joins its members against members and guests exactly. Cells over a
bound are partitioned again by pivots of their own until they are under it.

Short texts over a large alphabet are nearly equidistant: every pivot is then within the bound and partitioning copies the
cell without making it smaller. Where a cell's sample shows that, the cell is kept and split by what is left of its texts
after deletions instead, which is exact as well and as wide as the data. So are texts over LONG, as their distance to a
pivot would cost the product of both lengths.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut

CELL_LOAD = 1000  # a text of some 8 signs counts 1, one of 256 signs 65
PIVOTS = 32
SAMPLE = 512  # texts of a cell of which its pivots are chosen; any pivots give the whole result
MOST_COPIES, LEAST_SHRINK = 3.0, 0.5  # a partition pays up to so many copies of a text and down to so large a largest cell
LONG = 256
TABLE_CELLS = 8_000_000
TASK_LOAD, SLICE_LOAD = 20_000, 2_000


def edit_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    m, n = len(a), len(b)
    far, last_row = m + n, defaultdict(int)
    h = [[far] * (n + 2) for _ in range(m + 2)]
    for i in range(m + 1):
        h[i + 1][1] = i
    for j in range(n + 1):
        h[1][j + 1] = j
    for i in range(1, m + 1):
        last_col = 0
        for j in range(1, n + 1):
            i1, j1 = last_row[b[j - 1]], last_col
            same = a[i - 1] == b[j - 1]
            if same:
                last_col = j
            h[i + 1][j + 1] = min(
                h[i][j] + (not same), h[i + 1][j] + 1, h[i][j + 1] + 1, h[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1)
            )
        last_row[a[i - 1]] = i
    return h[m + 1][n + 1]


def distances_to(pivot: str, texts: list[str]) -> np.ndarray:
    """Distances of many texts to one pivot: the same recurrence, each row of it for all texts at once."""
    k, m = len(texts), len(pivot)
    n = max(map(len, texts), default=0)
    codes = np.zeros((n, k), np.int32)  # signs from 1 on, 0 beyond a text's end
    for x, t in enumerate(texts):
        codes[: len(t), x] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32) + 1
    h = np.empty((m + 1, n + 1, k), np.int32)
    h[0] = at = np.arange(n + 1, dtype=np.int32)[:, None]
    last_row = np.zeros((n, k), np.int32)  # the last row whose sign is that of the text, 0 for none
    last_col = np.zeros((n, k), np.int32)
    for i in range(1, m + 1):
        same = codes == ord(pivot[i - 1]) + 1
        np.maximum.accumulate(np.where(same, at[1:], 0)[:-1], axis=0, out=last_col[1:])
        row = h[i]
        row[0] = i
        np.minimum(h[i - 1, 1:] + 1, h[i - 1, :-1] + ~same, out=row[1:])
        # a swap over signs left out of both texts is never nearer than replacing them
        j, x = np.nonzero((last_row > 0) & (last_col > 0) & ((last_row == i - 1) | (last_col == at[:-1])))
        i1, j1 = last_row[j, x], last_col[j, x]
        row[j + 1, x] = np.minimum(row[j + 1, x], h[i1 - 1, j1 - 1, x] + (i - i1) + (j - j1))
        row[:] = np.minimum.accumulate(row - at, axis=0) + at  # then insertions
        last_row[same] = i
    return h[m, np.array([len(t) for t in texts], np.int64), np.arange(k)]


def _deletions(text: str, radius: int) -> set[str]:
    """The text and all that is left after at most radius deletions."""
    out = level = {text}
    for _ in range(radius):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out = out | level
    return out


def _keys(text: str, radius: int) -> set[str]:
    """Keys of which texts within the radius share one: what is left after deletions, or, as long texts would give too
    many, their first and last 64 characters, of which one edit leaves one pair alone."""
    out = _deletions(text, radius) if len(text) <= LONG else set()
    if len(text) > LONG - radius:
        out |= {"\x00" + text[:64], "\x01" + text[-64:]} if radius == 1 else {"\x00"}
    return out


def _within(a: str, b: str, radius: int) -> bool:
    if abs(len(a) - len(b)) > radius:
        return False
    if radius != 1:
        return edit_distance(a, b) <= radius
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x == y[1:] or x[1:] == y or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


def _farthest_first(sample: list[str], k: int) -> list[str]:
    pivots = sample[:1]
    nearest = distances_to(pivots[0], sample) if pivots else np.zeros(0)
    while len(pivots) < k and len(nearest) and nearest.max() > 0:
        pivots.append(sample[int(np.argmax(nearest))])
        nearest = np.minimum(nearest, distances_to(pivots[-1], sample))
    return pivots


def _choose(sample: list[str], radius: int) -> list[str]:
    """The pivots, farthest first or as sampled, that leave the sample's largest cell smallest; none if no choice pays."""
    best, least = [], LEAST_SHRINK
    for pivots in (_farthest_first(sample, PIVOTS), sample[:PIVOTS]):
        d = np.stack([distances_to(p, sample) for p in pivots])
        cells = d <= d.min(axis=0) + radius
        largest = cells.sum(axis=1).max() / len(sample)
        if cells.sum() <= MOST_COPIES * len(sample) and largest <= least:
            best, least = pivots, largest
    return best


def _assign(radius: int) -> Callable:
    """Rows of cell, kind, block, text, home and the cell's pivots to rows of cell, child, kind, block, text, home."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, rows in batch.groupby("cell", sort=False):
                rows = rows.iloc[np.argsort(rows["text"].str.len().to_numpy(), kind="stable")]
                texts, own = rows["text"].tolist(), list(rows["pivots"].iloc[0])
                part, at, most = [], 0, max(map(len, own)) + 2
                while at < len(texts):  # so many of like length that the recurrence's table stays bounded
                    room = TABLE_CELLS // (most * (len(texts[min(at + 1999, len(texts) - 1)]) + 2))
                    some = texts[at : at + min(2000, max(1, room))]
                    part.append(np.stack([distances_to(p, some) for p in own]))
                    at += len(some)
                d = np.concatenate(part, axis=1)
                near = d.min(axis=0)
                spread = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts])
                ties = d == near
                pick = spread % ties.sum(axis=0)  # of equally near pivots one by hash, so that cells stay even
                home = np.argmax(np.cumsum(ties, axis=0) > pick, axis=0)
                member = rows["home"].to_numpy()
                child, x = np.nonzero(d <= near + np.where(member, radius, 2 * radius))
                inside = member[x] & (home[x] == child)
                yield pd.DataFrame({"cell": cell, "child": child, "kind": rows["kind"].to_numpy()[x], "block": rows["block"].to_numpy()[x], "text": np.array(texts, object)[x], "home": inside})

    return run


def _pairs(rows: Iterable[tuple], radius: int) -> Iterator[tuple]:
    """(kind, block, text, text) within the radius of rows (group, kind, block, text, home); pairs stay inside a group."""
    rows = list(rows)
    members: dict[tuple, list[str]] = defaultdict(list)
    for group, kind, block, text, home in rows:
        if home:
            for left in _keys(text, radius):
                members[group, kind, block, left].append(text)
    out = set()
    for group, kind, block, text, _ in rows:
        for left in _keys(text, radius):
            for other in members.get((group, kind, block, left), ()):
                if other < text and _within(other, text, radius) or text < other and _within(text, other, radius):
                    out.add((kind, block, *sorted((text, other))))
    yield from sorted(out)


PAIRS = "kind string, block string, text_a string, text_b string"
ROWS = ["cell", "kind", "block", "text", "home"]


def _load(length: Column) -> Column:
    return 1 + F.pow(F.least(length, F.lit(LONG)) / 32, 2)


def _partition(rows: DataFrame, cell_load: int, radius: int, levels: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows in cells under the bound, and rows in cells that no pivots make smaller."""
    small, stuck = [], []
    for _ in range(levels):
        size = rows.groupBy("cell").agg(F.sum(_load(F.length("text"))).alias("load"))
        big = cut(size.filter(F.col("load") > cell_load))
        small.append(rows.join(big, "cell", "left_anti"))
        total = big.agg(F.sum("load")).first()[0]
        if total is None:
            return small, stuck
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(total // TASK_LOAD))
        slices = big.select("cell", F.ceil(F.col("load") / SLICE_LOAD).alias("slices"))  # a large cell's rows are assigned in many tasks
        rows = rows.join(big.select("cell"), "cell")
        salt = F.pmod(F.xxhash64("text"), F.lit(SAMPLE))
        sample = rows.filter("home").groupBy("cell", salt.alias("salt")).agg(F.min_by("text", F.xxhash64("text", F.lit(1))).alias("text"))
        choose = lambda key, pdf: pd.DataFrame({"cell": [key[0]], "pivots": [_choose(pdf.sort_values("salt")["text"].tolist(), radius)]})
        pivots = cut(sample.groupBy("cell").applyInPandas(choose, "cell string, pivots array<string>"))
        stuck.append(rows.join(pivots.filter("size(pivots) = 0").select("cell"), "cell", "left_semi"))
        paying = pivots.filter("size(pivots) > 0").join(slices, "cell")
        dealt = rows.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("text"), F.col("slices"))).drop("slices").repartition(tasks, "cell", "slice")
        copies = paying.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices").repartition(tasks, "cell", "slice")
        split = cut(dealt.join(copies, ["cell", "slice"]).drop("slice").mapInPandas(_assign(radius), "cell string, child int, kind string, block string, text string, home boolean"))
        living = split.filter("home").select("cell", "child").distinct()  # a cell of guests only joins nothing
        rows = split.join(living, ["cell", "child"], "left_semi").withColumn("cell", F.concat_ws("\x1f", "cell", "child")).select(*ROWS)
    return small, [*stuck, rows]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def radius_join(df: DataFrame, radius: int = 1, cell_load: int = CELL_LOAD, levels: int = 12) -> DataFrame:
    """(kind, block, text_a, text_b): all pairs of different texts of one kind and block within the edit radius, each once.

    df has kind, block (texts of different kinds or blocks never pair) and text, and may have asks (boolean): then only
    pairs count of which one text at least stands in a row that asks. Repeated rows count once, nulls not at all; empty and very long texts are texts like any other. Each kind and block begins as one cell. Cells of more than
    cell_load are partitioned by pivots, chosen farthest first from a sample of SAMPLE texts; what is left after levels
    rounds, or doesn't get smaller, is split by deletion keys.
    """
    asks = F.coalesce(F.col("asks"), F.lit(False)) if "asks" in df.columns else F.lit(True)
    rows = df.filter("kind is not null and block is not null and text is not null").groupBy("kind", "block", "text").agg(F.max(asks).alias("home"))
    rows = cut(rows.select(F.concat_ws("\x1f", "kind", "block").alias("cell"), "kind", "block", "text", "home"))
    long = rows.filter(F.length("text") > LONG - radius)
    small, stuck = _partition(rows.filter(F.length("text") <= LONG), cell_load, radius, levels)
    cells = cut(_union(small))
    load = cells.agg(F.sum(_load(F.length("text")))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("cell"), F.lit(max(1, int(load // (4 * cell_load)))))
    in_cells = (
        cells.withColumn("bucket", bucket).groupBy("bucket")
        .applyInPandas(lambda pdf: pd.DataFrame(list(_pairs(pdf[ROWS].itertuples(index=False, name=None), radius)), columns=["kind", "block", "text_a", "text_b"]), PAIRS)
    )
    return in_cells.unionByName(_by_deletions(_union([long, *stuck]), radius)).distinct()


def _by_deletions(rows: DataFrame, radius: int) -> DataFrame:
    """The pairs of cells that pivots don't divide: an equi-join on what is left after deletions, each pair then measured."""
    keys = F.pandas_udf(lambda texts: texts.map(lambda t: sorted(_keys(t, radius))), "array<string>")
    spread = cut(rows.select("cell", "kind", "block", "text", "home", F.explode(keys("text")).alias("left")))
    several = spread.groupBy("cell", "left").agg(F.count("*").alias("n")).filter("n > 1").select("cell", "left")
    spread = spread.join(several, ["cell", "left"], "left_semi")
    other = spread.filter("home").select("cell", "left", F.col("text").alias("other"))
    met = spread.join(other, ["cell", "left"]).filter("text <> other")
    met = met.select("kind", "block", F.least("text", "other").alias("text_a"), F.greatest("text", "other").alias("text_b")).distinct()

    def near(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[_within(x, y, radius) for x, y in zip(b["text_a"], b["text_b"], strict=True)]]

    return met.mapInPandas(near, PAIRS)
