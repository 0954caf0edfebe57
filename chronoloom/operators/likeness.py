"""The likest earlier picture of each, within a limit: exact, block against block, as arrays.

Pictures differ by their largest tile's mean absolute difference. Pairs are compared tile by tile in single
precision, with a margin for its rounding, and leave at the first tile that exceeds the limit or the best found so
far; what stays is measured in double precision. Equal pictures of a block count as one, so copies make no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, BLOCKS, BLOCK_MOST = 4096, 16, 65_536  # pictures of a block; blocks of an asset before blocks grow; where they stop growing
LATE, EARLY = 64, 4096  # pictures compared at once
FEW = 0.04  # share of pairs left at which they are listed
FAR = 1e38
EXACT = 16_384


class Pictures:
    """Pictures sorted by index. values: pictures, tiles, pixels; a tile with a pixel that is null or missing is absent."""

    def __init__(self, column: pa.ListArray, index: np.ndarray, places: np.ndarray):
        n, pixels = len(column), int(places.max()) + 1
        sizes, flat = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), column.flatten()
        row, at = np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        there = at < pixels
        values, known = np.zeros((n, pixels)), np.zeros((n, pixels), dtype=bool)
        values[row[there], at[there]] = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False)[there]
        known[row[there], at[there]] = flat.is_valid().to_numpy(zero_copy_only=False)[there]
        self.index, self.absent = index, ~known[:, places].all(axis=2)
        self.values = values[:, places] + 0.0  # no negative zero
        self.values[np.isnan(self.values)] = np.nan
        self.values[self.absent] = 0.0
        self.usual = ~self.absent.any(axis=1) & np.isfinite(self.values).all(axis=(1, 2))
        whole = np.ascontiguousarray(np.concatenate([self.values.reshape(n, -1), self.absent], axis=1))
        self.keys = [x.tobytes() for x in whole]
        self.first: dict[bytes, int] = {}
        for i, key in enumerate(self.keys):
            self.first.setdefault(key, i)

    def rough(self, odd: float) -> np.ndarray:
        """Tiles, pixels, pictures in single precision: absent ones not a number, those not finite so far away."""
        out = np.where(np.isfinite(self.values), np.clip(self.values, -FAR, FAR), odd)
        out[self.absent] = np.nan
        return np.ascontiguousarray(out.transpose(1, 2, 0), dtype=np.float32)


def measured(late: Pictures, i: np.ndarray, early: Pictures, j: np.ndarray) -> np.ndarray:
    """The largest tile difference of pairs, over the tiles that both have; not a number if there is none."""
    gaps = np.abs(late.values[i] - early.values[j])
    tiles = gaps[:, :, 0]
    for k in range(1, gaps.shape[2]):
        tiles = tiles + gaps[:, :, k]
    tiles = tiles / gaps.shape[2]
    tiles[late.absent[i] | early.absent[j]] = -np.inf
    most = tiles.max(axis=1)
    return np.where(most == -np.inf, np.nan, most)


def _left(a: np.ndarray, b: np.ndarray, most: np.ndarray, tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a and b of which no tile's sum exceeds most (one for each of a)."""
    shape = a.shape[2], b.shape[2]
    total, gap, over, out = np.empty(shape, np.float32), np.empty(shape, np.float32), np.empty(shape, bool), np.zeros(shape, bool)
    i = j = None
    for t in tiles:
        if i is None:
            for k in range(a.shape[1]):
                to = gap if k else total
                np.abs(np.subtract(a[t, k][:, None], b[t, k], out=to), out=to)
                if k:
                    total += gap
            out |= np.greater(total, most[:, None], out=over)
            if out.size - np.count_nonzero(out) <= FEW * out.size:
                i, j = np.nonzero(~out)
        else:
            stays = ~(sum(np.abs(a[t, k, i] - b[t, k, j]) for k in range(a.shape[1])) > most[i])
            i, j = i[stays], j[stays]
        if i is not None and not len(i):
            break
    return np.nonzero(~out) if i is None else (i, j)


def likest(late: Pictures, early: Pictures, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of late, the least difference from one of early whose index is less by 2 at least, and the first such
    one's place; -1 if none is within the limit, or if an equal one in late's own block is as good."""
    n = len(late.keys)
    best, at = np.full(n, np.inf), np.full(n, -1)
    wanted = np.full(n, limit >= 0)
    if early.absent.any():  # else only an equal picture is at 0
        equal = np.zeros(n, dtype=bool)
    else:
        there = np.array([early.first.get(x, -1) for x in late.keys])
        own = np.array([late.first[x] for x in late.keys])
        equal = wanted & late.usual & (there >= 0) & (early.index[there] <= late.index - 2)
        best[equal], at[equal] = 0.0, there[equal]
        wanted &= ~(late.usual & (late.index[own] <= late.index - 2))
    rows = np.flatnonzero(wanted & ~equal)
    if not len(rows):
        return best, at
    kept = np.array(list(early.first.values()))
    a, b = late.rough(FAR), early.rough(-FAR)[:, :, kept]
    size = np.clip(np.abs(np.where(np.isfinite(late.values), late.values, 0.0)).max(axis=(1, 2)), 0, FAR)
    pixels = a.shape[1]
    tiles = np.argsort(-np.nan_to_num(np.nanstd(np.where(np.abs(b) < FAR, b, np.nan).astype(np.float64), axis=2).sum(axis=1)), kind="stable")
    lo, step = 0, 256
    while lo < len(kept):
        hi, step = min(lo + step, len(kept)), min(2 * step, EARLY)
        near = rows[(best[rows] > 0) & (late.index[rows] - 2 >= early.index[kept[lo]])]
        for s in range(0, len(near), LATE):
            part = near[s : s + LATE]
            bound = pixels * np.minimum(best[part], limit)
            most = bound + pixels * 2.0**-21 * (size[part] + bound) + 1e-37
            i, j = _left(a[:, :, part], b[:, :, lo:hi], most.astype(np.float32), tiles)
            for c in range(0, len(i), EXACT):
                x, y = part[i[c : c + EXACT]], kept[lo + j[c : c + EXACT]]
                d = measured(late, x, early, y)
                good = np.flatnonzero((early.index[y] <= late.index[x] - 2) & (d <= limit) & (d < best[x]))
                good = good[np.lexsort((y[good], d[good], x[good]))]
                good = good[np.flatnonzero(np.diff(x[good], prepend=-1))]
                best[x[good]], at[x[good]] = d[good], y[good]
        lo = hi
    return best, at


def likest_earlier(reps: DataFrame, side: int, tile: int, limit: float) -> DataFrame:
    """reps (asset_id, index, start_s, end_s, thumb) that have an earlier one, by 2 places at least, within the limit:
    with tile_delta, and j and matched, index and start of the likest (the first of equals).

    An asset's pictures are cut into blocks by their order, and each pair of blocks is one group, so a large asset
    spreads over tasks; each picture is sent to as many groups as its asset has blocks.
    """
    n = side // tile
    places = np.array([[(r * tile + y) * side + c * tile + x for y in range(tile) for x in range(tile)] for r in range(n) for c in range(n)])
    own = Window.partitionBy("asset_id")
    size = F.count(F.lit(1)).over(own)
    blocks = F.greatest(F.ceil(size / BLOCK_MOST), F.least(F.ceil(size / BLOCK), F.lit(BLOCKS)))
    kept = reps.filter("asset_id IS NOT NULL AND index IS NOT NULL AND thumb IS NOT NULL").select("asset_id", "index", "start_s", "end_s", "thumb")
    ranked = kept.withColumn("_r", F.row_number().over(own.orderBy("index", "start_s")) - 1).withColumn("_k", blocks).withColumn("_b", F.floor(F.col("_r") * F.col("_k") / size))
    sent = ranked.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).withColumn("_late", F.greatest("_b", "_o")).withColumn("_early", F.least("_b", "_o")).drop("_k", "_o")
    groups = sent.repartition(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "asset_id", "_late", "_early")
    kinds = {f.name: f for f in kept.schema.fields}
    told = T.StructType([kinds[c] for c in ("asset_id", "index", "start_s", "end_s")] + [T.StructField("tile_delta", T.DoubleType()), T.StructField("j", kinds["index"].dataType), T.StructField("matched", kinds["start_s"].dataType)])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_r").combine_chunks()
        block = group["_b"].to_numpy()
        with np.errstate(all="ignore"):
            late, early = (group.filter(pa.array(block == group[c][0].as_py())) for c in ("_late", "_early"))
            same = group["_late"][0] == group["_early"][0]
            a = Pictures(late["thumb"].combine_chunks(), late["index"].to_numpy(), places)
            b = a if same else Pictures(early["thumb"].combine_chunks(), early["index"].to_numpy(), places)
            best, at = likest(a, b, limit)
        found = np.flatnonzero(at >= 0)
        out = late.take(pa.array(found)).select(["asset_id", "index", "start_s", "end_s"]).append_column("tile_delta", pa.array(best[found], pa.float64()))
        match = early.take(pa.array(at[found]))
        return out.append_column("j", match["index"]).append_column("matched", match["start_s"])

    pairs = groups.groupBy("asset_id", "_late", "_early").applyInArrow(run, told)
    best = pairs.groupBy("asset_id", "index", "start_s", "end_s").agg(F.min(F.struct("tile_delta", "j", "matched")).alias("b"))
    return best.select("asset_id", "index", "start_s", "end_s", "b.tile_delta", "b.j", "b.matched")
