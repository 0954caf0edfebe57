"""Token budgets: guards, the width of a read, the layout and size of contact sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import tokens as price
from chronoloom.functions.scalars import grid_columns, grid_rows, height_for

READ_BUDGET, SCAN_BUDGET = 20_000, 3_000
WIDTH, FLOOR = 512, 384
TILE_LEAST, SHRINK = 96, 0.8


def guard(reads: DataFrame, family: str = "generic", most: int = READ_BUDGET) -> DataFrame:
    """Adds tokens, over, affordable and window_s to reads (width, height, frames, fps). Nothing is thinned."""
    each = price.tokens(F.col("width"), F.col("height"), family)
    out = reads.withColumn("tokens", each * F.col("frames")).withColumn("over", F.col("tokens") > most)
    out = out.withColumn("affordable", price.frames_for_budget(F.lit(most), each))
    return out.withColumn("window_s", F.when(F.col("fps") > 0, F.col("affordable") / F.col("fps")).otherwise(0.0))


def read_size(assets: DataFrame, family: str = "generic", most: int = READ_BUDGET) -> DataFrame:
    """Adds read_width, read_height and mode: a requested width as it is, else the widest of 512, 510 to 384 that fits."""
    sw, sh, frames = F.col("width"), F.col("height"), F.col("frames")
    fits = F.filter(F.sequence(F.lit(WIDTH), F.lit(FLOOR), F.lit(-2)), lambda w: price.tokens(w, height_for(w, sw, sh), family) * frames <= most)
    best = F.try_element_at(fits, F.lit(1))
    asked = F.col("requested_width") if "requested_width" in assets.columns else F.lit(None).cast("int")
    out = assets.withColumn("_best", best).withColumn("read_width", F.coalesce(F.when(asked.isNotNull(), F.greatest(F.lit(2), asked)), F.col("_best"), F.lit(FLOOR)))
    out = out.withColumn("read_height", height_for(F.col("read_width"), sw, sh))
    mode = F.when(asked.isNotNull(), "explicit").when(F.col("_best").isNull(), "managed-floor").when(F.col("_best") < WIDTH, "managed").otherwise("default")
    return out.withColumn("mode", mode).drop("_best")


def sheet_tokens(tile: Column, sw: Column, sh: Column, cols: Column, rows: Column, family: str) -> Column:
    high = F.greatest(F.lit(1), F.bround(tile * sh / sw).cast("int"))
    size = F.array(F.struct(((tile + 4) * cols).alias("w"), ((high + 4) * rows).alias("h")))  # worked out once: a price names it many times
    return F.greatest(F.lit(1), F.transform(size, lambda s: price.tokens(s["w"], s["h"], family))[0])


def scan_plan(assets: DataFrame, family: str = "generic", tile: int = 320, most: int = SCAN_BUDGET, per_sheet: int = 25, grid: tuple[int, int] | None = None) -> DataFrame:
    """Adds tile_width, sheet_tokens, tiles and fits: the tile shrinks by a fifth until one sheet is paid for."""
    widths = [tile]
    while widths[-1] > TILE_LEAST:
        widths.append(max(TILE_LEAST, int(widths[-1] * SHRINK)))
    per_sheet = grid[0] * grid[1] if grid else per_sheet
    cols, rows = (F.lit(grid[0]), F.lit(grid[1])) if grid else (grid_columns(F.lit(per_sheet)), grid_rows(F.lit(per_sheet)))
    cost = lambda w: sheet_tokens(w, F.col("width"), F.col("height"), cols, rows, family)
    tried = F.transform(F.array(*[F.lit(w) for w in widths]), lambda w: F.struct(w.alias("w"), cost(w).alias("cost")))
    best = F.transform(F.array(tried), lambda all_: F.coalesce(F.try_element_at(F.filter(all_, lambda x: x["cost"] <= most), F.lit(1)), F.element_at(all_, -1)))[0]
    out = assets.withColumn("_best", best).withColumn("tile_width", F.col("_best.w")).withColumn("sheet_tokens", F.col("_best.cost")).drop("_best").withColumn("fits", F.col("sheet_tokens") <= most)
    sheets = F.greatest(F.lit(1), F.floor(most / F.col("sheet_tokens")))
    return out.withColumn("tiles", F.when(F.col("fits"), F.greatest(F.lit(4), F.least(F.lit(200), sheets * per_sheet)).cast("int")))


def sheet_layout(assets: DataFrame, tile: int = 540, edge: int = 1568, least: int = 380) -> DataFrame:
    """Adds cols and rows: the largest of the grids 2 to 3 by 2 to 6 whose tiles stay readable once shown, else 2 by 2."""
    high = F.greatest(F.lit(1), F.bround(tile * F.greatest(F.lit(1), F.col("height")) / F.greatest(F.lit(1), F.col("width"))).cast("int"))
    grids = [F.struct(F.lit(c).alias("cols"), F.lit(r).alias("rows")) for c in (2, 3) for r in range(2, 7)]
    shown = lambda g: tile * F.least(F.lit(1.0), edge / F.greatest((tile + 4) * g["cols"], (high + 4) * g["rows"]))
    good = F.filter(F.array(*grids), lambda g: shown(g) >= least)
    best = F.aggregate(good, grids[0], lambda a, g: F.when(g["cols"] * g["rows"] > a["cols"] * a["rows"], g).otherwise(a))
    return assets.withColumn("_g", best).withColumn("cols", F.col("_g.cols")).withColumn("rows", F.col("_g.rows")).drop("_g")
