"""Series of times: even, burst, thinned and candidate times for each asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def even_times(start: Column, end: Column, n: Column) -> Column:
    """n times from start to end, both included; the start alone where n is 1 or less."""
    step = (end - start) / F.greatest(n - 1, F.lit(1))
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), lambda i: F.round(start + i * step, 3))
    return F.when(n <= 1, F.array(F.round(start, 3))).otherwise(many)


def uniform(assets: DataFrame) -> DataFrame:
    """asset_id, start_s, end_s, n -> asset_id, t."""
    return assets.select("asset_id", F.explode(even_times(F.col("start_s"), F.col("end_s"), F.col("n"))).alias("t"))


def even_places(n: Column, cap: Column) -> Column:
    """The places from 0 that an even thinning of n items to cap keeps; equal places count once."""
    step = (n - 1) / F.greatest(cap - 1, F.lit(1))
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(cap - 1, F.lit(0)).cast("int")), lambda i: F.least((n - 1).cast("long"), F.bround(i * step).cast("long"))))
    whole = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)")).cast("array<bigint>")
    return F.when((cap >= n) | (n <= 0), whole).when(cap == 1, F.array(F.lit(0).cast("long"))).otherwise(some)


def thin(items: DataFrame, cap: int | Column, order: list[str], asset: str = "asset_id") -> DataFrame:
    """Evenly thins each asset's rows to cap, a number or a column, the first and the last among them."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    own = Window.partitionBy(asset)
    n = F.count(F.lit(1)).over(own)
    place = F.row_number().over(own.orderBy(*order)) - 1
    numbered = items.withColumn("_n", n).withColumn("_place", place)
    # A place is kept if some i of 0 to cap - 1 rounds to it: only the nearest i on either side can.
    step = F.when(cap > 1, (F.col("_n") - 1) / F.greatest(F.lit(1), cap - 1)).otherwise(1.0)
    near = F.floor(F.col("_place") / step)
    lands = F.lit(False)
    for d in (-1, 0, 1, 2):
        i = near + d
        lands = lands | ((i >= 0) & (i < cap) & (F.least(F.col("_n") - 1, F.bround(i * step).cast("long")) == F.col("_place")))
    kept = (F.col("_n") <= cap) | F.when(cap == 1, F.col("_place") == 0).otherwise(lands)
    return numbered.filter(kept).drop("_n", "_place")


def bursts(hits: DataFrame, fps: float = 10.0, radius: float = 0.5) -> DataFrame:
    """asset_id, t, start_s, end_s (the window) -> asset_id, t: a dense grid around each hit in its window, and the hit."""
    if fps <= 0 or radius < 0:
        raise ValueError("fps must be over 0 and radius 0 or more")
    step = 1.0 / fps
    low, high = F.greatest(F.col("start_s"), F.col("t") - radius), F.least(F.col("end_s"), F.col("t") + radius)
    n = F.greatest(F.lit(0), F.floor((high - low) / step + 1e-9)).cast("int")
    grid = F.transform(F.sequence(F.lit(0), n), lambda i: F.round(F.least(high, low + i * step), 3))
    inside = hits.filter((F.col("t") >= F.col("start_s")) & (F.col("t") <= F.col("end_s")))
    return inside.select("asset_id", F.explode(F.array_union(grid, F.array(F.round("t", 3)))).alias("t")).distinct()


def candidates(assets: DataFrame, pool: DataFrame, label: str = "scene") -> DataFrame:
    """asset_id, t, strategy: the pool's times in each asset's window, topped up evenly where they are too few.

    assets: asset_id, start_s, end_s, target. Enough means at least a third of the target and three; then only
    the start, and a time just before the end where the pool leaves off early, are added.
    """
    inside = assets.join(pool.select("asset_id", F.col("t").alias("p")), "asset_id", "left").filter("p IS NULL OR (p >= start_s AND p <= end_s)")
    counts = assets.select("asset_id").join(inside.groupBy("asset_id").agg(F.count("p").alias("n"), F.max("p").alias("last")), "asset_id", "left").fillna(0, ["n"])
    plan = assets.join(counts, "asset_id").withColumn("few", F.col("n") < F.greatest(F.lit(3), F.floor(F.col("target") / 3)))
    tail = F.when(F.col("end_s") - 0.5 > F.col("last"), F.array(F.greatest("start_s", F.col("end_s") - 0.05))).otherwise(F.expr("cast(array() as array<double>)"))
    extra = F.when(F.col("few"), even_times(F.col("start_s"), F.col("end_s"), F.col("target"))).otherwise(F.concat(F.array("start_s"), tail))
    name = F.when(F.col("few"), F.lit(f"{label}+uniform")).otherwise(F.lit(label))
    added = plan.select("asset_id", F.explode(extra).alias("t"), name.alias("strategy"))
    own = inside.filter("p IS NOT NULL").join(plan.select("asset_id", name.alias("strategy")), "asset_id").select("asset_id", F.col("p").alias("t"), "strategy")
    return own.unionByName(added).distinct()


def merged(*series: DataFrame) -> DataFrame:
    """The union of several time series of each asset, each time once."""
    out = series[0].select("asset_id", "t")
    for more in series[1:]:
        out = out.unionByName(more.select("asset_id", "t"))
    return out.distinct()


def chunks(items: DataFrame, size: int, order: list[str], asset: str = "asset_id") -> DataFrame:
    """Adds chunk and slot: consecutive groups of size rows for each asset."""
    place = F.row_number().over(Window.partitionBy(asset).orderBy(*order)) - 1
    return items.withColumn("_p", place).withColumn("chunk", F.floor(F.col("_p") / size).cast("long")).withColumn("slot", (F.col("_p") % size).cast("long")).drop("_p")
