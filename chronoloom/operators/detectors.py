"""Defect detectors over signal tables, each giving hits: asset_id, t, kind, severity, start_s, end_s and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds on a 0 to 255 scale and in seconds.
LUMA_EDGE, LUMA_RETURN = 40.0, 12.0
PTS_FACTOR, PTS_LEAST = 3.0, 0.10
BLACK_LEAST, BLACK_FLASH, BLACK_LEVEL = 0.03, 0.25, 0.10 * 255
FREEZE_LEAST, FREEZE_LONG = 0.5, 2.0
SILENCE_LEAST, SILENCE_LONG = 0.5, 1.0
SCENE = 0.15
DUPLICATE = 2.0
SHOT_LEAST = 0.15


def _order(*cols: str):
    return Window.partitionBy("asset_id").orderBy(*cols)


def luma_spikes(luma: DataFrame, edge: float = LUMA_EDGE, back: float = LUMA_RETURN) -> DataFrame:
    """Steps of the mean luma of at least edge, or else single frames that stand out by as much between like neighbours."""
    w = _order("t")
    rows = luma.select("asset_id", "t", "yavg", F.lag("yavg").over(w).alias("before"), F.lead("yavg").over(w).alias("after"))
    step = F.abs(F.col("yavg") - F.col("before"))
    out = F.abs(F.col("yavg") - (F.col("before") + F.col("after")) / 2)
    impulse = (out >= edge) & (F.abs(F.col("before") - F.col("after")) <= back)
    form = F.when(step >= edge, "edge").when(impulse, "impulse")
    return rows.withColumn("form", form).filter("form IS NOT NULL").select(
        "asset_id", "t", F.lit("luma-spike").alias("kind"), F.lit("high").alias("severity"), F.col("form"), F.when(F.col("form") == "edge", step).otherwise(out).alias("delta")
    )


def pts_gaps(packets: DataFrame, factor: float = PTS_FACTOR, least: float = PTS_LEAST) -> DataFrame:
    """Steps between packet times far over their asset's median step; assets of under three steps have none."""
    w = _order("pts")
    steps = packets.select("asset_id", "pts").distinct().withColumn("from_", F.lag("pts").over(w)).withColumn("gap", F.col("pts") - F.col("from_")).filter("gap > 0")
    usual = steps.groupBy("asset_id").agg(F.median("gap").alias("expected"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    limit = F.greatest(F.lit(least), factor * F.col("expected"))
    return steps.join(usual, "asset_id").withColumn("threshold", limit).filter("gap > threshold").select(
        "asset_id", F.col("from_").alias("t"), F.lit("pts-gap").alias("kind"), F.lit("high").alias("severity"), F.col("pts").alias("to_"), "gap", "expected", "threshold"
    )


def runs(points: DataFrame, inside: Column) -> DataFrame:
    """asset_id, start_s, end_s: maximal runs of rows for which inside holds; a run ends at the next row's time."""
    w = _order("t")
    marked = points.withColumn("_in", inside).withColumn("_next", F.coalesce(F.lead("t").over(w), F.col("t")))
    changed = F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0)
    numbered = marked.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(w)).filter("_in")
    return numbered.groupBy("asset_id", "_run").agg(F.min("t").alias("start_s"), F.max("_next").alias("end_s")).drop("_run")


def _hits(spans: DataFrame, kind: str, severity: Column) -> DataFrame:
    return spans.select("asset_id", F.col("start_s").alias("t"), F.lit(kind).alias("kind"), severity.alias("severity"), "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration"))


def black(luma: DataFrame, level: float = BLACK_LEVEL, least: float = BLACK_LEAST, flash: float = BLACK_FLASH) -> DataFrame:
    """Dark runs of the luma series; a short one is the worse defect. The rule on single pixels is a decoder's, this one is on means."""
    spans = runs(luma, F.col("yavg") <= level).filter(F.col("end_s") - F.col("start_s") >= least)
    return _hits(spans, "black", F.when(F.col("end_s") - F.col("start_s") <= flash, "high").otherwise("medium"))


def freeze(changes: DataFrame, noise: float, least: float = FREEZE_LEAST, long: float = FREEZE_LONG) -> DataFrame:
    """Runs of frames that change by no more than noise. changes: asset_id, t, change."""
    spans = runs(changes, F.coalesce(F.col("change") <= noise, F.lit(False))).filter(F.col("end_s") - F.col("start_s") >= least - 1e-6)
    return _hits(spans, "freeze", F.when(F.col("end_s") - F.col("start_s") >= long, "high").otherwise("medium"))


def silence_spans(levels: DataFrame, quiet: float, least: float = 1.0) -> DataFrame:
    """Runs of levels at or under quiet, of at least so long. levels: asset_id, t, level."""
    return runs(levels, F.col("level") <= quiet).filter(F.col("end_s") - F.col("start_s") >= least)


def silence(spans: DataFrame, least: float = SILENCE_LEAST, long: float = SILENCE_LONG) -> DataFrame:
    return _hits(spans.filter(F.col("end_s") - F.col("start_s") >= least), "silence", F.when(F.col("end_s") - F.col("start_s") >= long, "medium").otherwise("low"))


def pair_freezes(marks: DataFrame, assets: DataFrame) -> DataFrame:
    """Start and end marks (asset_id, mark, t) paired by place; a start without an end runs to the asset's duration."""
    n = F.row_number().over(Window.partitionBy("asset_id", "mark").orderBy("t"))
    numbered = marks.withColumn("n", n)
    starts, ends = numbered.filter("mark = 'start'").select("asset_id", "n", F.col("t").alias("start_s")), numbered.filter("mark = 'end'").select("asset_id", "n", F.col("t").alias("e"))
    return starts.join(ends, ["asset_id", "n"], "left").join(assets.select("asset_id", "duration"), "asset_id", "left").select("asset_id", "start_s", F.coalesce("e", "duration").alias("end_s"))


def pair_silences(marks: DataFrame) -> DataFrame:
    """As pair_freezes, but a start without an end, or with one that isn't later, is dropped."""
    n = F.row_number().over(Window.partitionBy("asset_id", "mark").orderBy("t"))
    numbered = marks.withColumn("n", n)
    starts, ends = numbered.filter("mark = 'start'").select("asset_id", "n", F.col("t").alias("start_s")), numbered.filter("mark = 'end'").select("asset_id", "n", F.col("t").alias("end_s"))
    return starts.join(ends, ["asset_id", "n"]).filter("end_s > start_s").select("asset_id", "start_s", "end_s")


def cuts(frames: DataFrame, threshold: float = SCENE, start: float | None = None, end: float | None = None) -> DataFrame:
    """asset_id, t: times, to the millisecond, at which the scene score exceeds threshold inside a closed window."""
    found = frames.filter(F.col("scene_score") > threshold)
    if start is not None:
        found = found.filter(F.col("t") >= start)
    if end is not None:
        found = found.filter(F.col("t") <= end)
    return found.select("asset_id", F.round("t", 3).alias("t")).distinct()


def keyframes(packets: DataFrame) -> DataFrame:
    return packets.filter("is_key AND pts IS NOT NULL").select("asset_id", F.round("pts", 3).alias("t")).distinct()


def deltas(a: Column, b: Column, side: int, tile: int) -> Column:
    """The mean absolute difference of each tile of two square pictures (arrays of pixels, row by row)."""
    n = side // tile
    # An array of places by tile is a constant of the plan.
    places = F.array(*[F.array(*[F.lit((r * tile + y) * side + c * tile + x + 1) for y in range(tile) for x in range(tile)]) for r in range(n) for c in range(n)])
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.transform(F.array(gaps), lambda g: F.transform(places, lambda p: F.aggregate(p, F.lit(0.0), lambda s, i: s + F.element_at(g, i)) / (tile * tile)))[0]


def change_scores(frames: DataFrame, side: int, tile: int) -> DataFrame:
    """Adds change_score: the largest tile difference from the row before; null for the first row or another size."""
    before = F.lag("thumb").over(_order("t"))
    score = F.array_max(deltas(F.col("thumb"), F.col("_before"), side, tile))
    same = (F.size("thumb") == side * side) & (F.size("_before") == side * side)
    return frames.withColumn("_before", before).withColumn("change_score", F.when(F.col("_before").isNotNull() & same, score)).drop("_before")


def noise_floor(scored: DataFrame) -> DataFrame:
    """The element at place round(0.25 (n - 1)) of each asset's sorted scores, half-even; no interpolation."""
    ranked = scored.filter("change_score IS NOT NULL").select("asset_id", "change_score", F.row_number().over(_order("change_score")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("asset_id")).alias("n"))
    return ranked.filter(F.col("r") == F.bround(0.25 * (F.col("n") - 1)) + 1).select("asset_id", F.col("change_score").alias("floor"), F.col("n").alias("pairs"))


def content_changes(frames: DataFrame, duration: float, threshold: float, side: int, tile: int, interval: float = 1.0, most: int = 600) -> DataFrame:
    """Times i * interval at which the first frame of a grid step differs from the one before by over threshold.

    The interval is stretched where the duration has more than so many steps.
    """
    step = max(interval, duration / most)
    w = Window.partitionBy("asset_id", "i").orderBy("t")
    first = frames.withColumn("i", F.floor(F.col("t") / step).cast("long")).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    scored = change_scores(first.select("asset_id", F.col("i").alias("t"), "thumb"), side, tile)
    return scored.filter(F.col("change_score") > threshold).select("asset_id", (F.col("t") * step).alias("t"), "change_score")


def representatives(found: DataFrame, frames: DataFrame, column: str = "thumb", least: float = SHOT_LEAST) -> DataFrame:
    """Shots of at least so long with the frame at their middle: asset_id, index, start_s, end_s, column."""
    from chronoloom.operators.joins import at_or_after

    middle = found.filter(F.col("seconds") >= least).select("asset_id", "index", F.col("start").alias("start_s"), F.col("end").alias("end_s"), (F.col("start") + (F.col("end") - F.col("start")) * 0.5).alias("t"))
    return at_or_after(middle, frames, column).drop("t")


def duplicate_shots(reps: DataFrame, side: int, tile: int, limit: float = DUPLICATE) -> DataFrame:
    """Shots like an earlier, not neighbouring one. reps: asset_id, index, start_s, end_s, thumb; at least three shots.

    Shots without a picture match none; tiles with a pixel missing on either side aren't compared.
    """
    from chronoloom.operators.likeness import likest_earlier

    n = F.count(F.lit(1)).over(Window.partitionBy("asset_id"))
    best = likest_earlier(reps.withColumn("_n", n).filter("_n >= 3"), side, tile, limit)
    return best.select("asset_id", F.col("start_s").alias("t"), F.lit("duplicate-shot").alias("kind"), F.lit("medium").alias("severity"), "start_s", "end_s", "matched", "tile_delta")


def located(hits: list[DataFrame]) -> DataFrame:
    """All detectors' hits: asset_id, t, kind, severity, start_s, end_s."""
    out = None
    for h in hits:
        h = h.select("asset_id", "t", "kind", "severity", *[(F.col(c) if c in h.columns else F.lit(None).cast("double")).alias(c) for c in ("start_s", "end_s")])
        out = h if out is None else out.unionByName(h)
    return out
