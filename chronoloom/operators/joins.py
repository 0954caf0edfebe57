"""Range, nearest and as-of joins on timelines, always with the asset as an equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONFIRM_SPAN, CONFIRM_LEVEL = 0.35, 40.0
PROTECT = 0.05


def scene_ids(frames: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds scene_id: one more than the cuts at or before the frame. One sorted pass over both, no pairs."""
    marks = frames.select(*frames.columns, F.lit(0).alias("_cut")).unionByName(cuts.select("asset_id", "t", F.lit(1).alias("_cut")), allowMissingColumns=True)
    seen = F.sum("_cut").over(Window.partitionBy("asset_id").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return marks.withColumn("scene_id", seen + 1).filter("_cut = 0").drop("_cut")


def spread(intervals: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Adds span: a row for each stretch of so much time that an interval touches, for overlap joins by asset and span."""
    return intervals.withColumn("span", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(start, end) / width))))


def latest(points: DataFrame, marks: DataFrame, order: list, column: str) -> DataFrame:
    """Adds column: the value of the last mark at or before each point. One sorted pass over both.

    marks: asset_id, t and column; order decides among marks of one time, the last of which counts.
    """
    kind = marks.schema[column].dataType
    both = points.select(*points.columns, F.lit(1).alias("_ask"), F.lit(None).cast(kind).alias(column)).unionByName(marks.select("asset_id", "t", F.lit(0).alias("_ask"), column), allowMissingColumns=True)
    w = Window.partitionBy("asset_id").orderBy("t", "_ask", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(column, F.last(column, ignorenulls=True).over(w)).filter("_ask = 1").drop("_ask")


def nearest_line(frames: DataFrame, segments: DataFrame, key: str = "frame_id", width: float = 60.0) -> DataFrame:
    """key, seq: the segment nearest to each frame (0 inside it); ties go to the first. Frames without segments get null.

    The nearest segment is the first of those around the frame, the last to end before it or the first to begin
    after it. The latter two come from sorted passes, those around it from a join by asset and stretch of time.
    """
    f = frames.select(key, "asset_id", "t")
    s = segments.select("asset_id", "start_s", "end_s", "seq")
    line = F.struct("start_s", "seq", "end_s").alias("line")
    ended = latest(f, s.select("asset_id", F.col("end_s").alias("t"), line), [F.desc("line.start_s"), F.desc("line.seq")], "line").select(key, "t", "line")
    begun = at_or_after(f, s.select("asset_id", F.col("start_s").alias("t"), line), "line", ["line.start_s", "line.seq"]).select(key, "t", "line")
    around = f.withColumn("span", F.floor(F.col("t") / width)).join(spread(s, "start_s", "end_s", width), ["asset_id", "span"]).filter("t BETWEEN start_s AND end_s").select(key, "t", line)
    lo, hi = F.col("line.start_s"), F.col("line.end_s")
    far = F.when(F.col("t").between(lo, hi), 0.0).otherwise(F.least(F.abs(F.col("t") - lo), F.abs(F.col("t") - hi)))
    near = F.when(F.col("line").isNotNull(), F.struct(far.alias("far"), lo.alias("start_s"), F.col("line.seq").alias("seq")))
    return ended.unionByName(begun).unionByName(around).groupBy(key).agg(F.min(near).alias("best")).select(key, F.col("best.seq").alias("seq"))


def at_or_after(times: DataFrame, frames: DataFrame, column: str, order: list[str] = ()) -> DataFrame:
    """Adds column: the frame value of the first frame at or after t, null beyond the last. One sorted pass over both.

    order decides among frames of one time.
    """
    marks = times.select(*times.columns, F.lit(1).alias("_ask"), F.lit(None).cast(frames.schema[column].dataType).alias(column)).unionByName(frames.select("asset_id", "t", F.lit(0).alias("_ask"), column), allowMissingColumns=True)
    later = Window.partitionBy("asset_id").orderBy("t", F.desc("_ask"), *order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return marks.withColumn(column, F.first(column, ignorenulls=True).over(later)).filter("_ask = 1").drop("_ask")


def confirmed(times: DataFrame, frames: DataFrame, score, span: float = CONFIRM_SPAN, level: float = CONFIRM_LEVEL) -> DataFrame:
    """The times around which the frames differ by over level, and those without a frame on either side.

    score(before, after) gives a Column from two value columns; frames: asset_id, t, value.
    """
    asked = times.select("asset_id", "t").withColumn("at", F.col("t"))
    before = at_or_after(asked.withColumn("t", F.greatest(F.lit(0.0), F.col("at") - span)), frames, "value").select("asset_id", "at", F.col("value").alias("b"))
    after = at_or_after(asked.withColumn("t", F.col("at") + span), frames, "value").select("asset_id", "at", F.col("value").alias("a"))
    both = before.join(after, ["asset_id", "at"])
    return both.filter(F.col("a").isNull() | F.col("b").isNull() | (score(F.col("b"), F.col("a")) > level)).select("asset_id", F.col("at").alias("t"))


def protected(frames: DataFrame, wanted: DataFrame, near: float = PROTECT, closed: bool = False) -> DataFrame:
    """Adds protected: whether a wanted time lies within near (closed: or at it). The nearest wanted times on both sides decide."""
    marks = frames.select(*frames.columns, F.lit(0).alias("_w")).unionByName(wanted.select("asset_id", "t", F.lit(1).alias("_w")), allowMissingColumns=True)
    w = Window.partitionBy("asset_id").orderBy("t")
    at = F.when(F.col("_w") == 1, F.col("t"))
    before = F.max(at).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(at).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    inside = (lambda gap: gap <= near) if closed else (lambda gap: gap < near)
    hit = F.coalesce(inside(F.col("t") - F.col("_b")), F.lit(False)) | F.coalesce(inside(F.col("_e") - F.col("t")), F.lit(False))
    return marks.withColumn("_b", before).withColumn("_e", after).filter("_w = 0").withColumn("protected", hit).drop("_w", "_b", "_e")
