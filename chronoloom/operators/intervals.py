"""Intervals on timelines: shots, pacing, speech gaps and density, audio under gaps, structural suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import scalars
from chronoloom.operators.joins import latest, protected, spread

MIN_GAP = 2.0
NEAR_CUT = 0.25


def shots(assets: DataFrame, transitions: DataFrame) -> DataFrame:
    """asset_id, index (from 1), start, end, seconds: what lies between 0, the transitions inside, and the duration.

    assets: asset_id, duration. Shots of 0.01 s or less are left out before they are numbered.
    """
    marks = assets.select("asset_id", "duration", F.lit(0.0).alias("t")).unionByName(assets.select("asset_id", "duration", F.col("duration").alias("t")))
    inner = transitions.select("asset_id", "t").join(assets.select("asset_id", "duration"), "asset_id").filter("t > 0 AND t < duration").select("asset_id", "duration", "t")
    order = Window.partitionBy("asset_id").orderBy("t")
    spans = marks.unionByName(inner).withColumn("next", F.lead("t").over(order)).filter("next - t > 0.01")
    return spans.select("asset_id", F.row_number().over(order).cast("long").alias("index"), F.col("t").alias("start"), F.col("next").alias("end"), (F.col("next") - F.col("t")).alias("seconds"))


def pacing(found: DataFrame) -> DataFrame:
    """count, median, shortest, longest and longest_at (the first of the longest) for each asset."""
    return found.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.median("seconds").alias("median"),
        F.min("seconds").alias("shortest"),
        F.max("seconds").alias("longest"),
        F.min_by("start", F.struct(-F.col("seconds"), F.col("index"))).alias("longest_at"),
    )


def long_holds(found: DataFrame, times: float = 2.0) -> DataFrame:
    """Shots longer than so many times their asset's mean: their number and their share of the run time."""
    mean = F.avg("seconds").over(Window.partitionBy("asset_id"))
    long = found.withColumn("held", F.col("seconds") > times * mean)
    return long.groupBy("asset_id").agg(F.count(F.when(F.col("held"), 1)).alias("holds"), (F.sum(F.when(F.col("held"), F.col("seconds")).otherwise(0.0)) / F.sum("seconds")).alias("share"))


def _reach(segments: DataFrame) -> DataFrame:
    """Segments with an end, and how far the earlier ones of their asset reach."""
    order = Window.partitionBy("asset_id").orderBy("start_s", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return segments.filter("end_s IS NOT NULL AND end_s <> 0").withColumn("reach", F.max("end_s").over(order))


def speech_gaps(assets: DataFrame, segments: DataFrame, min_gap: float = MIN_GAP) -> DataFrame:
    """asset_id, start, end, seconds, where_: stretches of at least min_gap without speech, head and tail included."""
    spoken = segments.join(assets.filter("duration > 0").select("asset_id", "duration"), "asset_id")
    reach = _reach(spoken)
    inner = reach.select("asset_id", F.coalesce("reach", F.lit(0.0)).alias("start"), F.col("start_s").alias("end"), F.when(F.col("reach").isNull(), "opening").otherwise("mid").alias("where_"))
    tails = assets.filter("duration > 0").join(reach.groupBy("asset_id").agg(F.max("end_s").alias("last")), "asset_id", "left")
    tail = tails.select("asset_id", F.coalesce("last", F.lit(0.0)).alias("start"), F.col("duration").alias("end"), F.when(F.col("last").isNull(), "whole clip").otherwise("ending").alias("where_"))
    gaps = inner.unionByName(tail).withColumn("seconds", F.col("end") - F.col("start"))
    return gaps.filter(F.col("seconds") >= min_gap).select("asset_id", "start", "end", "seconds", "where_")


def speech_density(assets: DataFrame, segments: DataFrame) -> DataFrame:
    """The share of each asset's duration that the union of its segments covers, 1 at most."""
    reach = _reach(segments)
    order = Window.partitionBy("asset_id").orderBy("start_s", "seq")
    islands = reach.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("start_s") > F.col("reach")), 1).otherwise(0)).over(order))
    spans = islands.groupBy("asset_id", "island").agg((F.max("end_s") - F.min("start_s")).alias("seconds"))
    spoken = spans.groupBy("asset_id").agg(F.sum("seconds").alias("spoken"))
    share = F.least(F.lit(1.0), F.coalesce("spoken", F.lit(0.0)) / F.col("duration"))
    return assets.join(spoken, "asset_id", "left").select("asset_id", F.when(F.col("duration") > 0, share).otherwise(0.0).alias("density"))


def annotate_audio(gaps: DataFrame, silence: DataFrame, assets: DataFrame | None = None, width: float = 60.0) -> DataFrame:
    """Adds silent_fraction and audio to gaps. Overlapping silence spans count twice.

    Gaps and spans meet by asset and stretch of time, each pair in the first stretch that both touch, so a long
    timeline isn't paired with itself. assets (asset_id, has_audio) marks those without a track.
    """
    key = ["asset_id", "start", "end"]
    spans = spread(silence.select("asset_id", F.col("start_s").alias("s0"), F.col("end_s").alias("s1")), "s0", "s1", width)
    met = spread(gaps.select(*key), "start", "end", width).join(spans, ["asset_id", "span"])
    met = met.filter((F.col("s0") < F.col("end")) & (F.col("s1") > F.col("start")) & (F.col("span") == F.floor(F.greatest("start", "s0") / width)))
    quiet = met.groupBy(*key).agg(F.sum(F.least("end", "s1") - F.greatest("start", "s0")).alias("_quiet"))
    out = gaps.join(quiet, key, "left").withColumn("silent_fraction", F.coalesce("_quiet", F.lit(0.0)) / F.col("seconds")).drop("_quiet")
    state = F.when(F.col("silent_fraction") >= 0.6, "silent").when(F.col("silent_fraction") >= 0.2, "partly silent").otherwise("audio playing")
    if assets is None:
        return out.withColumn("audio", state)
    out = out.join(assets.select("asset_id", "has_audio"), "asset_id", "left")
    mute = F.col("has_audio") == F.lit(False)
    return out.withColumn("audio", F.when(mute, "no audio track").otherwise(state)).withColumn("silent_fraction", F.when(mute, 1.0).otherwise(F.col("silent_fraction"))).drop("has_audio")


def between_segments(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """The spans that lie wholly between two neighbouring segments (the neighbour's end, not the farthest).

    Pauses between neighbours don't overlap, so only the last one to begin before a span can hold it.
    """
    nxt = F.lead("start_s").over(Window.partitionBy("asset_id").orderBy("start_s", "seq"))
    pauses = segments.withColumn("until", nxt).filter("until IS NOT NULL AND end_s <= until").select("asset_id", F.col("end_s").alias("t"), "until")
    asked = spans.withColumn("_t", F.col("t") if "t" in spans.columns else F.lit(None).cast("double")).withColumn("t", F.col("start_s"))
    held = latest(asked, pauses, ["until"], "until").filter(F.col("end_s") <= F.col("until")).withColumn("t", F.col("_t"))
    return held.select(*spans.columns)


def suppressed(hits: DataFrame, cuts: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds suppression: why known structure explains a hit, or null. hits: hit_id, asset_id, t, kind, start_s, end_s."""
    at_cut = protected(hits.filter("kind = 'luma-spike'").select("hit_id", "asset_id", "t"), cuts, NEAR_CUT, closed=True).filter("protected").select("hit_id", F.lit("confirmed-scene-cut").alias("suppression"))
    paused = between_segments(hits.filter("kind = 'silence' AND start_s IS NOT NULL AND end_s IS NOT NULL").select("hit_id", "asset_id", "start_s", "end_s"), segments).select("hit_id", F.lit("between-transcript-segments").alias("suppression"))
    # Hits that share an id are explained alike, and stay as many as they are.
    reasons = at_cut.withColumn("kind", F.lit("luma-spike")).unionByName(paused.withColumn("kind", F.lit("silence"))).distinct()
    return hits.join(reasons, ["hit_id", "kind"], "left").select(*hits.columns, "suppression")


def clip(segments: DataFrame, start: float, end: float) -> DataFrame:
    """Segments that touch a closed window."""
    return segments.filter((F.col("start_s") <= end) & (F.col("end_s") >= start))


def rendered(segments: DataFrame, start: float = 0.0, end: float | None = None) -> DataFrame:
    """asset_id, transcript: a line "[time] text" for each segment that touches a closed window, in order of seq."""
    inside = segments.filter((F.col("end_s") >= start) & (F.col("start_s") <= end if end is not None else F.lit(True)))
    line = F.concat(F.lit("["), scalars.format_time(F.col("start_s")), F.lit("] "), F.coalesce("text", F.lit("")))
    said = F.array_sort(F.collect_list(F.struct("seq", "start_s", line.alias("line"))))
    return inside.groupBy("asset_id").agg(F.array_join(F.transform(said, lambda x: x["line"]), "\n").alias("transcript"))


def hook(segments: DataFrame, seconds: float = 3.0) -> DataFrame:
    """What is said by segments that begin in the first seconds, joined in order."""
    early = segments.filter((F.col("start_s") < seconds) & (F.trim("text") != ""))
    said = F.array_sort(F.collect_list(F.struct("start_s", "seq", F.trim("text").alias("text"))))
    return early.groupBy("asset_id").agg(F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("hook"))
