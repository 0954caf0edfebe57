"""Run caches as tables: entries, eviction, reuse of cut windows and transcripts, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP = 20_000_000_000


def entries(files: DataFrame) -> DataFrame:
    """key, bytes, files, last_used of each cache folder; the models folder is none. files: key, bytes, used."""
    return files.filter("key <> 'models'").groupBy("key").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"), F.max("used").alias("last_used"))


def totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes"), (F.sum("bytes") / 1e9).alias("gb"))


def evicted(found: DataFrame, cap: float = CAP, age: Column | None = None) -> DataFrame:
    """The entries to drop, oldest first, until the rest fits: those whose running sum from the newest exceeds cap.

    age is any falling function of last_used, a day by default: sums are taken by age first, so that only one
    row for each age, and not every entry, is ordered in one task.
    """
    rows = found.withColumn("_age", age if age is not None else F.to_date("last_used"))
    ages = rows.groupBy("_age").agg(F.sum("bytes").alias("_sum"))
    newer = Window.orderBy(F.desc("_age")).rowsBetween(Window.unboundedPreceding, -1)
    ages = ages.select("_age", F.coalesce(F.sum("_sum").over(newer), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_age").orderBy(F.desc("last_used"), "key").rowsBetween(Window.unboundedPreceding, 0)
    running = F.col("_base") + F.sum("bytes").over(inside)
    return rows.join(ages, "_age").withColumn("running", running).filter(F.col("running") > cap).drop("_age", "_base")


def purged(found: DataFrame, key: str | None = None) -> DataFrame:
    """What stays after one entry, or all (no key, or "all"), are deleted; an unknown key is an error, known only by a look."""
    if key is None or key == "all":
        return found.limit(0)
    if found.filter(F.col("key") == key).isEmpty():
        raise KeyError(f"no cache entry {key!r}")
    return found.filter(~F.col("key").eqNullSafe(F.lit(key)))


def reused_windows(asks: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds window_id to asks: the first stored window that holds the asked one, null where cuts must be found anew.

    asks: ask_id, asset_id, start_s, end_s (null: to the end), threshold; windows: asset_id, window_id, w_start, w_end, w_threshold.
    """
    w = windows.select(F.col("asset_id").alias("_a"), "window_id", "w_start", "w_end", "w_threshold")
    holds = (
        (F.col("asset_id") == F.col("_a"))
        & (F.abs(F.col("w_threshold") - F.col("threshold")) < 1e-9)
        & (F.col("w_start") <= F.col("start_s") + 0.01)
        & (F.col("w_end").isNull() | (F.col("w_end") >= F.col("end_s") - 0.01))
    )
    best = asks.join(w, holds).groupBy("ask_id").agg(F.min("window_id").alias("window_id"))
    return asks.join(best, "ask_id", "left")


def reusable(source: Column, segments: Column, params: Column, wanted: Column) -> Column:
    """Whether a cached transcript answers a request: it isn't empty, and was made alike, or holds captions or an
    embedded track of the wanted language. params and wanted: structs of whisper, model, language, sub_langs."""
    same = (params["whisper"].eqNullSafe(wanted["whisper"])) & params["model"].eqNullSafe(wanted["model"]) & params["language"].eqNullSafe(wanted["language"]) & params["sub_langs"].eqNullSafe(wanted["sub_langs"])
    captions = (source == "captions") & params["sub_langs"].eqNullSafe(wanted["sub_langs"])
    embedded = (source == "embedded") & params["language"].eqNullSafe(wanted["language"])
    return F.coalesce((segments > 0) & (same | captions | embedded), F.lit(False))


# Sources of a transcript in the order in which they are tried.
PRIORITY = ("cached", "captions", "embedded", "none", "no audio track", "asr")


def chosen_transcript(found: DataFrame) -> DataFrame:
    """asset_id, source, segments, stored: the first source that gives segments; an empty result is never stored.

    found: asset_id, source, segments (a count), and per asset use_asr and has_audio.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in PRIORITY]), F.col("source"))
    usable = (F.col("segments") > 0) & ((F.col("source") != "asr") | (F.col("use_asr") & F.col("has_audio")))
    out = found.groupBy("asset_id").agg(
        F.min_by(F.when(usable, F.struct("source", "segments")), F.when(usable, rank)).alias("best"), F.max("use_asr").alias("use_asr"), F.max("has_audio").alias("has_audio")
    )
    empty = F.when(~F.col("use_asr"), "none").when(~F.col("has_audio"), "no audio track").otherwise("asr")
    return out.select("asset_id", F.coalesce("best.source", empty).alias("source"), F.coalesce("best.segments", F.lit(0)).cast("long").alias("segments"), F.col("best").isNotNull().alias("stored"))


def stale_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of an old manifest that the new one doesn't name and that don't leave the folder."""
    safe = old.filter(~F.startswith("path", F.lit("/")) & ~F.array_contains(F.split("path", "/"), ".."))
    return safe.join(new.select("path"), "path", "left_anti").distinct()
