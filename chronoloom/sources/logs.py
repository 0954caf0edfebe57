"""What media tools print, as tables: packet times, subtitle tracks, remote metadata, filter logs.

Nothing here runs a tool. Each function takes what one has written, one row per asset (JSON) or per line
(asset_id, line_no, line), and nulls, broken JSON and other lines give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the filters' lines look like.
NUMBER = r"(-?[0-9.]+)"
BLACK_LINE = rf"black_start:{NUMBER}\s+black_end:{NUMBER}\s+black_duration:([0-9.]+)"
MARKS = {"freeze": (rf"freeze_start:\s*{NUMBER}", rf"freeze_end:\s*{NUMBER}"), "silence": (rf"silence_start:\s*{NUMBER}", rf"silence_end:\s*{NUMBER}")}
SHOWN_TIME = r"pts_time:([0-9.]+)"

PACKETS = "packets array<struct<pts_time:string>>"
TRACKS = "streams array<struct<index:int,codec_name:string,tags:struct<language:string,title:string>>>"
REMOTE = "title string, duration string, uploader string, width int, height int, subtitles map<string,string>, automatic_captions map<string,string>"


def packet_times(files: DataFrame) -> DataFrame:
    """asset_id, json of a packet listing -> asset_id, pts: the distinct times; packets without a readable one are skipped."""
    p = files.select("asset_id", F.explode(F.from_json("json", PACKETS)["packets"]).alias("p"))
    return p.select("asset_id", F.col("p.pts_time").try_cast("double").alias("pts")).filter("pts IS NOT NULL").distinct()


def subtitle_tracks(files: DataFrame) -> DataFrame:
    """asset_id, json of a track listing -> asset_id, order (among subtitle tracks), index, codec, language, title."""
    s = files.select("asset_id", F.posexplode(F.from_json("json", TRACKS)["streams"]).alias("order", "s"))
    return s.select(
        "asset_id",
        "order",
        F.col("s.index").alias("index"),
        F.coalesce("s.codec_name", F.lit("?")).alias("codec"),
        F.lower(F.coalesce("s.tags.language", F.lit(""))).alias("language"),
        F.coalesce("s.tags.title", F.lit("")).alias("title"),
    )


def remote_metadata(files: DataFrame) -> DataFrame:
    """asset_id, json of a remote description -> title, duration, uploader, width, height, and the languages, sorted, of
    subtitles made by hand (manual_subs) and by machine (auto_subs). Broken JSON gives the values of an empty object."""
    m = files.select("asset_id", F.from_json("json", REMOTE).alias("m"))
    keys = lambda name: F.coalesce(F.array_sort(F.map_keys(F.col(f"m.{name}"))), F.array().cast("array<string>")).alias
    return m.select(
        "asset_id",
        F.coalesce("m.title", F.lit("")).alias("title"),
        F.coalesce(F.col("m.duration").try_cast("double"), F.lit(0.0)).alias("duration"),
        F.coalesce("m.uploader", F.lit("")).alias("uploader"),
        F.coalesce("m.width", F.lit(0)).alias("width"),
        F.coalesce("m.height", F.lit(0)).alias("height"),
        keys("subtitles")("manual_subs"),
        keys("automatic_captions")("auto_subs"),
    )


def _number(pattern: str, group: int = 1):
    return F.regexp_extract("line", pattern, group).try_cast("double")


def black_spans(log: DataFrame) -> DataFrame:
    """asset_id, start_s, end_s, seconds of the dark spans a log names."""
    found = log.select("asset_id", *[_number(BLACK_LINE, i + 1).alias(c) for i, c in enumerate(("start_s", "end_s", "seconds"))])
    return found.dropna(subset=["start_s", "end_s", "seconds"])


def marks(log: DataFrame, kind: str) -> DataFrame:
    """asset_id, mark (start or end), t of a freeze or silence log; detectors.pair_freezes and pair_silences pair them."""
    start, end = (_number(p) for p in MARKS[kind])
    both = F.array(F.struct(F.lit("start").alias("mark"), start.alias("t")), F.struct(F.lit("end").alias("mark"), end.alias("t")))
    return log.select("asset_id", F.inline(both)).filter("t IS NOT NULL")


def shown_cuts(log: DataFrame, start: float = 0.0, end: float | None = None) -> DataFrame:
    """asset_id, t: the distinct times, to the millisecond, of the frames a scene filter let through in a closed window."""
    t = _number(SHOWN_TIME)
    found = log.select("asset_id", t.alias("t")).filter((F.col("t") >= start) & (F.col("t") <= end if end is not None else F.lit(True)))
    return found.select("asset_id", F.round("t", 3).alias("t")).distinct()
