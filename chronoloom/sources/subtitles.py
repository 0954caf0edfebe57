"""Subtitles and transcripts: VTT and SRT cues, speech recognition JSON, track and file choice.

read() takes files with Spark's text reader, so any store that Spark reads serves; register() adds the
format "subtitles" for spark.read.format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronoloom.functions.scalars import cue_seconds, strip_tags

# A cue's time line, with or without hours, and codecs that hold pictures.
TIME = r"(\d{1,2}):(\d{2}):(\d{2})[.,](\d{1,3})\s*-->\s*(\d{1,2}):(\d{2}):(\d{2})[.,](\d{1,3})"
SHORT_TIME = r"(?:(\d{1,2}):)?(\d{1,2}):(\d{2})[.,](\d{1,3})\s*-->\s*(?:(\d{1,2}):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"
PICTURE_CODECS = ("dvd_subtitle", "hdmv_pgs_subtitle", "dvb_subtitle", "xsub")


def lines(files: DataFrame) -> DataFrame:
    """asset_id, text -> asset_id, line_no, line; any of the three line ends."""
    split = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    return files.select("asset_id", F.posexplode(split).alias("line_no", "line"))


def cues(numbered: DataFrame, short_times: bool = False) -> DataFrame:
    """The cues of numbered lines: asset_id, seq, start_s, end_s, text. A cue's text ends at an empty line or the next time.

    Tags are stripped, lines joined by a space, empty cues left out.
    """
    rule = SHORT_TIME if short_times else TIME
    part = lambda i: F.regexp_extract("line", rule, i)
    hour = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("0"))
    is_time = F.regexp_like("line", F.lit(rule))
    order = Window.partitionBy("asset_id").orderBy("line_no")
    # The cue a line belongs to; within it, lines after the first empty one are outside.
    marked = numbered.withColumn("_t", is_time).withColumn("_cue", F.sum(F.when(F.col("_t"), 1).otherwise(0)).over(order)).filter("_cue > 0")
    inside = Window.partitionBy("asset_id", "_cue").orderBy("line_no")
    blank = F.sum(F.when(~F.col("_t") & (F.trim("line") == ""), 1).otherwise(0)).over(inside)
    body = marked.withColumn("_blank", blank).filter("_t OR _blank = 0")
    said = F.trim(strip_tags(F.col("line")))
    found = body.groupBy("asset_id", "_cue").agg(
        F.max(F.when(F.col("_t"), F.round(cue_seconds(hour(1), part(2), part(3), part(4)), 3))).alias("start_s"),
        F.max(F.when(F.col("_t"), F.round(cue_seconds(hour(5), part(6), part(7), part(8)), 3))).alias("end_s"),
        F.array_sort(F.collect_list(F.when(~F.col("_t") & (said != ""), F.struct("line_no", said.alias("text"))))).alias("parts"),
    )
    return found.filter(F.size("parts") > 0).select("asset_id", F.col("_cue").cast("long").alias("seq"), "start_s", "end_s", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))


def parse(files: DataFrame, short_times: bool = False) -> DataFrame:
    """asset_id, text of whole subtitle files -> segments, rolling repeats collapsed."""
    from chronoloom.operators.folds import collapse_captions

    return collapse_captions(cues(lines(files), short_times))


def read(spark: SparkSession, path: str) -> DataFrame:
    """asset_id (the file's path) and text of each subtitle file under path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("asset_id"), F.col("value").alias("text"))


def chosen_file(files: DataFrame) -> DataFrame:
    """The file of each asset that is taken: the first of .vtt by name, then of .srt, that gave segments.

    files: asset_id, name, segments (a count).
    """
    rank = F.when(F.endswith("name", F.lit(".vtt")), 0).when(F.endswith("name", F.lit(".srt")), 1)
    good = files.filter("segments > 0").withColumn("_r", rank).filter("_r IS NOT NULL")
    return good.groupBy("asset_id").agg(F.min_by("name", F.struct("_r", "name")).alias("name"))


def pick_stream(streams: Column, language: Column) -> Column:
    """The subtitle track to take from an array of (order, codec, language): text codecs only, the wanted language first."""
    texts = F.filter(streams, lambda s: ~s["codec"].isin(*PICTURE_CODECS))
    want = F.substr(F.lower(language), F.lit(1), F.lit(2))
    match = F.filter(texts, lambda s: F.substr(F.lower(s["language"]), F.lit(1), F.lit(2)) == want)
    return F.coalesce(F.try_element_at(match, F.lit(1)), F.try_element_at(texts, F.lit(1)))


OFFSETS = "transcription array<struct<offsets:struct<`from`:long,`to`:long>,text:string>>"
SECONDS = "segments array<struct<start:double,end:double,text:string>>"


def recognised(runs: DataFrame) -> DataFrame:
    """asset_id, json of a recogniser -> asset_id, seq, start_s, end_s, text. Both forms are taken: offsets in
    milliseconds, and segments in seconds. Blank texts are left out; broken JSON gives none."""
    ms = F.transform(F.from_json("json", OFFSETS)["transcription"], lambda x: F.struct((x["offsets"]["from"] / 1000.0).alias("start_s"), (x["offsets"]["to"] / 1000.0).alias("end_s"), F.trim(x["text"]).alias("text")))
    s = F.transform(F.from_json("json", SECONDS)["segments"], lambda x: F.struct(x["start"].alias("start_s"), x["end"].alias("end_s"), F.trim(x["text"]).alias("text")))
    found = runs.select("asset_id", F.posexplode(F.coalesce(ms, s)).alias("seq", "x"))
    return found.select("asset_id", F.col("seq").cast("long").alias("seq"), F.round("x.start_s", 3).alias("start_s"), F.round("x.end_s", 3).alias("end_s"), F.col("x.text").alias("text")).filter("text <> ''")


# Flags by which a recogniser's help text is told, snake case first.
PYTHON_FLAGS = ("--output_format", "--model_dir", "--word_timestamps")
CPP_FLAGS = ("--output-json", "-oj,", "whisper.cpp", "-m fname", "--model fname")


def backend(help_text: Column) -> Column:
    """The kind of recogniser that a help text belongs to: python, cpp or null."""
    low = F.lower(help_text)
    says = lambda flags: F.exists(F.array(*[F.lit(f) for f in flags]), lambda f: F.contains(low, f))
    return F.when(says(PYTHON_FLAGS), "python").when(says(CPP_FLAGS), "cpp")


PROBE = "format struct<duration:string,size:string>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,duration:string>>"


def probed(files: DataFrame) -> DataFrame:
    """asset_id, json of a media probe -> duration, width, height, fps, codec, has_audio, size_bytes; files without video raise."""
    p = files.select("asset_id", F.from_json("json", PROBE).alias("p"))
    video = F.try_element_at(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(1))
    v = p.withColumn("v", F.coalesce(video, F.raise_error(F.concat(F.lit("no video stream: "), "asset_id")).cast(p.select(video.alias("v")).schema["v"].dataType)))
    rate = F.split(F.coalesce(F.nullif("v.avg_frame_rate", F.lit("")), "v.r_frame_rate"), "/", 2)  # a rate without a fraction counts as unknown
    over, under = F.try_element_at(rate, F.lit(1)).try_cast("double"), F.try_element_at(rate, F.lit(2)).try_cast("double")
    return v.select(
        "asset_id",
        F.round(F.coalesce(F.col("p.format.duration").try_cast("double"), F.col("v.duration").try_cast("double"), F.lit(0.0)), 3).alias("duration"),
        F.coalesce("v.width", F.lit(0)).alias("width"),
        F.coalesce("v.height", F.lit(0)).alias("height"),
        F.round(F.coalesce(F.try_divide(over, under), F.lit(0.0)), 3).alias("fps"),
        F.coalesce("v.codec_name", F.lit("?")).alias("codec"),
        F.exists("p.streams", lambda s: s["codec_type"] == "audio").alias("has_audio"),
        F.coalesce(F.col("p.format.size").try_cast("long"), F.lit(0)).alias("size_bytes"),
    )


def luma_log(log: DataFrame) -> DataFrame:
    """asset_id, line_no, line of a signal log -> asset_id, t, yavg: each YAVG line with the frame line before it."""
    order = Window.partitionBy("asset_id").orderBy("line_no")
    t = F.regexp_extract("line", r"pts_time:\s*(-?[\d.]+)", 1).try_cast("double")
    y = F.regexp_extract("line", r"YAVG=\s*([\d.]+)", 1).try_cast("double")
    rows = log.withColumn("_t", t).withColumn("yavg", y).withColumn("_n", F.sum(F.when(F.col("_t").isNotNull(), 1).otherwise(0)).over(order))
    return rows.groupBy("asset_id", "_n").agg(F.max("_t").alias("t"), F.min_by("yavg", F.when(F.col("yavg").isNotNull(), F.col("line_no"))).alias("yavg")).filter("t IS NOT NULL AND yavg IS NOT NULL").drop("_n")


class Subtitles(DataSource):
    """spark.read.format("subtitles").option("paths", ...): cues of local or mounted VTT and SRT files, before collapsing."""

    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def schema(self) -> str:
        return "asset_id string, line_no int, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with open(partition.value, encoding="utf-8", errors="replace", newline=None) as f:
            for i, line in enumerate(f):
                yield partition.value, i, line.rstrip("\n")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Subtitles)
