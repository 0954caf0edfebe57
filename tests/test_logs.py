"""What media tools print: nulls, broken JSON and foreign lines give no rows; names and settings."""

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import scalars as S
from chronoloom.operators import cache, detectors, intervals
from chronoloom.sources import logs, subtitles

JSON, LOG = "asset_id string, json string", "asset_id string, line_no int, line string"


def test_packet_times(spark):
    rows = [("a", '{"packets":[{"pts_time":"0.5"},{"pts_time":"N/A"},{},{"pts_time":"0.5"},{"pts_time":"0.1"}]}'), ("b", "{}"), ("c", "junk"), ("d", None)]
    assert sorted((r.asset_id, r.pts) for r in logs.packet_times(spark.createDataFrame(rows, JSON)).collect()) == [("a", 0.1), ("a", 0.5)]
    assert logs.packet_times(spark.createDataFrame([], JSON)).count() == 0


def test_subtitle_tracks_feed_the_choice(spark):
    text = '{"streams":[{"index":2,"codec_name":"dvd_subtitle","tags":{"language":"GER"}},{"index":3,"codec_name":"subrip","tags":{"language":"ENG","title":"x"}},{"index":4}]}'
    tracks = logs.subtitle_tracks(spark.createDataFrame([("a", text), ("b", "{"), ("c", None)], JSON))
    assert [tuple(r) for r in tracks.orderBy("order").collect()] == [("a", 0, 2, "dvd_subtitle", "ger", ""), ("a", 1, 3, "subrip", "eng", "x"), ("a", 2, 4, "?", "", "")]
    found = tracks.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("order", "codec", "language"))).alias("s"))
    assert found.select(subtitles.pick_stream(F.col("s"), F.lit("de"))["order"]).first()[0] == 1


def test_remote_metadata(spark):
    rows = [("a", '{"title":"t","duration":12.5,"width":640,"subtitles":{"en":[{"u":1}],"de":[]},"automatic_captions":null}'), ("b", "{}"), ("c", "junk")]
    out = {r.asset_id: tuple(r)[1:] for r in logs.remote_metadata(spark.createDataFrame(rows, JSON)).collect()}
    assert out["a"] == ("t", 12.5, "", 640, 0, ["de", "en"], [])
    assert out["b"] == out["c"] == ("", 0.0, "", 0, 0, [], [])


def test_filter_logs(spark):
    lines = ["[x] black_start:1 black_end:1.5 black_duration:0.5", "freeze_start: 2", "freeze_duration: 3", "freeze_end: 5 | freeze_duration: 3", "freeze_start: 8", "silence_start: -0.01", "silence_end: 4 | silence_duration: 4", "silence_start: 9", "showinfo pts_time:7.0004 x", "pts_time:7.0001", None, ""]
    log = spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)], LOG)
    assert [tuple(r) for r in logs.black_spans(log).collect()] == [("a", 1.0, 1.5, 0.5)]
    assets = spark.createDataFrame([("a", 10.0)], "asset_id string, duration double")
    freezes = detectors.pair_freezes(logs.marks(log, "freeze"), assets)
    assert sorted(tuple(r)[1:] for r in freezes.collect()) == [(2.0, 5.0), (8.0, 10.0)]
    assert [tuple(r)[1:] for r in detectors.pair_silences(logs.marks(log, "silence")).collect()] == [(-0.01, 4.0)]
    assert [r.t for r in logs.shown_cuts(log).collect()] == [7.0] and logs.shown_cuts(log, 8.0).count() == 0


def test_probe_falls_back(spark):
    def first(video):
        return subtitles.probed(spark.createDataFrame([("a", '{"streams":[{"codec_type":"video"%s}]}' % video)], JSON)).first()

    r = first("")
    assert (r.duration, r.width, r.height, r.fps, r.codec, r.has_audio, r.size_bytes) == (0.0, 0, 0, 0.0, "?", False, 0)
    assert first(',"r_frame_rate":"25/1"').fps == 25.0 and first(',"avg_frame_rate":"30"').fps == 0.0 and first(',"avg_frame_rate":"0/0"').fps == 0.0


def test_rendered_transcript(spark):
    rows = [("a", 2, 65.4, 70.0, "two"), ("a", 1, 3.0, 4.0, "one"), ("a", 3, 4000.0, 4001.0, None), ("b", 1, 1.0, 2.0, "x")]
    segments = spark.createDataFrame(rows, "asset_id string, seq long, start_s double, end_s double, text string")
    out = {r.asset_id: r.transcript for r in intervals.rendered(segments).collect()}
    assert out == {"a": "[00:03] one\n[01:05] two\n[1:06:40] ", "b": "[00:01] x"}
    assert [r.transcript for r in intervals.rendered(segments, 4.0, 65.4).collect()] == ["[00:03] one\n[01:05] two"]


def test_names_and_settings(spark):
    said = ["/a/b.c.mp4", "x" * 80 + ".mp4", ".mp4", "a.", "https://h/v/", "", None]
    df = spark.createDataFrame(list(enumerate(said)), "i int, s string").orderBy("i")
    assert [r[0] for r in df.select(S.clip_stem(F.col("s"))).collect()] == ["b.c", "x" * 60, ".mp4", "a.", "v", "clip", "clip"]
    assert spark.range(1).select(S.handoff_name(F.lit(3), F.lit(65.9))).first()[0] == "03_01m05s.jpg"
    assert [S.prescale(x) for x in (None, "off", " 0 ", "320", "-5", "wide")] == [160, 0, 0, 320, 0, 160]


def test_purge_of_an_unknown_key(spark):
    entries = spark.createDataFrame([("k",), (None,)], "key string")
    assert cache.purged(entries, "k").count() == 1 and cache.purged(entries, "all").count() == 0
    with pytest.raises(KeyError, match="no cache entry"):
        cache.purged(entries, "other")
