"""Timeline operators against goldens and slow, plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import cache, detectors, findings, folds, intervals, joins, likeness, series
from chronoloom.plans import pipelines
from chronoloom.sources import subtitles
from chronoloom.streaming import detect

SEG = "asset_id string, seq long, start_s double, end_s double, text string"


def segs(spark, *spans, asset="a"):
    return spark.createDataFrame([(asset, i, float(s), None if e is None else float(e), "x") for i, (s, e) in enumerate(spans)], SEG)


def assets(spark, duration, asset="a"):
    return spark.createDataFrame([(asset, float(duration), "captions", "scene", True)], "asset_id string, duration double, source string, cut_method string, has_audio boolean")


def cuts(spark, *times, asset="a"):
    return spark.createDataFrame([(asset, float(t)) for t in times], "asset_id string, t double")


def test_an_ad_timeline(spark):
    a, t = assets(spark, 79.3), cuts(spark, 9.14, 18.52)
    shots = intervals.shots(a, t)
    assert [round(r.seconds, 2) for r in shots.orderBy("index").collect()] == [9.14, 9.38, 60.78]
    p = intervals.pacing(shots).collect()[0]
    assert (p["count"], p.longest_at, round(p.median, 2)) == (3, 18.52, 9.38)
    gaps = intervals.speech_gaps(a, segs(spark, (0, 5.4), (9.8, 17.4), (24.7, 31.0))).collect()
    assert {(round(g.start, 2), round(g.seconds, 2), g.where_) for g in gaps} == {(5.4, 4.4, "mid"), (17.4, 7.3, "mid"), (31.0, 48.3, "ending")}


def test_cuts_outside_the_clip(spark):
    assert [r.seconds for r in intervals.shots(assets(spark, 10), cuts(spark, -5, 3, 999)).orderBy("index").collect()] == [3, 7]


def test_density_and_gaps(spark):
    assert intervals.speech_density(assets(spark, 16), segs(spark, (0, 5), (3, 8))).first().density == 0.5
    assert intervals.speech_density(assets(spark, 16), segs(spark, (0, None))).first().density == 0.0
    where = lambda *s, d=20: sorted(r.where_ for r in intervals.speech_gaps(assets(spark, d), segs(spark, *s)).collect())
    assert where((5, 8)) == ["ending", "opening"] and where((1, None), d=30) == ["whole clip"] and where((0, 0), d=30) == ["whole clip"]


def test_audio_under_gaps(spark):
    gap = spark.createDataFrame([("a", 4.0, 20.0, 16.0, "mid")], "asset_id string, start double, end double, seconds double, where_ string")
    span = lambda *s: spark.createDataFrame([("b", 0.0, 99.0), *[("a", float(x), float(y)) for x, y in s]], "asset_id string, start_s double, end_s double")
    state = lambda *s: (lambda r: (r.audio, r.silent_fraction))(intervals.annotate_audio(gap, span(*s)).first())
    assert state() == ("audio playing", 0.0) and state((5, 15))[0] == "silent" and state((12, 18))[0] == "partly silent"
    mute = assets(spark, 30).withColumn("has_audio", F.lit(False))
    assert intervals.annotate_audio(gap, span(), mute).first().audio == "no audio track"


def test_clusters(spark):
    burst = [9.142, 9.2, 9.35, 9.5, 61.161, 61.2, 61.3, 61.5, 61.6]
    run = lambda *t: sorted(r.t for r in folds.cluster(cuts(spark, *t)).collect())
    assert run(*burst) == [9.142, 61.161] and run(5, 1, 1.2, 9) == [1, 5, 9] and run(*run(*burst)) == run(*burst)


def plain_clusters(times, window):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] > window:
            out.append(t)
    return out


def test_clusters_and_gaps_of_random_timelines(spark):
    rng = random.Random(3)
    times, spans = [], []
    for a in range(40):
        times += [(str(a), round(rng.uniform(0, 30), 1)) for _ in range(rng.randint(0, 60))]
        for i in range(rng.randint(0, 12)):
            s = round(rng.uniform(0, 50), 1)
            spans.append((str(a), i, s, s + rng.choice([0.0, 1.5, 6.0]), "x"))
    got = {}
    for r in folds.cluster(spark.createDataFrame(times, "asset_id string, t double")).collect():
        got.setdefault(r.asset_id, []).append(r.t)
    assert {a: sorted(t) for a, t in got.items()} == {a: plain_clusters([t for x, t in times if x == a], 0.5) for a in {x for x, _ in times}}
    a = spark.createDataFrame([(str(i), 60.0) for i in range(40)], "asset_id string, duration double")
    s = spark.createDataFrame(spans, SEG)
    gap = {r.asset_id: r.g for r in intervals.speech_gaps(a, s, 1e-9).groupBy("asset_id").agg(F.sum("seconds").alias("g")).collect()}
    dense = {r.asset_id: r.density for r in intervals.speech_density(a, s).collect()}
    for k in map(str, range(40)):
        assert abs(gap.get(k, 0.0) + 60 * dense[k] - 60) < 1e-6


def test_merging(spark):
    hits = spark.createDataFrame([("a", 1.0, "luma-spike", "high"), ("a", 1.25, "black", "medium"), ("a", 1.26, "silence", "low"), ("a", 3.0, "silence", "low")], "asset_id string, t double, kind string, severity string")
    got = [(r.t, r.kind, r.severity, len(r.hits)) for r in folds.merge_hits(hits).orderBy("t").collect()]
    assert got == [(1.0, "black+luma-spike", "high", 2), (1.26, "silence", "low", 1), (3.0, "silence", "low", 1)]


def test_last_kept_dedup(spark):
    pics = [0.0, 1.0, 2.0, 3.0, 3.5, 9.0, 9.5]
    f = spark.createDataFrame([("a", float(i), [v] * 16, i == 3) for i, v in enumerate(pics)] + [("b", 0.0, [1.0] * 16, False), ("b", 1.0, [1.0] * 16, False), ("c", 0.0, [1.0], False), ("c", 1.0, [1.0] * 16, False), ("c", 2.0, [1.0] * 16, False)], "asset_id string, t double, thumb array<double>, protected boolean")
    rows = folds.dedup_frames(f, 2.0, 4, 2).collect()
    kept = {a: sorted(r.t for r in rows if r.asset_id == a and r.kept) for a in "abc"}
    # 2.0 is at the threshold and goes; 3.0 is protected and becomes the reference; the last stays.
    assert kept == {"a": [0.0, 3.0, 5.0, 6.0], "b": [0.0, 1.0], "c": [0.0, 1.0, 2.0]}


def plain_captions(texts):
    out = []
    for i, text in enumerate(texts):
        if out:
            old = out[-1][1]
            if text == old:
                out[-1][2] = i
                continue
            if text.startswith(old) and len(old) > 8:
                out[-1][1:] = [text, i]
                continue
            if old.endswith(text) and len(text) > 8:
                out[-1][2] = i
                continue
        out.append([i, text, i])
    return [tuple(x) for x in out]


def test_rolling_captions(spark):
    rng = random.Random(5)
    words = "the quick brown fox jumps over lazy dogs".split()
    rows, want = [], {}
    for a in range(30):
        texts = []
        for _ in range(rng.randint(1, 25)):
            last = texts[-1] if texts else ""
            texts.append(rng.choice([last or "x", (last + " " + rng.choice(words)).strip(), " ".join(last.split()[-3:]) or "y", " ".join(rng.sample(words, 4))]))
        want[str(a)] = [(float(s), t, float(e)) for s, t, e in plain_captions(texts)]
        rows += [(str(a), i, float(i), float(i), t) for i, t in enumerate(texts)]
    got = {}
    for r in folds.collapse_captions(spark.createDataFrame(rows, SEG)).orderBy("asset_id", "seq").collect():
        got.setdefault(r.asset_id, []).append((r.start_s, r.text, r.end_s))
    assert got == want


VTT = "WEBVTT\r\n\r\n1\r\n00:00:01.000 --> 00:00:02.500\r\n<c>the quick brown</c>\r\n\r\n00:00:02.500 --> 00:00:04.000\nthe quick brown fox jumps\n\nnote\n00:00:05,5 --> 00:00:06,25\n \n00:01.000 --> 00:02.000\nshort\n00:00:07.000 --> 00:00:08.000\nTwo\nlines"


def test_subtitles(spark):
    rows = subtitles.parse(spark.createDataFrame([("v", VTT), ("none", "no cues")], "asset_id string, text string")).orderBy("seq").collect()
    assert [(r.start_s, r.end_s, r.text) for r in rows] == [(1.0, 4.0, "the quick brown fox jumps"), (7.0, 8.0, "Two lines")]
    assert subtitles.parse(spark.createDataFrame([("v", VTT)], "asset_id string, text string"), short_times=True).count() == 3


def test_subtitle_source(spark, tmp_path):
    (tmp_path / "a.vtt").write_text(VTT)
    subtitles.register(spark)
    lines = spark.read.format("subtitles").option("paths", str(tmp_path / "a.vtt")).load()
    assert subtitles.cues(lines).count() == 3
    assert subtitles.parse(subtitles.read(spark, str(tmp_path))).count() == 2


def test_probe_and_recogniser_json(spark):
    probe = '{"format":{"duration":"12.3456","size":"99"},"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":640,"height":360,"avg_frame_rate":"30000/1001"}]}'
    r = subtitles.probed(spark.createDataFrame([("a", probe)], "asset_id string, json string")).first()
    assert (r.duration, r.width, r.fps, r.codec, r.has_audio, r.size_bytes) == (12.346, 640, 29.97, "h264", True, 99)
    with pytest.raises(Exception, match="no video stream"):
        subtitles.probed(spark.createDataFrame([("a", '{"streams":[]}')], "asset_id string, json string")).collect()
    said = spark.createDataFrame([("a", '{"transcription":[{"offsets":{"from":0,"to":1500},"text":" hi "},{"offsets":{"from":1,"to":2},"text":" "}]}'), ("b", '{"segments":[{"start":1.0,"end":2.0,"text":"yo"}]}'), ("c", "junk")], "asset_id string, json string")
    assert [(r.asset_id, r.end_s, r.text) for r in subtitles.recognised(said).orderBy("asset_id").collect()] == [("a", 1.5, "hi"), ("b", 2.0, "yo")]
    log = spark.createDataFrame([("a", i, x) for i, x in enumerate(["frame:0 pts:0 pts_time:0.5", "lavfi.signalstats.YAVG=16.2", "frame:1 pts_time:1.0", "other", "YAVG=20"])], "asset_id string, line_no int, line string")
    assert sorted((r.t, r.yavg) for r in subtitles.luma_log(log).collect()) == [(0.5, 16.2), (1.0, 20.0)]
    helps = spark.createDataFrame([("--output_format txt",), ("-oj, --output-json",), ("?",)], "h string")
    assert [r[0] for r in helps.select(subtitles.backend(F.col("h"))).collect()] == ["python", "cpp", None]


def luma(spark, values, step=1 / 30):
    return spark.createDataFrame([("a", i * step, float(v)) for i, v in enumerate(values)], "asset_id string, t double, yavg double")


def test_planted_defects(spark):
    flash = luma(spark, [200.0] * 27 + [5.0] * 5 + [200.0] * 28)
    black = detectors.black(flash).collect()
    assert [(r.severity, round(r.t, 2), round(r.duration, 2)) for r in black] == [("high", 0.9, 0.17)]
    spikes = detectors.luma_spikes(flash)
    assert spikes.count() == 2 and folds.merge_hits(detectors.located([spikes, detectors.black(flash)])).count() == 1
    assert detectors.luma_spikes(luma(spark, [100, 100, 139, 139, 100])).count() == 0
    impulse = detectors.luma_spikes(luma(spark, [100, 139.0, 95, 100], 1.0), edge=41).collect()
    assert impulse[0].form == "impulse"
    pts = [i / 30 for i in range(30)] + [i / 30 + 0.5 for i in range(30, 60)]
    gap = detectors.pts_gaps(spark.createDataFrame([("a", p, True) for p in pts] + [("b", 0.0, True), ("b", 9.0, True)], "asset_id string, pts double, is_key boolean")).collect()
    assert len(gap) == 1 and gap[0].gap >= 0.5 and abs(gap[0].expected - 1 / 30) < 1e-6
    still = spark.createDataFrame([("a", i / 10, 0.0 if 15 <= i < 26 else 5.0) for i in range(40)], "asset_id string, t double, change double")
    assert [(round(r.t, 2), round(r.duration, 2), r.severity) for r in detectors.freeze(still, 0.1).collect()] == [(1.5, 1.1, "medium")]
    clean = luma(spark, [100 + i % 7 for i in range(120)])
    assert detectors.black(clean).count() == detectors.luma_spikes(clean).count() == 0


def test_duplicate_shot(spark):
    pic = {"r": [10.0] * 16, "b": [90.0] * 16}
    reps = spark.createDataFrame([("a", i, float(i), i + 1.0, pic[p]) for i, p in enumerate("rbr")] + [("z", i, float(i), i + 1.0, pic["r"]) for i in range(2)], "asset_id string, index int, start_s double, end_s double, thumb array<double>")
    assert [(r.asset_id, r.t, r.matched, r.tile_delta) for r in detectors.duplicate_shots(reps, 4, 2).collect()] == [("a", 2.0, 0.0, 0.0)]


def brute_duplicates(pictures, side, tile, limit):
    """(index, difference, j) of each picture's likest earlier one, tile by tile; a tile with a missing pixel doesn't count."""
    n, out = side // tile, []
    at = lambda p, k: p[k] if k < len(p) else None
    for i, a in enumerate(pictures):
        best = None
        for j, b in enumerate(pictures[: max(0, i - 1)]):
            found = []
            for r, c in itertools.product(range(n), range(n)) if a is not None and b is not None else ():
                pairs = [(at(a, k), at(b, k)) for k in ((r * tile + y) * side + c * tile + x for y in range(tile) for x in range(tile))]
                if all(x is not None and y is not None for x, y in pairs):
                    found.append(sum(abs(x - y) for x, y in pairs) / tile**2)
            if found and not any(map(math.isnan, found)) and max(found) <= limit and (best is None or max(found) < best[0]):
                best = max(found), j
        if best:
            out.append((i, *best))
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_duplicate_shots_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(likeness, "BLOCK", block)
    monkeypatch.setattr(likeness, "BLOCK_MOST", 2 * block)
    rng = random.Random(3)
    base = [[rng.choice((0.0, -0.0, 3.0, 8.5)) for _ in range(18)] for _ in range(12)]
    odd = [None, [], [1.0] * 5, [None] * 18, [math.nan] + [3.0] * 15, [math.inf] + [3.0] * 15, [-1e300] + [3.0] * 15, [None] + [3.0] * 17]
    seen = []
    for asset in range(3):
        near = lambda: [x + rng.choice((0.0, 0.0, 0.25, 4.0)) for x in rng.choice(base)]
        made = [rng.choice([near, near, lambda: rng.choice(base), lambda: rng.choice(odd if asset else base)])() for _ in range(150)]
        seen.append(made + [made[-1]] * 20)
    rows = [(f"a{k}", i, float(i), i + 1.0, p) for k, made in enumerate(seen) for i, p in enumerate(made)]
    rows += [(None, i, float(i), i + 1.0, base[0]) for i in range(5)] + [("two", 0, 0.0, 1.0, base[0]), ("two", 2, 2.0, 3.0, base[0])]
    reps = spark.createDataFrame(rows, "asset_id string, index int, start_s double, end_s double, thumb array<double>")
    for limit in (2.0, 0.0, -1.0):
        got = sorted((r.asset_id, int(r.t), r.tile_delta, int(r.matched)) for r in detectors.duplicate_shots(reps, 4, 2, limit).collect())
        assert got == [(f"a{k}", *x) for k, made in enumerate(seen) for x in brute_duplicates(made, 4, 2, limit)]


def test_duplicate_shots_make_no_pairs_of_rows(spark):
    reps = spark.range(12_000).selectExpr("'a' AS asset_id", "CAST(id AS INT) AS index", "CAST(id AS DOUBLE) AS start_s", "id + 1D AS end_s", "transform(sequence(1, 16), k -> CAST(pmod(hash(id, k), 256) AS FLOAT)) AS thumb")
    found = detectors.duplicate_shots(reps, 4, 2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0


def test_suppression(spark):
    hits = spark.createDataFrame([(1, "a", 5.0, "luma-spike", None, None), (2, "a", 8.0, "luma-spike", None, None), (3, "a", 2.2, "silence", 2.2, 3.8), (4, "a", 4.5, "silence", 4.5, 5.0)], "hit_id int, asset_id string, t double, kind string, start_s double, end_s double")
    got = {r.hit_id: r.suppression for r in intervals.suppressed(hits, cuts(spark, 5.1), segs(spark, (0, 2), (4, 6))).collect()}
    assert got == {1: "confirmed-scene-cut", 2: None, 3: "between-transcript-segments", 4: None}


def test_joins(spark):
    rng = random.Random(8)
    c = [round(rng.uniform(0, 20), 1) for _ in range(30)]
    f = [round(rng.uniform(0, 20), 1) for _ in range(50)]
    frames = spark.createDataFrame([(i, "a", t) for i, t in enumerate(f)], "frame_id int, asset_id string, t double")
    got = {r.frame_id: r.scene_id for r in joins.scene_ids(frames, cuts(spark, *c)).collect()}
    assert got == {i: 1 + sum(x <= t for x in c) for i, t in enumerate(f)}
    near = {r.frame_id: r.protected for r in joins.protected(frames, cuts(spark, *c[:9])).collect()}
    assert near == {i: any(abs(t - x) < 0.05 for x in c[:9]) for i, t in enumerate(f)}
    spans = [(1, 3), (5, 6), (5, 9), (12, 12)]
    far = lambda s, t: 0 if s[0] <= t <= s[1] else min(abs(t - s[0]), abs(t - s[1]))
    lines = {r.frame_id: r.seq for r in joins.nearest_line(frames, segs(spark, *spans)).collect()}
    assert lines == {i: min(range(4), key=lambda k: (far(spans[k], t), k)) for i, t in enumerate(f)}
    value = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 90.0), ("a", 3.0, 95.0)], "asset_id string, t double, value double")
    kept = joins.confirmed(cuts(spark, 1.3, 2.4, 3.0), value, lambda b, a: F.abs(a - b))
    assert sorted(r.t for r in kept.collect()) == [1.3, 3.0]


def test_series(spark):
    a = spark.createDataFrame([("a", 10.0, 20.0, 5), ("b", 1.0, 2.0, 1)], "asset_id string, start_s double, end_s double, n int")
    assert sorted((r.asset_id, r.t) for r in series.uniform(a).collect()) == [("a", 10.0), ("a", 12.5), ("a", 15.0), ("a", 17.5), ("a", 20.0), ("b", 1.0)]
    for n in (1, 5, 12, 13, 40, 100, 257):
        for cap in (1, 2, 3, 12):
            items = spark.createDataFrame([("a", i) for i in range(n)], "asset_id string, i int")
            want = list(range(n)) if cap >= n else [0] if cap == 1 else sorted({min(n - 1, round(i * ((n - 1) / (cap - 1)))) for i in range(cap)})
            assert sorted(r.i for r in series.thin(items, cap, ["i"]).collect()) == want
            if n in (13, 100):
                assert spark.range(1).select(series.even_places(F.lit(n), F.lit(cap))).first()[0] == want
    hit = spark.createDataFrame([("a", 5.0, 4.8, 9.0), ("a", 50.0, 4.8, 9.0)], "asset_id string, t double, start_s double, end_s double")
    assert sorted(r.t for r in series.bursts(hit, 10, 0.5).collect()) == [4.8, 4.9, 5.0, 5.1, 5.2, 5.3, 5.4, 5.5]
    with pytest.raises(ValueError):
        series.bursts(hit, 0)
    plan = spark.createDataFrame([("a", 0.0, 10.0, 9), ("b", 0.0, 10.0, 9)], "asset_id string, start_s double, end_s double, target int")
    pool = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 3.0), ("b", 99.0)], "asset_id string, t double")
    got = {}
    for r in series.candidates(plan, pool).collect():
        got.setdefault((r.asset_id, r.strategy), []).append(r.t)
    assert sorted(got["b", "scene"]) == [0.0, 1.0, 2.0, 3.0, 9.95] and len(got["a", "scene+uniform"]) == 10


def test_caches(spark):
    e = spark.createDataFrame([(f"k{i}", 10, d) for i, d in enumerate(["2024-01-03", "2024-01-02", "2024-01-02", "2024-01-01"])], "key string, bytes long, last_used string").withColumn("last_used", F.to_timestamp("last_used"))
    assert sorted(r.key for r in cache.evicted(e, 25).collect()) == ["k2", "k3"] and cache.evicted(e, 99).count() == 0
    assert cache.purged(e, "k1").count() == 3 and cache.purged(e).count() == 0 and cache.totals(e).first().bytes == 40
    old, new = (spark.createDataFrame([(p,) for p in x], "path string") for x in (["a", "b/c", "../x", "/etc"], ["a"]))
    assert [r.path for r in cache.stale_files(old, new).collect()] == ["b/c"]


def test_findings_and_briefs(spark):
    a = assets(spark, 100)
    gaps = spark.createDataFrame([("a", 0.0, 5.0, 5.0, "opening", 1.0, "no audio track"), ("a", 8.0, 11.0, 3.0, "mid", 0.9, "silent")], "asset_id string, start double, end double, seconds double, where_ string, silent_fraction double, audio string")
    density = spark.createDataFrame([("a", 0.3)], "asset_id string, density double")
    found = findings.with_checks(findings.findings(a, intervals.shots(a, cuts(spark, 20, 50)), gaps, density)).collect()
    assert sorted(r.rule for r in found) == ["low speech", "quiet", "silence", "slow open"] and all(r.verify for r in found)
    assert all("continues" not in r.note for r in found)
    assert findings.slow_open(a, intervals.shots(a, cuts(spark))).count() == 0
    brief = pipelines.extract(a, cuts(spark, *range(3, 99, 2)), segs(spark, (0, 5), (9, 20)), segs(spark, (6, 8)).select("asset_id", "start_s", "end_s")).first().brief
    assert brief.startswith("# a\n01:40, 49 shots") and "(19 more)" in brief and "[00:09] x" in brief


def test_composed_analyses(spark):
    a = spark.createDataFrame([("a", 0.0, 40.0, 40.0, 1280, 720)], "asset_id string, start_s double, end_s double, duration double, width int, height int")
    frames = spark.createDataFrame([("a", i / 2, [float(10 * (i // 20))] * 16) for i in range(80)], "asset_id string, t double, thumb array<double>")
    kept, size = pipelines.read(a, frames, cuts(spark, 12.0), 4, 2, 5.0)
    times = [r.t for r in kept.orderBy("t").collect()]
    assert times[0] == 0.0 and {10.0, 12.0, 20.0, 30.0} <= set(times) and size.first().frames > len(times)
    assert pipelines.scan(a, cuts(spark, 1, 2, 3)).count() >= 1 and pipelines.quick(a).first().needs_force is False
    assert pipelines.probe(a, segs(spark, (0, 1)), cuts(spark, 1, 2)).first().profile == "low motion"
    out, hidden = pipelines.defects([detectors.luma_spikes(luma(spark, [0, 90, 90, 0], 1.0))], cuts(spark, 1.1), segs(spark, (0, 1)))
    assert [r.t for r in out.collect()] == [3.0] and hidden.count() == 1
    blind = pipelines.transitions(a, cuts(spark), cuts(spark, 5, 9), None)
    assert {r.method for r in blind.collect()} == {"content-change"}


def test_streams_agree_with_tables(spark, tmp_path):
    rng = random.Random(2)
    rows = [(str(i % 3), round(i / 7, 3), float(rng.choice([10, 60, 110]))) for i in range(120)]
    whole = spark.createDataFrame(rows, "asset_id string, t double, yavg double")
    whole.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
    for name, out in (("edges", detect.luma_edges(stream)), ("anchors", detect.cluster(stream.select("asset_id", "t")))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    edges = {(r.asset_id, r.t) for r in detectors.luma_spikes(whole).filter("form = 'edge'").collect()}
    assert {(r.asset_id, r.t) for r in spark.table("edges").collect()} == edges
    assert {(r.asset_id, r.t) for r in spark.table("anchors").collect()} == {(r.asset_id, r.t) for r in folds.cluster(whole).collect()}


def test_transitions_for_labels_its_method(spark):
    # a: three clusters of cuts, two of which part unlike frames; b: blind, sampled changes; c: no duration; d: cuts that all hold.
    frames = [("a", float(t), [float(t >= 20) + float(t >= 40)] * 4) for t in range(61)] + [("d", float(t), [float(t)] * 4) for t in range(31)]
    f = spark.createDataFrame(frames, "asset_id string, t double, thumb array<double>")
    assets = spark.createDataFrame([("a", 60.0), ("b", 600.0), ("c", 0.0), ("d", 30.0)], "asset_id string, duration double")
    raw = spark.createDataFrame([("a", 20.0), ("a", 20.1), ("a", 40.0), ("a", 50.0), ("b", 5.0), ("c", 1.0), ("d", 10.0)], "asset_id string, t double")
    changes = spark.createDataFrame([("b", 5.0), ("b", 100.0), ("b", 100.05), ("c", 2.0), ("c", 3.0)], "asset_id string, t double")
    got = sorted((r.asset_id, r.t, r.method) for r in pipelines.transitions_for(assets, raw, changes, f, 2, 1, span=1.0, level=0.5).collect())
    assert got == [
        ("a", 20.0, "scene+confirmed (3->2)"),
        ("a", 40.0, "scene+confirmed (3->2)"),
        ("b", 5.0, "content-change"),
        ("b", 100.0, "content-change"),
        ("c", 1.0, "scene"),
        ("d", 10.0, "scene"),
    ]


@pytest.mark.parametrize("grid", [None, (3, 2), (10, 10)])
def test_scan_never_overspends(spark, grid):
    a = spark.createDataFrame([("wide", 1920, 1080, 0.0, 600.0), ("tall", 1080, 1920, 0.0, 600.0), ("odd", 100, 9000, 0.0, 600.0)], "asset_id string, width int, height int, start_s double, end_s double")
    pool = spark.createDataFrame([(x, t * 0.5) for x in ("wide", "tall", "odd") for t in range(1000)], "asset_id string, t double")
    sheets = pipelines.scan(a, pool, "anthropic", grid=grid).collect()
    by = {}
    for r in sheets:
        by.setdefault(r.asset_id, []).append(r)
        assert len(r.tiles) == len(r.times) <= r.cols * r.rows and (grid is None or (r.cols, r.rows) == grid)
    assert "wide" in by and "odd" not in by and all(sum(r.tokens for r in rows) <= 3000 for rows in by.values())


def test_noise_keeps_all_frames(spark):
    noisy = [("n", float(i), [float(i % 2) * 3] * 4) for i in range(9)]
    still = [("s", float(i), [float(i >= 5)] * 4) for i in range(9)]
    f = spark.createDataFrame(noisy + still + [("t", 0.0, [0.0] * 4), ("t", 1.0, [0.0] * 4)], "asset_id string, t double, thumb array<double>")
    rows = pipelines.dedup(f, 0.5, 2, 1).collect()
    kept = {a: sorted(r.t for r in rows if r.asset_id == a and r.kept) for a in "nst"}
    assert kept == {"n": [float(i) for i in range(9)], "s": [0.0, 5.0, 8.0], "t": [0.0, 1.0]} and {r.asset_id for r in rows if r.gated} == {"n"}
    assert len(pipelines.dedup(f, 5.0, 2, 1, gate=False).filter("kept AND asset_id = 'n'").collect()) == 2


def test_equal_hits_stay_as_many_as_they_are(spark):
    hits = spark.createDataFrame([("h", "a", 5.0, "luma-spike", None, None)] * 2 + [("h", "a", 5.0, "silence", 5.0, 6.0)], "hit_id string, asset_id string, t double, kind string, start_s double, end_s double")
    cuts = spark.createDataFrame([("a", 5.1)], "asset_id string, t double")
    segments = spark.createDataFrame([("a", 1, 0.0, 4.0), ("a", 2, 7.0, 8.0)], "asset_id string, seq long, start_s double, end_s double")
    rows = intervals.suppressed(hits, cuts, segments).collect()
    assert sorted((r.kind, r.suppression) for r in rows) == [("luma-spike", "confirmed-scene-cut")] * 2 + [("silence", "between-transcript-segments")]


def test_merged_hits_keep_their_evidence(spark):
    hits = spark.createDataFrame([("a", 1.0, "black", "high", "dark for 1 s"), ("a", 1.2, "freeze", "low", None), ("a", 9.0, "silence", "low", "quiet")], "asset_id string, t double, kind string, severity string, evidence string")
    got = {r.t: [h.evidence for h in r.hits] for r in folds.merge_hits(hits).collect()}
    assert got == {1.0: ["dark for 1 s", None], 9.0: ["quiet"]}
