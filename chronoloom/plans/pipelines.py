"""Composed analyses over whole timelines: density, transitions, frames, and the commands built of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import scalars as S
from chronoloom.operators import budget, detectors, findings, folds, intervals, joins, series

PROBES, PROBE_SECONDS = 6, 20.0


def cut_density(assets: DataFrame, cuts: DataFrame, probes: int = PROBES, seconds: float = PROBE_SECONDS) -> DataFrame:
    """asset_id, cuts_per_min, exact, sampled_seconds, total_cuts, raw_cuts.

    An asset of at most probes * seconds is taken whole; of a longer one, so many evenly spaced probes are, and
    cuts are clustered in each probe by itself.
    """
    long = F.col("duration") > probes * seconds
    usable = F.greatest(F.lit(0.0), F.col("duration") - seconds)
    start = F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: F.struct(i.alias("i"), (usable * i / max(1, probes - 1)).alias("a"), (usable * i / max(1, probes - 1) + seconds).alias("b")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(float("-inf")).alias("a"), F.lit(float("inf")).alias("b")))
    windows = assets.select("asset_id", "duration", long.alias("long"), F.explode(F.when(long, start).otherwise(whole)).alias("w"))
    inside = windows.join(cuts.select("asset_id", "t"), "asset_id").filter((F.col("t") >= F.col("w.a")) & (F.col("t") <= F.col("w.b")))
    raw = inside.groupBy("asset_id").agg(F.count(F.lit(1)).alias("raw_cuts"))
    probe = inside.select(F.concat_ws("/", "asset_id", "w.i").alias("asset_id"), "t")
    clustered = folds.cluster(probe).select(F.regexp_replace("asset_id", "/[0-9]+$", "").alias("asset_id")).groupBy("asset_id").agg(F.count(F.lit(1)).alias("total_cuts"))
    out = assets.join(clustered, "asset_id", "left").join(raw, "asset_id", "left").fillna(0, ["total_cuts", "raw_cuts"])
    scanned = F.when(long, F.lit(probes * seconds)).otherwise(F.col("duration"))
    return out.select("asset_id", S.per_minute(F.col("total_cuts"), scanned).alias("cuts_per_min"), (~long).alias("exact"), scanned.alias("sampled_seconds"), "total_cuts", "raw_cuts")


def transitions(assets: DataFrame, cuts: DataFrame, sampled: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """asset_id, t, method: an asset's cuts, or its sampled content changes where scene detection is blind.

    Blind means under one cut a minute over at least 15 seconds, and more sampled changes than cuts. confirmed
    (asset_id, t) replaces the cuts of assets for which it holds any.
    """
    n = cuts.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    m = sampled.groupBy("asset_id").agg(F.count(F.lit(1)).alias("m"))
    plan = assets.join(n, "asset_id", "left").join(m, "asset_id", "left").fillna(0, ["n", "m"])
    blind = (F.col("duration") >= 15) & (S.per_minute(F.col("n"), F.col("duration")) < 1) & (F.col("m") > F.col("n"))
    plan = plan.select("asset_id", blind.alias("blind"))
    scenes = cuts.select("asset_id", "t")
    if confirmed is not None:
        some = confirmed.select("asset_id").distinct()
        scenes = scenes.join(some, "asset_id", "left_anti").unionByName(confirmed.select("asset_id", "t"))
    taken = scenes.join(plan.filter(~F.col("blind")), "asset_id").select("asset_id", "t", F.lit("scene").alias("method"))
    other = sampled.select("asset_id", "t").join(plan.filter("blind"), "asset_id").select("asset_id", "t", F.lit("content-change").alias("method"))
    return taken.unionByName(other)


def transitions_for(assets: DataFrame, raw_cuts: DataFrame, sampled: DataFrame, frames: DataFrame, side: int, tile: int, span: float = joins.CONFIRM_SPAN, level: float = joins.CONFIRM_LEVEL) -> DataFrame:
    """asset_id, t, method from raw cuts and sampled content changes (asset_id, t): both are clustered, cuts confirmed.

    Where scene detection is blind (under one cut a minute over at least 15 seconds, and more changes than cuts)
    the changes are taken. Else a cut must part two different-looking frames (asset_id, t, thumb); where that
    leaves some but not all, the method tells how many. An asset without duration has a rate of 0.
    """
    cuts = folds.cluster(raw_cuts)
    n, m = (df.groupBy("asset_id").agg(F.count(F.lit(1)).alias(c)) for df, c in ((cuts, "n"), (sampled, "m")))
    rate = F.when(F.col("duration") > 0, S.per_minute(F.col("n"), F.col("duration"))).otherwise(0.0)
    plan = assets.join(n, "asset_id", "left").join(m, "asset_id", "left").fillna(0, ["n", "m"])
    plan = plan.select("asset_id", "n", F.coalesce((F.col("duration") >= 15) & (rate < 1) & (F.col("m") > F.col("n")), F.lit(False)).alias("blind"))
    seen = cuts.join(plan.filter(~F.col("blind")), "asset_id")
    sure = joins.confirmed(seen.select("asset_id", "t"), frames.select("asset_id", "t", F.col("thumb").alias("value")), lambda b, a: F.array_max(detectors.deltas(b, a, side, tile)), span, level)
    c = sure.groupBy("asset_id").agg(F.count(F.lit(1)).alias("c"))
    judged = seen.join(sure.select("asset_id", "t", F.lit(True).alias("sure")), ["asset_id", "t"], "left").join(c, "asset_id", "left").fillna(0, ["c"])
    fewer = (F.col("c") > 0) & (F.col("c") < F.col("n"))
    label = F.when(fewer, F.format_string("scene+confirmed (%d->%d)", "n", "c")).otherwise("scene")
    scenes = judged.filter(~fewer | F.coalesce("sure", F.lit(False))).select("asset_id", "t", label.alias("method"))
    other = folds.cluster(sampled.join(plan.filter("blind").select("asset_id"), "asset_id", "left_semi")).select("asset_id", "t", F.lit("content-change").alias("method"))
    return scenes.unionByName(other)


def dedup(frames: DataFrame, threshold: float, side: int, tile: int, gate: bool = True) -> DataFrame:
    """folds.dedup_frames, and gated: an asset whose noise floor is at or over the threshold keeps all its frames."""
    judged = folds.dedup_frames(frames, threshold, side, tile)
    floors = dedup_gate(detectors.change_scores(frames, side, tile), threshold) if gate else None
    if floors is None:
        return judged.withColumn("gated", F.lit(False))
    gated = F.coalesce(F.col("gated"), F.lit(False))
    return judged.join(floors.select("asset_id", "gated"), "asset_id", "left").withColumn("gated", gated).withColumn("kept", F.col("kept") | F.col("gated"))


def dedup_stats(judged: DataFrame) -> DataFrame:
    """candidates, kept, dropped and max_dropped_delta of each asset, from the result of dedup_frames."""
    return judged.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.col("kept"), 1)).alias("kept"), F.count(F.when(~F.col("kept"), 1)).alias("dropped"), F.max(F.when(~F.col("kept"), F.col("delta"))).alias("max_dropped_delta")
    )


def dedup_gate(scored: DataFrame, threshold: float) -> DataFrame:
    """floor and gated of each asset: noise at or over the threshold makes dropping frames pointless."""
    return detectors.noise_floor(scored).withColumn("gated", F.col("floor") >= threshold)


def frame_records(frames: DataFrame, cuts: DataFrame, side: int, tile: int, segments: DataFrame | None = None) -> DataFrame:
    """Frames with ts, scene_id and change_score, and the seq of the nearest segment where segments are given."""
    out = joins.scene_ids(detectors.change_scores(frames, side, tile), cuts).withColumn("ts", S.format_time(F.col("t")))
    if segments is not None:
        keyed = out.withColumn("frame_id", F.struct("asset_id", "t"))
        out = keyed.join(joins.nearest_line(keyed.select("frame_id", "asset_id", "t"), segments), "frame_id").drop("frame_id")
    return out


def probe(assets: DataFrame, segments: DataFrame, cuts: DataFrame) -> DataFrame:
    """What a first look costs and tells: words, text tokens, pacing profile, and whether a whole read needs force."""
    words = segments.groupBy("asset_id").agg(F.sum(S.word_count(F.col("text"))).alias("words"))
    out = assets.join(words, "asset_id", "left").fillna(0, ["words"]).join(cut_density(assets, cuts).select("asset_id", "cuts_per_min", "exact"), "asset_id")
    return out.withColumn("text_tokens", S.text_tokens(F.col("words"))).withColumn("profile", S.motion_profile(F.col("cuts_per_min"))).withColumn("needs_force", S.needs_force(F.col("duration")))


def defects(hits: list[DataFrame], cuts: DataFrame, segments: DataFrame, assets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged defects that known structure doesn't explain, with the window to read; and the explained hits.

    The window ends inside the duration where assets (asset_id, duration) are given.
    """
    found = detectors.located(hits).withColumn("hit_id", F.sha2(F.to_json(F.struct("asset_id", "t", "kind", "start_s", "end_s"), {"ignoreNullFields": "false"}), 256))
    judged = intervals.suppressed(found, cuts, segments)
    merged = folds.merge_hits(judged.filter("suppression IS NULL"))
    until = F.col("t") + 0.75
    if assets is not None:
        merged, until = merged.join(assets.select("asset_id", "duration"), "asset_id", "left"), F.least(F.col("duration"), until)
    merged = merged.withColumn("read_from", S.evidence_start(F.col("t"))).withColumn("read_to", until).drop("duration")
    return merged, judged.filter("suppression IS NOT NULL")


def read(assets: DataFrame, frames: DataFrame, hits: DataFrame, side: int, tile: int, threshold: float, family: str = "generic") -> tuple[DataFrame, DataFrame]:
    """Frames of planned, burst and protected times, deduplicated; and the size at which each asset is read.

    assets: asset_id, start_s, end_s, width, height; hits: asset_id, t.
    """
    span = F.col("end_s") - F.col("start_s")
    planned = assets.withColumn("n", S.sample_target(span, False))
    burst = series.bursts(hits.join(assets.select("asset_id", "start_s", "end_s"), "asset_id"))
    wanted = series.merged(series.uniform(planned), burst)
    near = joins.at_or_after(wanted, frames.withColumn("value", F.struct(F.col("t").alias("at"), "thumb")), "value").filter("value IS NOT NULL")
    taken = near.select("asset_id", F.col("value.at").alias("t"), F.col("value.thumb").alias("thumb")).dropDuplicates(["asset_id", "t"])
    kept = dedup(joins.protected(taken, burst), threshold, side, tile).filter("kept")
    counts = taken.groupBy("asset_id").agg(F.count(F.lit(1)).alias("frames"))
    return kept, budget.read_size(assets.join(counts, "asset_id", "left").fillna(0, ["frames"]), family)


def scan(assets: DataFrame, pool: DataFrame, family: str = "generic", per_sheet: int = 25, most: int = budget.SCAN_BUDGET, grid: tuple[int, int] | None = None) -> DataFrame:
    """Contact sheets: asset_id, sheet, tiles (their times written out), times, tile_width, cols, rows, tokens.

    The budget solves each asset's tile width and how many tiles it gets; grid (columns, rows) fixes the sheets'
    shape. An asset that can't pay for one sheet, or whose assembled sheets cost more than the budget, has none.
    """
    per_sheet = grid[0] * grid[1] if grid else per_sheet
    plan = budget.scan_plan(assets, family, most=most, per_sheet=per_sheet, grid=grid).filter("fits").withColumn("target", F.col("tiles"))
    times = series.candidates(plan.select("asset_id", "start_s", "end_s", "target"), pool).select("asset_id", "t").distinct()
    ranked = series.thin(times.join(plan.select("asset_id", "tiles"), "asset_id"), F.col("tiles"), ["t"])
    sheets = series.chunks(ranked.select("asset_id", "t"), per_sheet, ["t"])
    sheets = sheets.groupBy("asset_id", F.col("chunk").alias("sheet")).agg(F.array_sort(F.collect_list("t")).alias("times"))
    n = F.size("times")
    sheets = sheets.withColumn("cols", F.lit(grid[0]) if grid else S.grid_columns(n)).withColumn("rows", F.lit(grid[1]) if grid else S.grid_rows(n))
    priced = sheets.join(plan.select("asset_id", "tile_width", "width", "height"), "asset_id")
    priced = priced.withColumn("tokens", budget.sheet_tokens(F.col("tile_width"), F.col("width"), F.col("height"), F.col("cols"), F.col("rows"), family))
    paid = priced.groupBy("asset_id").agg(F.sum("tokens").alias("total")).filter(F.col("total") <= most).select("asset_id")
    tiles = F.transform("times", lambda t: S.format_time(t)).alias("tiles")
    return priced.join(paid, "asset_id", "left_semi").select("asset_id", "sheet", tiles, "times", "tile_width", "cols", "rows", "tokens")


def quick(assets: DataFrame, family: str = "generic") -> DataFrame:
    """The short read: needs_force over three minutes, and the size by the cap of frames, not by those found."""
    capped = assets.withColumn("frames", S.sample_target(F.col("duration"), False)).withColumn("needs_force", S.needs_force(F.col("duration"), 180.0))
    return budget.read_size(capped, family)


def _lines(rows: DataFrame, title: str, line: Column, order: list[str], rank: int, most: int | None = None) -> DataFrame:
    """A section of a brief: a title and a line for each row, the first so many and how many more there are."""
    from pyspark.sql import Window

    key = Window.partitionBy("asset_id").orderBy(*order)
    n = rows.withColumn("_line", line).withColumn("_at", F.row_number().over(key))
    shown = n if most is None else n.filter(F.col("_at") <= most)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_line"))), lambda x: x["_line"]), "\n")
    total = n.groupBy("asset_id").agg(F.count(F.lit(1)).alias("_n"))
    body = shown.groupBy("asset_id").agg(said.alias("_body")).join(total, "asset_id")
    more = F.lit("") if most is None else F.when(F.col("_n") > most, F.concat(F.lit("\n("), (F.col("_n") - most).cast("string"), F.lit(" more)"))).otherwise("")
    return body.select("asset_id", F.lit(rank).alias("rank"), F.concat(F.lit(f"## {title}\n"), "_body", more).alias("section"))


def extract(assets: DataFrame, transitions_: DataFrame, segments: DataFrame, silence: DataFrame) -> DataFrame:
    """asset_id, brief: facts, findings, shots, gaps and transcript of each asset as Markdown.

    assets: asset_id, duration, source. A brief is one value, as long as its asset's transcript.
    """
    named = assets.select("asset_id", "duration", "source")
    method = transitions_.groupBy("asset_id").agg(F.min("method").alias("cut_method")) if "method" in transitions_.columns else assets.select("asset_id", F.lit("scene").alias("cut_method")).distinct()
    named = named.join(method, "asset_id", "left").fillna("scene", ["cut_method"])
    shots = intervals.shots(named, folds.cluster(transitions_))
    pacing = intervals.pacing(shots)
    gaps = intervals.annotate_audio(intervals.speech_gaps(named, segments), silence)
    density = intervals.speech_density(named, segments)
    found = findings.with_checks(findings.findings(named, shots, gaps, density))
    facts = named.join(pacing, "asset_id").join(density, "asset_id")
    head = F.concat(
        F.lit("# "), "asset_id", F.lit("\n"), S.format_duration(F.col("duration")), F.lit(", "), F.col("count").cast("string"), F.lit(" shots, median "), S.format_duration(F.col("median")),
        F.lit(", speech "), F.bround(F.col("density") * 100).cast("int").cast("string"), F.lit("%"),
    )
    bar = F.repeat(F.lit("#"), F.least(F.lit(40), F.greatest(F.lit(1), F.bround(F.col("seconds") * 2).cast("int"))))
    parts = [
        facts.select("asset_id", F.lit(0).alias("rank"), head.alias("section")),
        _lines(found, "Findings", F.concat(F.lit("- "), "rule", F.lit(": "), "note", F.lit(" "), "verify"), ["rule", "at"], 1),
        _lines(shots, "Shots", F.concat(S.format_time(F.col("start")), F.lit(" "), S.format_duration(F.col("seconds")), F.lit(" "), bar), ["index"], 2, 30),
        _lines(gaps, "Without speech", F.concat(S.format_time(F.col("start")), F.lit("-"), S.format_time(F.col("end")), F.lit(" "), "where_", F.lit(", "), "audio"), ["start"], 3),
        _lines(segments, "Transcript", F.concat(F.lit("["), S.format_time(F.col("start_s")), F.lit("] "), "text"), ["start_s", "seq"], 4),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    brief = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section"))), lambda x: x["section"]), "\n\n")
    return out.groupBy("asset_id").agg(brief.alias("brief"))
