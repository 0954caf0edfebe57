"""The registered queries over the test tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom import bindings as B
from chronoloom.functions import scalars as S
from chronoloom.functions import tokens as P
from chronoloom.operators import budget, cache, detectors, findings, folds, intervals, joins, series
from chronoloom.plans import pipelines
from chronoloom.sources import logs, subtitles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EV = "ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS asset_id, event_type, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS t FROM events)"
DENSE = f"{EV}, dn AS (SELECT event_id, event_type AS asset_id, value, t FROM ev)"
SEG = f"{EV}, seg AS (SELECT asset_id, event_id AS seq, t AS start_s, t + value / 60.0 AS end_s, event_type AS text FROM ev), ass AS (SELECT DISTINCT asset_id, 720.0::DOUBLE AS duration FROM ev)"
SIL = f"{SEG}, sil AS (SELECT asset_id, start_s, end_s FROM seg WHERE text = 'error')"
SHOTS = f"""{EV}, marks AS (SELECT asset_id, t FROM ev WHERE t > 0 AND t < 720 UNION ALL SELECT DISTINCT asset_id, 0.0 FROM ev UNION ALL SELECT DISTINCT asset_id, 720.0 FROM ev),
n AS (SELECT asset_id, t AS "start", lead(t) OVER (PARTITION BY asset_id ORDER BY t) AS "end" FROM marks),
shots AS (SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY "start") AS "index", "start", "end", "end" - "start" AS seconds FROM n WHERE "end" - "start" > 0.01)"""
GAPS = f"""{SIL}, r AS (SELECT *, max(end_s) OVER (PARTITION BY asset_id ORDER BY start_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg WHERE end_s <> 0),
g AS (SELECT asset_id, coalesce(reach, 0.0) AS "start", start_s AS "end", CASE WHEN reach IS NULL THEN 'opening' ELSE 'mid' END AS where_ FROM r
  UNION ALL SELECT asset_id, max(end_s), 720.0, 'ending' FROM r GROUP BY asset_id),
gaps AS (SELECT asset_id, "start", "end", "end" - "start" AS seconds, where_ FROM g WHERE "end" - "start" >= 2.0)"""
AUDIO = f"""{GAPS}, aud AS (SELECT g.asset_id, g."start", g."end", g.seconds, g.where_,
  coalesce(sum(CASE WHEN s.start_s IS NOT NULL THEN least(g."end", s.end_s) - greatest(g."start", s.start_s) END), 0.0) / g.seconds AS silent_fraction
  FROM gaps g LEFT JOIN sil s ON s.asset_id = g.asset_id AND s.start_s < g."end" AND s.end_s > g."start" GROUP BY g.asset_id, g."start", g."end", g.seconds, g.where_)"""
DENSITY = f"""r2 AS (SELECT *, max(end_s) OVER (PARTITION BY asset_id ORDER BY start_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg WHERE end_s <> 0),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY start_s, seq) AS island FROM r2),
sp AS (SELECT asset_id, island, max(end_s) - min(start_s) AS seconds FROM i GROUP BY 1, 2),
den AS (SELECT asset_id, least(1.0, sum(seconds) / 720.0) AS density FROM sp GROUP BY 1)"""
FRAMES = "fr AS (SELECT CAST(label AS VARCHAR) AS asset_id, CAST(vec_id AS DOUBLE) AS t, embedding AS thumb FROM embeddings)"


def tiles(a: str, b: str) -> str:
    """The sixteen tile differences of two pictures, as a SQL list."""
    gap = lambda r, c, y, x: f"abs(CAST({a}[{(r * 2 + y) * 8 + c * 2 + x + 1}] AS DOUBLE) - CAST({b}[{(r * 2 + y) * 8 + c * 2 + x + 1}] AS DOUBLE))"
    return "[" + ", ".join("(" + " + ".join(gap(r, c, y, x) for y in (0, 1) for x in (0, 1)) + ") / 4" for r in range(4) for c in range(4)) + "]"


def tile_max(a: str, b: str) -> str:
    return f"list_max({tiles(a, b)})"


SIZES = "sz AS (SELECT p_partkey, width, CAST(CASE WHEN p_partkey % 2 = 0 THEN floor(width * 9 / 16) ELSE floor(width * 16 / 9) END AS INTEGER) AS height FROM (SELECT p_partkey, 160 + p_size * 32 AS width FROM part))"
QW = "greatest(32, floor({w} / 32 + 0.5) * 32) / 32 * (greatest(32, floor({h} / 32 + 0.5) * 32) / 32)"
PRICE = {
    "anthropic": "ceil({w} / 28) * ceil({h} / 28)",
    "openai:4o": "85 + 170 * greatest(1, ceil(round_even({w} * least(1.0, 2048 / greatest({w}, {h})) * least(1.0, 768 / least({w} * least(1.0, 2048 / greatest({w}, {h})), {h} * least(1.0, 2048 / greatest({w}, {h})))), 0) / 512)) * greatest(1, ceil(round_even({h} * least(1.0, 2048 / greatest({w}, {h})) * least(1.0, 768 / least({w} * least(1.0, 2048 / greatest({w}, {h})), {h} * least(1.0, 2048 / greatest({w}, {h})))), 0) / 512))",
    "openai:5": "ceil({w} / 32) * ceil({h} / 32)",
    "openai:5-high": "least(2500, ceil({w} / 32) * ceil({h} / 32))",
    "gemini": "CASE WHEN {w} <= 384 AND {h} <= 384 THEN 258 ELSE 258 * ceil({w} / 768) * ceil({h} / 768) END",
    "qwen": QW,
    "qwen:video": f"greatest(1, ceil({QW} / 2))",
}


def price(family: str, w: str, h: str) -> str:
    if family == "generic":
        return "greatest(" + ", ".join(price(f, w, h) for f in PRICE) + ")"
    return "(" + PRICE[family].format(w=f"({w})", h=f"({h})") + ")"


def query(sql: str | None = None):
    """Registers a query under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- shots and speech


@query(f'WITH {SHOTS} SELECT asset_id, "index", round("start", 6) AS "start", round("end", 6) AS "end", round(seconds, 6) AS seconds FROM shots')
def shot_table(spark, sf_dir):
    out = intervals.shots(B.assets(spark, sf_dir), B.luma(spark, sf_dir))
    return out.select("asset_id", "index", *[F.round(c, 6).alias(c) for c in ("start", "end", "seconds")])


@query(
    f'WITH {SHOTS} SELECT asset_id, count(*) AS "count", round(median(seconds), 6) AS median, round(min(seconds), 6) AS shortest, round(max(seconds), 6) AS longest, round(arg_min("start", {{\'a\': -seconds, \'b\': "index"}}), 6) AS longest_at FROM shots GROUP BY 1'
)
def pacing_summary(spark, sf_dir):
    out = intervals.pacing(intervals.shots(B.assets(spark, sf_dir), B.luma(spark, sf_dir)))
    return out.select("asset_id", "count", *[F.round(c, 6).alias(c) for c in ("median", "shortest", "longest", "longest_at")])


@query(f"WITH {SHOTS}, m AS (SELECT *, seconds > 2 * avg(seconds) OVER (PARTITION BY asset_id) AS held FROM shots) SELECT asset_id, count(*) FILTER (held) AS holds, round(sum(CASE WHEN held THEN seconds ELSE 0 END) / sum(seconds), 6) AS share FROM m GROUP BY 1")
def long_holds(spark, sf_dir):
    return intervals.long_holds(intervals.shots(B.assets(spark, sf_dir), B.luma(spark, sf_dir))).withColumn("share", F.round("share", 6))


@query(f'WITH {GAPS} SELECT asset_id, round("start", 6) AS "start", round("end", 6) AS "end", round(seconds, 6) AS seconds, where_ FROM gaps')
def speech_gaps(spark, sf_dir):
    out = intervals.speech_gaps(B.assets(spark, sf_dir), B.segments(spark, sf_dir))
    return out.select("asset_id", *[F.round(c, 6).alias(c) for c in ("start", "end", "seconds")], "where_")


@query(f"WITH {SEG}, {DENSITY} SELECT asset_id, round(density, 6) AS density FROM den")
def speech_density(spark, sf_dir):
    return intervals.speech_density(B.assets(spark, sf_dir), B.segments(spark, sf_dir)).withColumn("density", F.round("density", 6))


def _audio(spark, sf_dir):
    return intervals.annotate_audio(intervals.speech_gaps(B.assets(spark, sf_dir), B.segments(spark, sf_dir)), B.silence(spark, sf_dir))


@query(
    f"""WITH {AUDIO} SELECT asset_id, round("start", 6) AS "start", round("end", 6) AS "end", where_, round(silent_fraction, 6) AS silent_fraction,
CASE WHEN silent_fraction >= 0.6 THEN 'silent' WHEN silent_fraction >= 0.2 THEN 'partly silent' ELSE 'audio playing' END AS audio FROM aud"""
)
def annotate_audio(spark, sf_dir):
    return _audio(spark, sf_dir).select("asset_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "where_", F.round("silent_fraction", 6).alias("silent_fraction"), "audio")


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS asset_id, array_to_string(list(trim(text) ORDER BY turn), ' ') AS hook FROM conversations WHERE turn * 1.5 < 3.0 AND trim(text) <> '' GROUP BY 1"""
)
def hook_window(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations")
    lines = c.select(F.col("conv_id").cast("string").alias("asset_id"), F.col("turn").alias("seq"), (F.col("turn") * 1.5).alias("start_s"), "text")
    return intervals.hook(lines)


@query(f"WITH {SEG} SELECT asset_id, seq, text FROM seg WHERE start_s <= 500 AND end_s >= 400")
def clip_transcript(spark, sf_dir):
    return intervals.clip(B.segments(spark, sf_dir), 400.0, 500.0).select("asset_id", "seq", "text")


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS asset_id, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words,
CAST(trunc(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) * 1.35::DOUBLE) AS BIGINT) AS text_tokens FROM conversations GROUP BY 1"""
)
def word_count(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations")
    words = c.groupBy(F.col("conv_id").cast("string").alias("asset_id")).agg(F.sum(S.word_count(F.col("text"))).alias("words"))
    return words.withColumn("text_tokens", S.text_tokens(F.col("words")))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def tag_strip(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", S.strip_tags(F.col("html")).alias("text"))


@query(
    f"""WITH {EV}, s AS (SELECT event_id, t * 10 AS sec, CAST(round_even(t * 10 * 1000, 0) AS BIGINT) AS ms FROM ev), f AS (
SELECT event_id, sec, ms, CAST(floor(sec) AS BIGINT) AS w, ms // 1000 AS mw FROM s)
SELECT event_id,
  CASE WHEN w >= 3600 THEN printf('%d:%02d:%02d', w // 3600, w % 3600 // 60, w % 60) ELSE printf('%02d:%02d', w // 60, w % 60) END AS shown,
  CASE WHEN mw >= 3600 THEN printf('%d:%02d:%02d.%03d', mw // 3600, mw % 3600 // 60, mw % 60, ms % 1000) ELSE printf('%02d:%02d.%03d', mw // 60, mw % 60, ms % 1000) END AS shown_ms,
  CAST(w AS DOUBLE) AS parsed FROM f"""
)
def parse_format_ts(spark, sf_dir):
    sec = F.col("t") * 10
    out = B.events(spark, sf_dir).select("event_id", S.format_time(sec).alias("shown"), S.format_time(sec, millis=True).alias("shown_ms"))
    return out.withColumn("parsed", S.parse_time(F.col("shown")))


# ---------------------------------------------------------------- clusters and cuts


def anchors(source: str, window: str) -> str:
    return f"""RECURSIVE {DENSE}, src AS ({source}), c AS (
SELECT asset_id, min(t) AS t FROM src GROUP BY 1
UNION ALL SELECT c.asset_id, (SELECT min(x.t) FROM src x WHERE x.asset_id = c.asset_id AND x.t - c.t > {window}) FROM c WHERE c.t IS NOT NULL)"""


@query(f"WITH {anchors('SELECT asset_id, t FROM dn', '0.5')} SELECT asset_id, round(t, 6) AS t FROM c WHERE t IS NOT NULL")
def cluster_cuts(spark, sf_dir):
    return folds.cluster(B.dense(spark, sf_dir)).withColumn("t", F.round("t", 6))


PROBE = "SELECT asset_id || '/' || i AS asset_id, t FROM dn, (SELECT unnest(range(6)) AS i) WHERE t >= i * 700.0 / 5 AND t <= i * 700.0 / 5 + 20"


@query(
    f"""WITH {anchors(PROBE, '0.5')} SELECT split_part(asset_id, '/', 1) AS asset_id, count(*) AS total_cuts, round(count(*) / 2.0, 2) AS cuts_per_min FROM c WHERE t IS NOT NULL GROUP BY 1"""
)
def cut_density_probe(spark, sf_dir):
    out = pipelines.cut_density(B.dense_assets(spark, sf_dir), B.dense(spark, sf_dir))
    return out.select("asset_id", "total_cuts", F.round("cuts_per_min", 2).alias("cuts_per_min"))


@query(f"WITH {EV}, n AS (SELECT asset_id, count(*) / (720.0 / 60) AS rate FROM ev GROUP BY 1) SELECT asset_id, round(rate, 6) AS rate, CASE WHEN rate < 1 THEN 'static' WHEN rate < 4 THEN 'low motion' WHEN rate < 15 THEN 'edited' ELSE 'high motion' END AS profile FROM n")
def motion_profile(spark, sf_dir):
    n = B.events(spark, sf_dir).groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    rate = S.per_minute(F.col("n"), F.lit(B.HOURS))
    return n.select("asset_id", F.round(rate, 6).alias("rate"), S.motion_profile(rate).alias("profile"))


@query(
    f"""WITH {EV}, a AS (SELECT asset_id, count(*) FILTER (event_type = 'purchase') AS n, count(*) FILTER (event_type = 'view') AS m FROM ev GROUP BY 1),
p AS (SELECT *, n / 12.0 < 1 AND m > n AS blind FROM a)
SELECT e.asset_id, round(e.t, 6) AS t, CASE WHEN blind THEN 'content-change' ELSE 'scene' END AS method FROM ev e JOIN p USING (asset_id)
WHERE (blind AND event_type = 'view') OR (NOT blind AND event_type = 'purchase')"""
)
def transitions_fallback(spark, sf_dir):
    e = B.events(spark, sf_dir)
    out = pipelines.transitions(B.assets(spark, sf_dir), e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"))
    return out.select("asset_id", F.round("t", 6).alias("t"), "method")


@query(
    f"""WITH {FRAMES}, g AS (SELECT *, CAST(floor(t / 10) AS BIGINT) AS i FROM fr), f AS (SELECT asset_id, i, arg_min(thumb, t) AS thumb FROM g GROUP BY 1, 2),
l AS (SELECT *, lag(thumb) OVER (PARTITION BY asset_id ORDER BY i) AS before FROM f), d AS (SELECT asset_id, i * 10.0::DOUBLE AS t, {tile_max("thumb", "before")} AS s FROM l WHERE before IS NOT NULL)
SELECT asset_id, t, round(s, 6) AS change_score FROM d WHERE s > 0.2"""
)
def content_changes(spark, sf_dir):
    out = detectors.content_changes(B.frames(spark, sf_dir), 0.0, 0.2, B.SIDE, B.TILE, interval=10.0)
    return out.withColumn("change_score", F.round("change_score", 6))


@query(
    f"""WITH {FRAMES}, w AS (SELECT asset_id, t, unnest([greatest(0.0, t - 15), t + 15]) AS q, unnest([0, 1]) AS side FROM fr),
m AS (SELECT w.asset_id, w.t, side, arg_min(f.thumb, f.t) AS v FROM w LEFT JOIN fr f ON f.asset_id = w.asset_id AND f.t >= w.q GROUP BY 1, 2, 3),
b AS (SELECT asset_id, t, any_value(v) FILTER (side = 0) AS b, any_value(v) FILTER (side = 1) AS a FROM m GROUP BY 1, 2)
SELECT asset_id, t FROM b WHERE a IS NULL OR b IS NULL OR {tile_max("b", "a")} > 0.2"""
)
def confirm_transitions(spark, sf_dir):
    f = B.frames(spark, sf_dir)
    return joins.confirmed(f, f.withColumnRenamed("thumb", "value"), lambda b, a: F.array_max(detectors.deltas(b, a, B.SIDE, B.TILE)), span=15.0, level=0.2)


SCORED = f"""{FRAMES}, lg AS (SELECT asset_id, t, thumb, lag(thumb) OVER (PARTITION BY asset_id ORDER BY t) AS before FROM fr),
sc AS (SELECT asset_id, t, CASE WHEN before IS NOT NULL THEN {tile_max("thumb", "before")} END AS change_score FROM lg)"""


@query(f"WITH {SCORED} SELECT asset_id, t, round(change_score, 6) AS change_score FROM sc")
def change_score(spark, sf_dir):
    return detectors.change_scores(B.frames(spark, sf_dir), B.SIDE, B.TILE).select("asset_id", "t", F.round("change_score", 6).alias("change_score"))


@query(
    f"""WITH {FRAMES}, lg AS (SELECT asset_id, t, thumb AS a, lag(thumb) OVER (PARTITION BY asset_id ORDER BY t) AS b FROM fr),
d AS (SELECT asset_id, t, unnest(range(16)) AS tile, {tiles("a", "b")} AS l FROM lg WHERE b IS NOT NULL)
SELECT asset_id, t, tile, round(l[tile + 1], 6) AS delta FROM d"""
)
def tile_deltas(spark, sf_dir):
    from pyspark.sql import Window

    f = B.frames(spark, sf_dir).withColumn("b", F.lag("thumb").over(Window.partitionBy("asset_id").orderBy("t"))).filter("b IS NOT NULL")
    each = f.select("asset_id", "t", F.posexplode(detectors.deltas(F.col("thumb"), F.col("b"), B.SIDE, B.TILE)).alias("tile", "delta"))
    return each.select("asset_id", "t", F.col("tile").cast("long").alias("tile"), F.round("delta", 6).alias("delta"))


@query(
    f"""WITH {SCORED}, s AS (SELECT asset_id, list(change_score ORDER BY change_score) AS l, count(*) AS pairs FROM sc WHERE change_score IS NOT NULL GROUP BY 1)
SELECT asset_id, round(l[CAST(round_even(0.25 * (pairs - 1), 0) AS BIGINT) + 1], 6) AS "floor", pairs FROM s"""
)
def noise_floor(spark, sf_dir):
    return detectors.noise_floor(detectors.change_scores(B.frames(spark, sf_dir), B.SIDE, B.TILE)).withColumn("floor", F.round("floor", 6))


def last_kept(threshold: float, protect: str = "false") -> str:
    return f"""RECURSIVE {FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY t) AS r, count(*) OVER (PARTITION BY asset_id) AS n, {protect} AS protected FROM fr),
k AS (SELECT asset_id, t, r, n, thumb AS ref, true AS kept, CAST(NULL AS DOUBLE) AS delta FROM n WHERE r = 1
UNION ALL SELECT x.asset_id, x.t, x.r, x.n, CASE WHEN x.keep THEN x.thumb ELSE x.ref END, x.keep, x.d FROM (
  SELECT y.*, y.protected OR y.r = y.n OR y.d > {threshold} AS keep FROM (SELECT n.asset_id, n.t, n.r, n.n, n.thumb, n.protected, k.ref, {tile_max("n.thumb", "k.ref")} AS d
  FROM k JOIN n ON n.asset_id = k.asset_id AND n.r = k.r + 1) y) x)"""


@query(f"WITH {last_kept(0.25)} SELECT asset_id, t, round(delta, 6) AS delta FROM k WHERE kept")
def dedup_last_kept(spark, sf_dir):
    out = folds.dedup_frames(B.frames(spark, sf_dir), 0.25, B.SIDE, B.TILE).filter("kept")
    return out.select("asset_id", "t", F.round("delta", 6).alias("delta"))


@query(f"WITH {last_kept(0.30, 'CAST(t AS BIGINT) % 5 = 0')} SELECT asset_id, t FROM k WHERE kept")
def dedup_protect(spark, sf_dir):
    f = B.frames(spark, sf_dir)
    wanted = f.filter(F.col("t").cast("long") % 5 == 0)
    return folds.dedup_frames(joins.protected(f, wanted), 0.30, B.SIDE, B.TILE).filter("kept").select("asset_id", "t")


@query(f"WITH {last_kept(0.25)} SELECT asset_id, count(*) AS candidates, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped, round(max(delta) FILTER (NOT kept), 6) AS max_dropped_delta FROM k GROUP BY 1")
def dedup_stats(spark, sf_dir):
    return pipelines.dedup_stats(folds.dedup_frames(B.frames(spark, sf_dir), 0.25, B.SIDE, B.TILE)).withColumn("max_dropped_delta", F.round("max_dropped_delta", 6))


@query(
    f"""WITH {SCORED}, s AS (SELECT asset_id, list(change_score ORDER BY change_score) AS l, count(*) AS pairs FROM sc WHERE change_score IS NOT NULL GROUP BY 1)
SELECT asset_id, round(l[CAST(round_even(0.25 * (pairs - 1), 0) AS BIGINT) + 1], 6) AS "floor", l[CAST(round_even(0.25 * (pairs - 1), 0) AS BIGINT) + 1] >= 0.18 AS gated FROM s"""
)
def dedup_gate(spark, sf_dir):
    scored = detectors.change_scores(B.frames(spark, sf_dir), B.SIDE, B.TILE)
    return pipelines.dedup_gate(scored, 0.18).select("asset_id", F.round("floor", 6).alias("floor"), "gated")


@query(
    f"""WITH {last_kept(0.25)}, lg AS (SELECT asset_id, t, thumb, lag(thumb) OVER (PARTITION BY asset_id ORDER BY t) AS before FROM fr),
sc AS (SELECT asset_id, t, {tile_max("thumb", "before")} AS change_score FROM lg WHERE before IS NOT NULL),
s AS (SELECT asset_id, list(change_score ORDER BY change_score) AS l, count(*) AS pairs FROM sc GROUP BY 1),
g AS (SELECT asset_id, l[CAST(round_even(0.25 * (pairs - 1), 0) AS BIGINT) + 1] >= 0.25 AS gated FROM s)
SELECT asset_id, t, gated FROM k JOIN g USING (asset_id) WHERE kept OR gated"""
)
def dedup_gated(spark, sf_dir):
    return pipelines.dedup(B.frames(spark, sf_dir), 0.25, B.SIDE, B.TILE).filter("kept").select("asset_id", "t", "gated")


def transitions_for(spark, sf_dir):
    """Cuts and samples of the frames' own changes; its method labels are tested by hand."""
    f = B.frames(spark, sf_dir)
    assets = f.groupBy("asset_id").agg(F.max("t").alias("duration"))
    raw = detectors.change_scores(f, B.SIDE, B.TILE).filter("change_score > 0.5").select("asset_id", "t")
    return pipelines.transitions_for(assets, raw, detectors.content_changes(f, 0.0, 0.2, B.SIDE, B.TILE, interval=10.0), f, B.SIDE, B.TILE, span=15.0, level=0.2)


QUERIES["transitions_for"] = transitions_for


# ---------------------------------------------------------------- captions


def caption_cues(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").cast("string").alias("asset_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("asset_id", F.col("pos").cast("long").alias("seq"), (F.col("pos") * 2.0).alias("start_s"), (F.col("pos") * 2.0 + 2.0).alias("end_s"), F.col("line").alias("text"))


@query(
    """WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), cue AS (
SELECT CAST(doc_id AS VARCHAR) AS asset_id, unnest(range(len(parts))) AS seq, unnest(parts) AS text FROM l),
k AS (SELECT asset_id, seq, 1 AS part, text AS said FROM cue WHERE seq = 0
UNION ALL SELECT c.asset_id, c.seq, CASE WHEN c.text = k.said OR (starts_with(c.text, k.said) AND length(k.said) > 8) OR (ends_with(k.said, c.text) AND length(c.text) > 8) THEN k.part ELSE k.part + 1 END,
CASE WHEN c.text = k.said THEN k.said WHEN starts_with(c.text, k.said) AND length(k.said) > 8 THEN c.text WHEN ends_with(k.said, c.text) AND length(c.text) > 8 THEN k.said ELSE c.text END
FROM k JOIN cue c ON c.asset_id = k.asset_id AND c.seq = k.seq + 1)
SELECT asset_id, CAST(part AS BIGINT) AS seq, min(seq) * 2.0::DOUBLE AS start_s, max(seq) * 2.0::DOUBLE + 2.0::DOUBLE AS end_s, arg_max(said, seq) AS text FROM k GROUP BY 1, part"""
)
def caption_collapse(spark, sf_dir):
    return folds.collapse_captions(caption_cues(spark, sf_dir)).select("asset_id", "seq", "start_s", "end_s", "text")


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS asset_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, turn * 5.0::DOUBLE + 0.5::DOUBLE AS start_s, turn * 5.0::DOUBLE + 3.25::DOUBLE AS end_s,
trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations WHERE trim(text) <> ''"""
)
def subtitle_parse(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations").filter("trim(text) <> ''")
    stamp = lambda s: F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), F.floor(s % 60).cast("long"), F.floor(s * 1000 % 1000).cast("long"))
    said = F.trim(F.regexp_replace("text", r"\s+", " "))
    cue = F.concat_ws("\n", F.col("turn").cast("string"), F.concat(stamp(F.col("turn") * 5.0 + 0.5), F.lit(" --> "), stamp(F.col("turn") * 5.0 + 3.25)), F.concat(F.lit("<i>"), said, F.lit("</i>")), F.lit(""))
    files = c.groupBy(F.col("conv_id").cast("string").alias("asset_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda x: x["cue"]), "\n").alias("text"))
    return subtitles.parse(files)


@query(
    """WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS asset_id, c_custkey, c_custkey % 3 AS m FROM customer)
SELECT asset_id, CASE m WHEN 0 THEN 2 WHEN 1 THEN 1 END AS "order", CASE m WHEN 0 THEN 'zho' WHEN 1 THEN 'eng' END AS language FROM s"""
)
def pick_subtitle(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    m = F.col("c_custkey") % 3
    track = lambda o, codec, lang: F.struct(F.lit(o).alias("order"), F.lit(codec).alias("codec"), F.lit(lang).alias("language"))
    streams = F.when(m == 2, F.array(track(0, "hdmv_pgs_subtitle", "eng"))).otherwise(F.array(track(0, "dvd_subtitle", "zho"), track(1, "subrip", "eng"), track(2, "ass", "zho")))
    wanted = F.when(m == 0, "zh-Hans").otherwise("fr")
    out = c.select(F.col("c_custkey").cast("string").alias("asset_id"), subtitles.pick_stream(streams, wanted).alias("s"))
    return out.select("asset_id", "s.order", "s.language")


@query(
    """WITH f AS (SELECT l_orderkey, 'a' || l_linenumber || CASE WHEN l_returnflag = 'R' THEN '.vtt' WHEN l_returnflag = 'A' THEN '.srt' ELSE '.txt' END AS name, l_linestatus = 'F' AS ok FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS asset_id, arg_min(name, {'r': CASE WHEN ends_with(name, '.vtt') THEN 0 ELSE 1 END, 'n': name}) AS name FROM f WHERE ok AND NOT ends_with(name, '.txt') GROUP BY 1"""
)
def caption_file_choice(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    ext = F.when(F.col("l_returnflag") == "R", ".vtt").when(F.col("l_returnflag") == "A", ".srt").otherwise(".txt")
    files = li.select(F.col("l_orderkey").cast("string").alias("asset_id"), F.concat(F.lit("a"), F.col("l_linenumber").cast("string"), ext).alias("name"), F.when(F.col("l_linestatus") == "F", 5).otherwise(0).alias("segments"))
    return subtitles.chosen_file(files)


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS asset_id, CAST(turn AS BIGINT) AS seq, turn * 1.25::DOUBLE AS start_s, turn * 1.25::DOUBLE + 1.0::DOUBLE AS end_s, trim(text, ' ') AS text FROM conversations WHERE trim(text, ' ') <> ''"""
)
def asr_json_normalise(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations")
    ms = F.struct(F.struct((F.col("turn") * 1250).alias("from"), (F.col("turn") * 1250 + 1000).alias("to")).alias("offsets"), F.col("text").alias("text"))
    s = F.struct((F.col("turn") * 1.25).alias("start"), (F.col("turn") * 1.25 + 1.0).alias("end"), F.concat(F.lit(" "), F.col("text")).alias("text"))
    in_order = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("turn", x.alias("x")))), lambda p: p["x"])
    by = c.groupBy(F.col("conv_id").cast("string").alias("asset_id")).agg(in_order(ms).alias("a"), in_order(s).alias("b"))
    even = F.col("asset_id").cast("long") % 2 == 0
    runs = by.select("asset_id", F.when(even, F.to_json(F.struct(F.col("a").alias("transcription")))).otherwise(F.to_json(F.struct(F.col("b").alias("segments")))).alias("json"))
    return subtitles.recognised(runs)


# ---------------------------------------------------------------- what media tools print


@query(
    f"""WITH {SIZES} SELECT p_partkey AS asset_id, CASE p_partkey % 3 WHEN 0 THEN round(p_partkey / 8, 3) WHEN 1 THEN CAST(p_size AS DOUBLE) ELSE 0.0 END AS duration, width, height,
CASE p_partkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 25.0 WHEN 2 THEN 0.0 ELSE round(p_size * 1000 / 1001, 3) END AS fps, CASE WHEN p_partkey % 7 = 0 THEN '?' ELSE p_type END AS codec,
p_partkey % 2 = 0 AS has_audio, CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey * 100 END AS BIGINT) AS size_bytes FROM sz JOIN part USING (p_partkey)"""
)
def probe_file(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    told = F.when(key % 3 == 0, (key / 8).cast("string")).when(key % 3 == 2, "N/A")
    rate = F.when(key % 5 == 0, "0/0").when(key % 5 == 2, "30").when(key % 5 > 2, F.concat(size, F.lit("000/1001")))
    video = F.struct(
        F.lit("video").alias("codec_type"), F.when(key % 7 != 0, F.col("p_type")).alias("codec_name"), "width", "height", rate.alias("avg_frame_rate"), F.when(key % 5 == 1, "25/1").otherwise("1/1").alias("r_frame_rate"), F.when(key % 3 == 1, size).otherwise("N/A").alias("duration")
    )
    audio = F.when(key % 2 == 0, F.array(F.struct(F.lit("audio").alias("codec_type"))))
    probe = F.concat(F.lit('{"format":'), F.to_json(F.struct(told.alias("duration"), F.when(key % 4 != 0, (key * 100).cast("string")).alias("size"))), F.lit(',"streams":['), F.coalesce(F.concat(F.substr(F.to_json(audio), F.lit(2), F.length(F.to_json(audio)) - 2), F.lit(",")), F.lit("")), F.to_json(video), F.lit("]}"))
    files = B.sizes(spark, sf_dir).join(B.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type"), "p_partkey").select(key.alias("asset_id"), probe.alias("json"))
    return subtitles.probed(files)


@query("SELECT DISTINCT l_orderkey AS asset_id, l_partkey / 4 AS pts FROM lineitem WHERE l_returnflag <> 'R'")
def packet_times(spark, sf_dir):
    packet = F.struct(F.when(F.col("l_returnflag") == "R", "N/A").otherwise((F.col("l_partkey") / 4).cast("string")).alias("pts_time"))
    files = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("asset_id")).agg(F.to_json(F.struct(F.collect_list(packet).alias("packets"))).alias("json"))
    return logs.packet_times(files)


@query(
    """SELECT l_orderkey AS asset_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1 AS INTEGER) AS "order", l_linenumber AS "index",
CASE WHEN l_linestatus = 'F' THEN 'subrip' ELSE '?' END AS codec, CASE WHEN l_returnflag = 'N' THEN '' ELSE lower(l_returnflag) END AS language, CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'N' THEN 'T' || l_partkey ELSE '' END AS title FROM lineitem"""
)
def subtitle_tracks(spark, sf_dir):
    f, n = F.col("l_linestatus") == "F", F.col("l_returnflag") != "N"
    tags = F.when(n, F.struct(F.col("l_returnflag").alias("language"), F.when(f, F.concat(F.lit("T"), F.col("l_partkey").cast("string"))).alias("title")))
    track = F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", F.col("l_linenumber").alias("index"), F.when(f, "subrip").alias("codec_name"), tags.alias("tags"))
    files = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("asset_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(track)).alias("streams"))).alias("json"))
    return logs.subtitle_tracks(files)


@query(
    """SELECT c_custkey AS asset_id, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_custkey / 2 END AS duration, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS uploader, CAST(c_nationkey AS INTEGER) AS width, 0 AS height,
CASE WHEN c_custkey % 4 = 0 THEN 'de,en' ELSE '' END AS manual_subs, 'n' || c_nationkey || ',zz' AS auto_subs FROM customer"""
)
def remote_metadata(spark, sf_dir):
    key = F.col("c_custkey")
    said = F.struct(
        F.col("c_name").alias("title"), F.when(key % 3 != 0, key / 2).alias("duration"), F.when(key % 2 == 0, F.col("c_mktsegment")).alias("uploader"), F.col("c_nationkey").alias("width"),
        F.when(key % 4 == 0, F.create_map(F.lit("en"), F.array(F.lit("a")), F.lit("de"), F.array(F.lit("b"), F.lit("c")))).alias("subtitles"),
        F.create_map(F.lit("zz"), F.array(F.lit("a")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.array(F.lit("b"))).alias("automatic_captions"),
    )
    files = B.table(spark, sf_dir, "customer").select(key.alias("asset_id"), F.to_json(said).alias("json"))
    out = logs.remote_metadata(files)
    return out.withColumns({c: F.array_join(c, ",") for c in ("manual_subs", "auto_subs")})


def _log(spark, sf_dir, *lines):
    """The events of a user as a log: asset_id, line_no, line; each event writes these lines."""
    e = B.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("asset_id"), "event_id", "event_type", (F.col("event_id") / 4).cast("string").alias("at"), F.floor("value").cast("string").alias("v"))
    return e.select("asset_id", "event_id", F.posexplode(F.array(*lines)).alias("p", "line")).select("asset_id", (F.col("event_id") * len(lines) + F.col("p")).alias("line_no"), "line")


@query("SELECT CAST(user_id AS VARCHAR) AS asset_id, event_id / 4 AS t, CAST(floor(value) AS DOUBLE) AS yavg FROM events WHERE event_type <> 'error'")
def luma_log(spark, sf_dir):
    frame = F.concat(F.lit("frame:1    pts:1    pts_time:"), F.col("at"))
    signal = F.when(F.col("event_type") != "error", F.concat(F.lit("lavfi.signalstats.YAVG="), F.col("v"))).otherwise("lavfi.signalstats.YMIN=16")
    return subtitles.luma_log(_log(spark, sf_dir, frame, signal)).select("asset_id", "t", "yavg")


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS asset_id, event_type, event_id / 4 AS t, floor(value) AS v FROM events), a AS (SELECT DISTINCT asset_id FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY asset_id, event_type ORDER BY t) AS n FROM e),
p AS (SELECT s.asset_id, s.event_type, s.t AS start_s, x.t AS end_s FROM n s LEFT JOIN n x ON x.asset_id = s.asset_id AND x.n = s.n AND x.event_type = CASE s.event_type WHEN 'click' THEN 'signup' ELSE 'error' END WHERE s.event_type IN ('click', 'purchase'))
SELECT asset_id, 'black' AS kind, t AS start_s, t + v AS end_s FROM e WHERE event_type = 'view'
UNION ALL SELECT asset_id, 'freeze', start_s, coalesce(end_s, 1e6) FROM p WHERE event_type = 'click' UNION ALL SELECT asset_id, 'silence', start_s, end_s FROM p WHERE event_type = 'purchase' AND end_s > start_s"""
)
def log_spans(spark, sf_dir):
    kind, at = F.col("event_type"), F.col("at")
    black = F.concat(F.lit("[blackdetect @ 0x1] black_start:"), at, F.lit(" black_end:"), (at.cast("double") + F.col("v").cast("double")).cast("decimal(18,2)").cast("string"), F.lit(" black_duration:"), F.col("v"))
    line = (
        F.when(kind == "view", black)
        .when(kind == "click", F.concat(F.lit("[freezedetect @ 0x2] lavfi.freezedetect.freeze_start: "), at))
        .when(kind == "signup", F.concat(F.lit("[freezedetect @ 0x2] lavfi.freezedetect.freeze_end: "), at))
        .when(kind == "purchase", F.concat(F.lit("[silencedetect @ 0x3] silence_start: "), at))
        .otherwise(F.concat(F.lit("[silencedetect @ 0x3] silence_end: "), at, F.lit(" | silence_duration: 1")))
    )
    log = _log(spark, sf_dir, line)
    a = B.assets(spark, sf_dir).withColumn("duration", F.lit(1e6))
    spans = {"black": logs.black_spans(log), "freeze": detectors.pair_freezes(logs.marks(log, "freeze"), a), "silence": detectors.pair_silences(logs.marks(log, "silence"))}
    parts = [s.select("asset_id", F.lit(k).alias("kind"), "start_s", "end_s") for k, s in spans.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {EV} SELECT DISTINCT asset_id, round(t, 3) AS t FROM ev WHERE value / 100 > 0.15::DOUBLE AND t >= 100 AND t <= 600")
def detect_cuts(spark, sf_dir):
    return detectors.cuts(B.events(spark, sf_dir).withColumn("scene_score", F.col("value") / 100), start=100.0, end=600.0)


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS asset_id, event_id / 4 AS t FROM events WHERE event_type = 'view' AND event_id / 4 BETWEEN 5 AND 1e6")
def cut_log(spark, sf_dir):
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("[Parsed_showinfo_2 @ 0x4] n: 0 pts: 1 pts_time:"), F.col("at"), F.lit(" duration: 1"))).otherwise("Stream mapping:")
    return logs.shown_cuts(_log(spark, sf_dir, line), 5.0, 1e6)


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' WHEN 2 THEN 'python' WHEN 3 THEN 'cpp' END AS backend FROM customer")
def recogniser_backend(spark, sf_dir):
    said = ["usage: x [--output_format F]", "  -oj,  --output-json  write", "--MODEL_DIR D and --output-json", "  -m FNAME,  --model FNAME  path"]
    text = F.try_element_at(F.array(*[F.lit(s) for s in said]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return B.table(spark, sf_dir, "customer").select("c_custkey", subtitles.backend(F.coalesce(text, F.lit("no flags"))).alias("backend"))


@query(
    """WITH s AS (SELECT p_partkey, p_size * 13.0::DOUBLE AS d, CASE p_partkey % 3 WHEN 0 THEN p_size / 2 WHEN 1 THEN 29.97::DOUBLE ELSE 0.25::DOUBLE END AS fps FROM part)
SELECT p_partkey, CAST(greatest(1, round_even(fps * d, 0)) AS INTEGER) AS target, 'explicit ' || regexp_replace(CAST(fps AS VARCHAR), '\\.0$', '') || 'fps' AS label FROM s"""
)
def explicit_sampling(spark, sf_dir):
    fps = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 2).when(F.col("p_partkey") % 3 == 1, 29.97).otherwise(0.25)
    d = (F.col("p_size") * 13.0).cast("double")
    return B.table(spark, sf_dir, "part").select("p_partkey", S.plan_target(d, False, fps).alias("target"), S.plan_label(False, fps).alias("label"))


@query(f"WITH {SEG} SELECT asset_id, string_agg(printf('[%02d:%02d] ', CAST(floor(start_s) AS BIGINT) // 60, CAST(floor(start_s) AS BIGINT) % 60) || text, chr(10) ORDER BY seq) AS transcript FROM seg WHERE start_s <= 500 AND end_s >= 400 GROUP BY 1")
def transcript_text(spark, sf_dir):
    return intervals.rendered(B.segments(spark, sf_dir), 400.0, 500.0)


@query(
    f"""WITH {EV}, n AS (SELECT event_id, CAST(floor(t) AS BIGINT) AS w, row_number() OVER (PARTITION BY asset_id ORDER BY t, event_id) AS i FROM ev)
SELECT event_id, printf('%02d_%02dm%02ds.jpg', i, w // 60, w % 60) AS name FROM n"""
)
def handoff_names(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("asset_id").orderBy("t", "event_id"))
    return B.events(spark, sf_dir).withColumn("i", place).select("event_id", S.handoff_name(F.col("i"), F.col("t")).alias("name"))


@query("SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '^(.+)\\.[^.]+$', '\\1'), 60), ''), 'clip') AS stem FROM pages")
def clip_stem(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", S.clip_stem(F.col("url")).alias("stem"))


@query("SELECT o_custkey AS owner, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders)")
def cache_purge(spark, sf_dir):
    entries = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").cast("string").alias("key"))
    least = B.table(spark, sf_dir, "orders").agg(F.min("o_orderkey").cast("string")).first()[0]
    return cache.purged(entries, least)


# ---------------------------------------------------------------- detectors

LUMA = f"""{EV}, lu AS (SELECT asset_id, t, value AS y, lag(value) OVER w AS p, lead(value) OVER w AS n FROM ev WINDOW w AS (PARTITION BY asset_id ORDER BY t)),
ls AS (SELECT *, CASE WHEN abs(y - p) >= 40 THEN 'edge' WHEN abs(y - (p + n) / 2) >= 40 AND abs(p - n) <= 12 THEN 'impulse' END AS form FROM lu)"""


@query(f"WITH {LUMA} SELECT asset_id, round(t, 6) AS t, form, round(CASE WHEN form = 'edge' THEN abs(y - p) ELSE abs(y - (p + n) / 2) END, 6) AS delta FROM ls WHERE form IS NOT NULL")
def luma_spikes(spark, sf_dir):
    return detectors.luma_spikes(B.luma(spark, sf_dir)).select("asset_id", F.round("t", 6).alias("t"), "form", F.round("delta", 6).alias("delta"))


@query(
    f"""WITH {EV}, s AS (SELECT asset_id, t, lag(t) OVER (PARTITION BY asset_id ORDER BY t) AS f FROM (SELECT DISTINCT asset_id, t FROM ev)), d AS (SELECT *, t - f AS gap FROM s WHERE t - f > 0),
m AS (SELECT asset_id, median(gap) AS expected FROM d GROUP BY 1 HAVING count(*) >= 3)
SELECT asset_id, round(f, 6) AS t, round(gap, 6) AS gap, round(expected, 6) AS expected FROM d JOIN m USING (asset_id) WHERE gap > greatest(0.1, 3 * expected)"""
)
def pts_gaps(spark, sf_dir):
    return detectors.pts_gaps(B.packets(spark, sf_dir)).select("asset_id", *[F.round(c, 6).alias(c) for c in ("t", "gap", "expected")])


def runs_sql(base: str, inside: str) -> str:
    return f"""{base}, mk AS (SELECT asset_id, t, {inside} AS i, coalesce(lead(t) OVER w, t) AS nx FROM src WINDOW w AS (PARTITION BY asset_id ORDER BY t)),
nw AS (SELECT *, CASE WHEN i AND NOT coalesce(lag(i) OVER (PARTITION BY asset_id ORDER BY t), false) THEN 1 ELSE 0 END AS s FROM mk), ru AS (SELECT *, sum(s) OVER (PARTITION BY asset_id ORDER BY t) AS run FROM nw),
sp AS (SELECT asset_id, min(t) AS start_s, max(nx) AS end_s FROM ru WHERE i GROUP BY asset_id, run)"""


@query(f"WITH {runs_sql(EV + ', src AS (SELECT asset_id, t, value FROM ev)', 'value <= 25.5')} SELECT asset_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, CASE WHEN end_s - start_s <= 0.25 THEN 'high' ELSE 'medium' END AS severity FROM sp WHERE end_s - start_s >= 0.03")
def black_spans(spark, sf_dir):
    return detectors.black(B.luma(spark, sf_dir)).select("asset_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "severity")


@query(
    f"WITH {runs_sql(SCORED + ', src AS (SELECT * FROM sc)', 'coalesce(change_score <= 0.19, false)')} SELECT asset_id, start_s, end_s, CASE WHEN end_s - start_s >= 2 THEN 'high' ELSE 'medium' END AS severity FROM sp WHERE end_s - start_s >= 0.5 - 1e-6"
)
def freeze_spans(spark, sf_dir):
    scored = detectors.change_scores(B.frames(spark, sf_dir), B.SIDE, B.TILE).select("asset_id", "t", F.col("change_score").alias("change"))
    return detectors.freeze(scored, 0.19).select("asset_id", "start_s", "end_s", "severity")


@query(f"WITH {runs_sql(EV + ', src AS (SELECT asset_id, t, value FROM ev)', 'value <= 30')} SELECT asset_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, CASE WHEN end_s - start_s >= 1 THEN 'medium' ELSE 'low' END AS severity FROM sp WHERE end_s - start_s >= 0.5")
def silence_spans(spark, sf_dir):
    levels = B.luma(spark, sf_dir).select("asset_id", "t", F.col("yavg").alias("level"))
    return detectors.silence(detectors.silence_spans(levels, 30.0, 0.0)).select("asset_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "severity")


@query(
    f"""WITH {EV}, m AS (SELECT asset_id, event_type, t, row_number() OVER (PARTITION BY asset_id, event_type ORDER BY t) AS n FROM ev WHERE event_type IN ('click', 'view')),
p AS (SELECT s.asset_id, s.t AS a, e.t AS b FROM m s LEFT JOIN m e ON e.asset_id = s.asset_id AND e.n = s.n AND e.event_type = 'view' WHERE s.event_type = 'click')
SELECT 'freeze' AS kind, asset_id, round(a, 6) AS start_s, round(coalesce(b, 720.0), 6) AS end_s FROM p UNION ALL SELECT 'silence', asset_id, round(a, 6), round(b, 6) FROM p WHERE b > a"""
)
def paired_marks(spark, sf_dir):
    e = B.events(spark, sf_dir).filter("event_type IN ('click', 'view')")
    marks = e.select("asset_id", F.when(F.col("event_type") == "click", "start").otherwise("end").alias("mark"), "t")
    both = detectors.pair_freezes(marks, B.assets(spark, sf_dir)).withColumn("kind", F.lit("freeze")).unionByName(detectors.pair_silences(marks).withColumn("kind", F.lit("silence")))
    return both.select("kind", "asset_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(
    f"""WITH {FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY t) AS i, count(*) OVER (PARTITION BY asset_id) AS c FROM fr),
d AS (SELECT a.asset_id, a.t, a.i, b.i AS j, b.t AS m, {tile_max("a.thumb", "b.thumb")} AS s FROM n a JOIN n b ON a.asset_id = b.asset_id AND b.i <= a.i - 2 WHERE a.c >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY asset_id, i ORDER BY s, j) AS k FROM d)
SELECT asset_id, t, m AS matched, round(s, 6) AS tile_delta FROM r WHERE k = 1 AND s <= 0.17"""
)
def duplicate_shots(spark, sf_dir):
    from pyspark.sql import Window

    f = B.frames(spark, sf_dir)
    reps = f.select("asset_id", F.row_number().over(Window.partitionBy("asset_id").orderBy("t")).alias("index"), F.col("t").alias("start_s"), (F.col("t") + 1).alias("end_s"), "thumb")
    out = detectors.duplicate_shots(reps, B.SIDE, B.TILE, 0.17)
    return out.select("asset_id", "t", "matched", F.round("tile_delta", 6).alias("tile_delta"))


HITS = f"""{LUMA}, seg AS (SELECT asset_id, event_id AS seq, t AS start_s, t + value / 60.0 AS end_s FROM ev WHERE event_type IN ('view', 'click')),
hits AS (SELECT e.event_id AS hit_id, s.asset_id, s.t, 'luma-spike' AS kind, 'high' AS severity, NULL::DOUBLE AS start_s, NULL::DOUBLE AS end_s FROM ls s JOIN ev e ON e.asset_id = s.asset_id AND e.t = s.t WHERE form IS NOT NULL
UNION ALL SELECT event_id + 1000000000, asset_id, t, 'silence', CASE WHEN value / 60.0 >= 1 THEN 'medium' ELSE 'low' END, t, t + value / 60.0 FROM ev WHERE event_type = 'error' AND value / 60.0 >= 0.5),
cu AS (SELECT asset_id, t FROM ev WHERE event_type = 'purchase'),
pau AS (SELECT asset_id, end_s AS f, lead(start_s) OVER (PARTITION BY asset_id ORDER BY start_s, seq) AS u FROM seg),
sup AS (SELECT h.*, CASE WHEN kind = 'luma-spike' AND EXISTS (SELECT 1 FROM cu c WHERE c.asset_id = h.asset_id AND abs(c.t - h.t) <= 0.25) THEN 'confirmed-scene-cut'
WHEN kind = 'silence' AND EXISTS (SELECT 1 FROM pau p WHERE p.asset_id = h.asset_id AND p.f <= p.u AND p.f <= h.start_s AND h.end_s <= p.u) THEN 'between-transcript-segments' END AS suppression FROM hits h)"""


def _hits(spark, sf_dir):
    e = B.events(spark, sf_dir)
    luma = detectors.luma_spikes(B.luma(spark, sf_dir)).join(e.select("asset_id", "t", "event_id"), ["asset_id", "t"])
    luma = luma.select(F.col("event_id").alias("hit_id"), "asset_id", "t", "kind", "severity", F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"))
    quiet = detectors.silence(B.silence(spark, sf_dir).select("asset_id", "start_s", "end_s")).join(e.select("asset_id", "t", "event_id"), ["asset_id", "t"])
    return luma.unionByName(quiet.select((F.col("event_id") + 1000000000).alias("hit_id"), "asset_id", "t", "kind", "severity", "start_s", "end_s"))


def _suppressed(spark, sf_dir):
    e = B.events(spark, sf_dir)
    segments = B.segments(spark, sf_dir).filter("text IN ('view', 'click')")
    return intervals.suppressed(_hits(spark, sf_dir), e.filter("event_type = 'purchase'"), segments)


@query(f"WITH {HITS} SELECT hit_id, asset_id, kind, suppression FROM sup")
def suppress_structural(spark, sf_dir):
    return _suppressed(spark, sf_dir).select("hit_id", "asset_id", "kind", "suppression")


def merged_sql(source: str, base: str) -> str:
    return f"""RECURSIVE {base}, src AS ({source}), c AS (SELECT asset_id, min(t) AS a FROM src GROUP BY 1
UNION ALL SELECT c.asset_id, (SELECT min(x.t) FROM src x WHERE x.asset_id = c.asset_id AND x.t - c.a > 0.25 + 1e-9) FROM c WHERE c.a IS NOT NULL),
w AS (SELECT s.*, (SELECT max(c.a) FROM c WHERE c.asset_id = s.asset_id AND c.a <= s.t) AS a FROM src s)
SELECT asset_id, round(min(t), 6) AS t, array_to_string(list_sort(list(DISTINCT kind)), '+') AS kind, CASE max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, count(*) AS hits FROM w GROUP BY asset_id, a"""


@query(f"WITH {merged_sql('SELECT event_type AS asset_id, t, chr(97 + CAST(event_id % 3 AS INTEGER)) AS kind, CASE event_id % 4 WHEN 0 THEN $$high$$ WHEN 1 THEN $$medium$$ ELSE $$low$$ END AS severity FROM ev', EV)}")
def merge_candidates(spark, sf_dir):
    e = B.dense(spark, sf_dir)
    m = F.col("event_id") % 4
    hits = e.select("asset_id", "t", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("event_id") % 3 + 1).cast("int")).alias("kind"), F.when(m == 0, "high").when(m == 1, "medium").otherwise("low").alias("severity"))
    return folds.merge_hits(hits).select("asset_id", F.round("t", 6).alias("t"), "kind", "severity", F.size("hits").cast("long").alias("hits"))


@query(f"WITH {merged_sql('SELECT asset_id, t, kind, severity FROM sup WHERE suppression IS NULL', HITS)}")
def locate_defects(spark, sf_dir):
    kept = _suppressed(spark, sf_dir).filter("suppression IS NULL")
    return folds.merge_hits(kept).select("asset_id", F.round("t", 6).alias("t"), "kind", "severity", F.size("hits").cast("long").alias("hits"))


# ---------------------------------------------------------------- frames and times


@query(f"WITH {EV} SELECT event_id, 1 + (SELECT count(*) FROM ev c WHERE c.asset_id = f.asset_id AND c.event_type = 'purchase' AND c.t <= f.t) AS scene_id FROM ev f WHERE event_type = 'view'")
def scene_id(spark, sf_dir):
    e = B.events(spark, sf_dir)
    return joins.scene_ids(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'")).select("event_id", "scene_id")


@query(
    f"""WITH {SEG}, s AS (SELECT * FROM seg WHERE text = 'purchase'), d AS (SELECT e.event_id AS frame_id, s.seq, s.start_s, CASE WHEN e.t BETWEEN s.start_s AND s.end_s THEN 0.0 ELSE least(abs(e.t - s.start_s), abs(e.t - s.end_s)) END AS far
FROM ev e LEFT JOIN s ON s.asset_id = e.asset_id WHERE e.event_type = 'view'), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY far, start_s, seq) AS k FROM d) SELECT frame_id, seq FROM r WHERE k = 1"""
)
def nearest_line(spark, sf_dir):
    views = B.events(spark, sf_dir).filter("event_type = 'view'").withColumnRenamed("event_id", "frame_id")
    return joins.nearest_line(views, B.segments(spark, sf_dir).filter("text = 'purchase'"))


@query(
    f"""WITH {SCORED}, r AS (SELECT asset_id, t, change_score, 1 + (SELECT count(*) FROM fr c WHERE c.asset_id = s.asset_id AND CAST(c.t AS BIGINT) % 4 = 0 AND c.t <= s.t) AS scene_id FROM sc s)
SELECT asset_id, t, printf('%02d:%02d', CAST(t AS BIGINT) // 60, CAST(t AS BIGINT) % 60) AS ts, scene_id, round(change_score, 6) AS change_score FROM r WHERE t < 3600
UNION ALL SELECT asset_id, t, printf('%d:%02d:%02d', CAST(t AS BIGINT) // 3600, CAST(t AS BIGINT) % 3600 // 60, CAST(t AS BIGINT) % 60), scene_id, round(change_score, 6) FROM r WHERE t >= 3600"""
)
def frame_records(spark, sf_dir):
    f = B.frames(spark, sf_dir)
    out = pipelines.frame_records(f, f.filter(F.col("t").cast("long") % 4 == 0), B.SIDE, B.TILE)
    return out.select("asset_id", "t", "ts", "scene_id", F.round("change_score", 6).alias("change_score"))


@query(f"WITH {EV}, a AS (SELECT asset_id, min(t) AS s, max(t) AS e FROM ev GROUP BY 1), i AS (SELECT *, unnest(range(9)) AS k FROM a) SELECT asset_id, round(s + k * ((e - s) / 8), 3) AS t FROM i")
def uniform_times(spark, sf_dir):
    a = B.events(spark, sf_dir).groupBy("asset_id").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s")).withColumn("n", F.lit(9))
    return series.uniform(a)


@query(
    f"""WITH {EV}, r AS (SELECT asset_id, event_id, row_number() OVER (PARTITION BY asset_id ORDER BY t, event_id) - 1 AS p, count(*) OVER (PARTITION BY asset_id) AS n FROM ev),
i AS (SELECT asset_id, n, unnest(range(12)) AS k FROM (SELECT DISTINCT asset_id, n FROM r)), w AS (SELECT DISTINCT asset_id, least(n - 1, CAST(round_even(k * ((n - 1) / 11), 0) AS BIGINT)) AS p FROM i WHERE n > 12)
SELECT r.asset_id, r.event_id FROM r WHERE n <= 12 OR EXISTS (SELECT 1 FROM w WHERE w.asset_id = r.asset_id AND w.p = r.p)"""
)
def even_sample(spark, sf_dir):
    return series.thin(B.events(spark, sf_dir), 12, ["t", "event_id"]).select("asset_id", "event_id")


def floor_sql(knots) -> str:
    out = str(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = f"CASE WHEN d <= {x1} THEN {y0} + (d - {x0}) / ({x1} - {x0}) * ({y1} - {y0}) ELSE {out} END"
    return out


@query(
    f"""WITH s AS (SELECT p_partkey, CAST(p_size * 13.0 AS DOUBLE) AS d FROM part)
SELECT p_partkey, CAST(greatest(1, least(100, greatest(12, ceil(d / least(greatest(sqrt(d) / 3, 0.5), 4.0)), ceil({floor_sql(S.FLOOR["wide"])})), greatest(1, ceil(d * 3)))) AS INTEGER) AS wide,
CAST(greatest(1, least(100, greatest(18, ceil(d / greatest(least(greatest(sqrt(d) / 3, 0.5), 4.0) / 1.75, 0.25)), ceil({floor_sql(S.FLOOR["focus"])})), greatest(1, ceil(d * 4)))) AS INTEGER) AS focus,
CAST(greatest(1, round_even(2.5 * d, 0)) AS INTEGER) AS stated FROM s"""
)
def adaptive_sampling(spark, sf_dir):
    d = (F.col("p_size") * 13.0).cast("double")
    return B.table(spark, sf_dir, "part").select("p_partkey", S.plan_target(d, False).alias("wide"), S.plan_target(d, True).alias("focus"), S.plan_target(d, False, F.lit(2.5)).alias("stated"))


@query(
    f"""WITH {EV}, h AS (SELECT asset_id, t FROM ev WHERE event_type = 'error' AND t BETWEEN 100 AND 200), b AS (SELECT asset_id, t, greatest(100.0, t - 0.5) AS lo, least(200.0, t + 0.5) AS hi FROM h),
g AS (SELECT asset_id, lo, hi, unnest(range(CAST(floor((hi - lo) / 0.1::DOUBLE + 1e-9) AS BIGINT) + 1)) AS i FROM b)
SELECT DISTINCT asset_id, t FROM (SELECT asset_id, round(least(hi, lo + i * 0.1::DOUBLE), 3) AS t FROM g UNION ALL SELECT asset_id, round(t, 3) FROM h)"""
)
def burst_times(spark, sf_dir):
    hits = B.events(spark, sf_dir).filter("event_type = 'error'").select("asset_id", "t", F.lit(100.0).alias("start_s"), F.lit(200.0).alias("end_s"))
    return series.bursts(hits)


@query(
    f"""WITH {EV}, a AS (SELECT DISTINCT asset_id FROM ev), pool AS (SELECT DISTINCT asset_id, round(t, 3) AS t FROM ev WHERE event_type = 'view' AND round(t, 3) BETWEEN 10 AND 700),
c AS (SELECT a.asset_id, count(p.t) AS n, max(p.t) AS last FROM a LEFT JOIN pool p USING (asset_id) GROUP BY 1), f AS (SELECT *, n < 13 AS few FROM c)
SELECT DISTINCT asset_id, t, strategy FROM (
SELECT p.asset_id, p.t, CASE WHEN few THEN 'keyframe+uniform' ELSE 'keyframe' END AS strategy FROM pool p JOIN f USING (asset_id)
UNION ALL SELECT asset_id, round(10 + unnest(range(40)) * (690.0 / 39), 3), 'keyframe+uniform' FROM f WHERE few
UNION ALL SELECT asset_id, 10.0, 'keyframe' FROM f WHERE NOT few UNION ALL SELECT asset_id, 699.95, 'keyframe' FROM f WHERE NOT few AND 699.5 > last)"""
)
def select_candidates(spark, sf_dir):
    a = B.assets(spark, sf_dir).select("asset_id", F.lit(10.0).alias("start_s"), F.lit(700.0).alias("end_s"), F.lit(40).alias("target"))
    return series.candidates(a, detectors.keyframes(B.packets(spark, sf_dir)), "keyframe")


@query(f"WITH {EV}, r AS (SELECT event_id, asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY t, event_id) - 1 AS p FROM ev) SELECT event_id, asset_id, p // 25 AS chunk, p % 25 AS slot FROM r")
def sheet_chunks(spark, sf_dir):
    return series.chunks(B.events(spark, sf_dir), 25, ["t", "event_id"]).select("event_id", "asset_id", "chunk", "slot")


@query(f"WITH {EV} SELECT DISTINCT asset_id, round(t, 3) AS t FROM ev WHERE event_type = 'view'")
def keyframe_times(spark, sf_dir):
    return detectors.keyframes(B.packets(spark, sf_dir))


@query(
    f"""WITH {SHOTS}, m AS (SELECT asset_id, "index", "start" + ("end" - "start") * 0.5::DOUBLE AS t FROM shots WHERE seconds >= 0.15)
SELECT m.asset_id, m."index", arg_min(e.event_id, e.t) AS event_id FROM m LEFT JOIN ev e ON e.asset_id = m.asset_id AND e.t >= m.t GROUP BY 1, 2"""
)
def shot_representatives(spark, sf_dir):
    e = B.events(spark, sf_dir)
    shots = intervals.shots(B.assets(spark, sf_dir), e)
    return detectors.representatives(shots, e, "event_id").select("asset_id", "index", "event_id")


@query(
    """WITH c AS (SELECT c_custkey, c_acctbal / 50 AS s, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal / 50 + 30 END AS e, c_nationkey * 10.0::DOUBLE AS d FROM customer)
SELECT c_custkey, round(CASE WHEN d > 0 THEN greatest(0.0, least(s, greatest(0.0, d - 0.1::DOUBLE))) ELSE s END, 6) AS "start", round(CASE WHEN d > 0 THEN least(coalesce(e, d), d) ELSE coalesce(e, s + 60) END, 6) AS "end", coalesce(e, d) - s > 600 AS forced FROM c"""
)
def resolve_window(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    start, d = F.col("c_acctbal") / 50, F.col("c_nationkey") * 10.0
    end = F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal") / 50 + 30)
    return c.select("c_custkey", F.round(S.window_start(start, d), 6).alias("start"), F.round(S.window_end(start, end, d), 6).alias("end"), S.needs_force(F.coalesce(end, d) - start).alias("forced"))


@query("SELECT p_partkey, CAST(least(5, greatest(1, floor(sqrt(p_size) + 0.999))) AS INTEGER) AS cols, CAST(ceil(p_size / least(5, greatest(1, floor(sqrt(p_size) + 0.999)))) AS INTEGER) AS rows, CAST(greatest(12, least(120, round_even(p_size * 3.0, 0))) AS INTEGER) AS moments FROM part")
def grid_for(spark, sf_dir):
    n = F.col("p_size")
    return B.table(spark, sf_dir, "part").select("p_partkey", S.grid_columns(n).alias("cols"), S.grid_rows(n).alias("rows"), S.moment_count(n * 3.0).alias("moments"))


@query(
    f"""WITH {EV}, n AS (SELECT asset_id, max(t) - min(t) AS span, count(*) AS requested, count(*) FILTER (event_type <> 'error') AS extracted, count(*) FILTER (event_type IN ('view', 'click')) AS kept FROM ev GROUP BY 1)
SELECT asset_id, requested, extracted, kept, round(span / greatest(1, kept), 6) AS every, span / greatest(1, kept) > 2.0 AS sparse FROM n"""
)
def frame_counts(spark, sf_dir):
    n = B.events(spark, sf_dir).groupBy("asset_id").agg(
        (F.max("t") - F.min("t")).alias("span"), F.count(F.lit(1)).alias("requested"), F.count(F.when(F.col("event_type") != "error", 1)).alias("extracted"), F.count(F.when(F.col("event_type").isin("view", "click"), 1)).alias("kept")
    )
    every = S.coverage_interval(F.col("span"), F.col("kept"))
    return n.select("asset_id", "requested", "extracted", "kept", F.round(every, 6).alias("every"), (every > 2.0).alias("sparse"))


@query(f"WITH {EV}, f AS (SELECT asset_id, min(t) AS t FROM ev WHERE event_type = 'purchase' GROUP BY 1) SELECT asset_id, round(t / 720 * 100, 6) AS percent FROM f")
def proof_placement(spark, sf_dir):
    marks = B.events(spark, sf_dir).filter("event_type = 'purchase'")
    return findings.placement(B.assets(spark, sf_dir), marks).withColumn("percent", F.round("percent", 6))


@query(
    f"""WITH {EV}, b AS (SELECT asset_id, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN true WHEN 'error' THEN false WHEN 'signup' THEN false END AS supported FROM ev)
SELECT asset_id, count(supported) AS scored, count(*) FILTER (NOT supported) AS unsupported, count(*) FILTER (supported IS NULL) AS unscored, round(count(*) FILTER (NOT supported) / count(*), 6) AS debt FROM b GROUP BY 1"""
)
def retention_debt(spark, sf_dir):
    kind = F.col("event_type")
    beats = B.events(spark, sf_dir).select("asset_id", F.when(kind.isin("view", "click"), True).when(kind.isin("error", "signup"), False).alias("supported"))
    return findings.debt(beats).withColumn("debt", F.round("debt", 6))


# ---------------------------------------------------------------- prices and budgets


@query(f"WITH {SIZES} SELECT p_partkey, " + ", ".join(f"CAST({price(f, 'width', 'height')} AS BIGINT) AS {f.replace(':', '_').replace('-', '_')}" for f in [*PRICE, "generic"]) + " FROM sz")
def token_models(spark, sf_dir):
    return B.sizes(spark, sf_dir).select("p_partkey", *[P.tokens(F.col("width"), F.col("height"), f).alias(f.replace(":", "_").replace("-", "_")) for f in [*PRICE, "generic"]])


@query(f"WITH {SIZES} SELECT p_partkey, CAST(greatest(1, floor(20000 / greatest(1, {price('generic', 'width', 'height')}))) AS BIGINT) AS frames FROM sz")
def frames_for_budget(spark, sf_dir):
    return B.sizes(spark, sf_dir).select("p_partkey", P.frames_for_budget(F.lit(20000), P.tokens(F.col("width"), F.col("height"), "generic")).alias("frames"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai:4o' WHEN 2 THEN 'gemini' WHEN 3 THEN 'generic' ELSE 'qwen:video' END AS family FROM nation")
def vendor_resolve(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("Claude", " gpt ", "google", "", "qwen:video")])
    n = B.table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(names, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("request"))
    return P.resolve(n).select("n_nationkey", "family")


COMPARED = ("anthropic", "openai:4o", "openai:5", "gemini", "qwen", "qwen:video")


@query(f"WITH {SIZES} " + " UNION ALL ".join(f"SELECT p_partkey, '{f}' AS family, CAST({price(f, 'width', 'height')} AS BIGINT) AS tokens FROM sz" for f in COMPARED))
def vendor_compare(spark, sf_dir):
    return P.compare(B.sizes(spark, sf_dir)).select("p_partkey", "family", "tokens")


@query(
    f"""WITH {SIZES}, e AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1000 END AS edge, greatest(width, height) AS l FROM sz)
SELECT p_partkey, CASE WHEN edge IS NULL OR l <= edge THEN width ELSE CAST(greatest(2, floor(floor(width * (edge / l)) / 2) * 2) AS INTEGER) END AS w, CASE WHEN edge IS NULL OR l <= edge THEN height ELSE CAST(greatest(2, floor(floor(height * (edge / l)) / 2) * 2) AS INTEGER) END AS h FROM e"""
)
def fit_to_edge(spark, sf_dir):
    edge = F.when(F.col("p_partkey") % 3 != 0, F.lit(1000))
    w, h = F.col("width"), F.col("height")
    return B.sizes(spark, sf_dir).select("p_partkey", S.fit_edge(w, w, h, edge).alias("w"), S.fit_edge(h, w, h, edge).alias("h"))


def high(w: str) -> str:
    return f"greatest(2, CAST(round_even({w} * height / width, 0) AS INTEGER))"


@query(
    f"""WITH {SIZES}, c AS (SELECT *, unnest(range(384, 513, 2)) AS c FROM (SELECT *, 20 + p_partkey % 90 AS frames FROM sz)), f AS (SELECT p_partkey, max(c) FILTER ({price('anthropic', 'c', high('c'))} * frames <= 20000) AS best FROM c GROUP BY 1)
SELECT p_partkey, CAST(coalesce(best, 384) AS INTEGER) AS read_width, CASE WHEN best IS NULL THEN 'managed-floor' WHEN best < 512 THEN 'managed' ELSE 'default' END AS mode FROM f"""
)
def read_frame_size(spark, sf_dir):
    a = B.sizes(spark, sf_dir).withColumn("frames", 20 + F.col("p_partkey") % 90)
    return budget.read_size(a, "anthropic").select("p_partkey", F.col("read_width").cast("int").alias("read_width"), "mode")


@query(
    f"""WITH {SIZES}, t AS (SELECT *, unnest([320, 256, 204, 163, 130, 104, 96]) AS tile FROM sz), c AS (SELECT *, greatest(1, {price('generic', '(tile + 4) * 5', '(greatest(1, CAST(round_even(tile * height / width, 0) AS INTEGER)) + 4) * 5')}) AS cost FROM t),
b AS (SELECT p_partkey, coalesce(max(tile) FILTER (cost <= 3000), 96) AS tile FROM c GROUP BY 1)
SELECT p_partkey, CAST(b.tile AS INTEGER) AS tile_width, CAST(cost AS BIGINT) AS sheet_tokens, cost <= 3000 AS fits FROM b JOIN c USING (p_partkey, tile)"""
)
def scan_solver(spark, sf_dir):
    return budget.scan_plan(B.sizes(spark, sf_dir)).select("p_partkey", "tile_width", "sheet_tokens", "fits")


@query(
    f"""WITH {SIZES}, t AS (SELECT *, unnest([320, 256, 204, 163, 130, 104, 96]) AS tile FROM sz), c AS (SELECT *, greatest(1, {price('generic', '(tile + 4) * 5', '(greatest(1, CAST(round_even(tile * height / width, 0) AS INTEGER)) + 4) * 5')}) AS cost FROM t),
b AS (SELECT p_partkey, max(tile) FILTER (cost <= 3000) AS tile FROM c GROUP BY 1),
f AS (SELECT p_partkey, tile, CAST(cost AS BIGINT) AS cost, 30.0 + p_partkey % 400 AS d, CAST(greatest(4, least(200, floor(3000 / cost) * 25)) AS BIGINT) AS cap FROM b JOIN c USING (p_partkey, tile)),
e AS (SELECT p_partkey, round(i * (d / (cap - 1)), 3)::DOUBLE AS t FROM (SELECT *, unnest(range(cap)) AS i FROM f) UNION SELECT p_partkey, 1.0::DOUBLE FROM f),
r AS (SELECT p_partkey, t, row_number() OVER (PARTITION BY p_partkey ORDER BY t) - 1 AS place, count(*) OVER (PARTITION BY p_partkey) AS n FROM e),
k AS (SELECT DISTINCT p_partkey, least(n - 1, CASE WHEN n <= cap THEN i ELSE CAST(round_even(i * ((n - 1) / (cap - 1)), 0) AS BIGINT) END) AS place FROM (SELECT f.p_partkey, cap, n, unnest(range(cap)) AS i FROM f JOIN (SELECT DISTINCT p_partkey, n FROM r) USING (p_partkey))),
m AS (SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY t) - 1) // 25 AS sheet, t FROM r JOIN k USING (p_partkey, place))
SELECT CAST(p_partkey AS VARCHAR) AS asset_id, CAST(sheet AS BIGINT) AS sheet, CAST(tile AS INTEGER) AS tile_width, count(*) AS n, 5 AS cols, 5 AS "rows", cost AS tokens, round(min(t), 3) AS first_t, round(max(t), 3) AS last_t
FROM m JOIN f USING (p_partkey) GROUP BY p_partkey, sheet, tile, cost"""
)
def scan(spark, sf_dir):
    a = B.sizes(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("asset_id"), "width", "height", F.lit(0.0).alias("start_s"), (30.0 + F.col("p_partkey") % 400).alias("end_s"))
    out = pipelines.scan(a, a.select("asset_id", F.lit(1.0).alias("t")))
    return out.select("asset_id", "sheet", F.col("tile_width").cast("int").alias("tile_width"), F.size("times").cast("long").alias("n"), "cols", "rows", "tokens", F.round(F.array_min("times"), 3).alias("first_t"), F.round(F.array_max("times"), 3).alias("last_t"))


@query(
    f"""WITH {SIZES}, p AS (SELECT *, {price('generic', 'width', 'height')} AS e, 10 + p_partkey % 60 AS frames FROM sz)
SELECT p_partkey, CAST(e * frames AS BIGINT) AS tokens, e * frames > 20000 AS "over", CAST(greatest(1, floor(20000 / greatest(1, e))) AS BIGINT) AS affordable, greatest(1, floor(20000 / greatest(1, e))) / 2.0 AS window_s FROM p"""
)
def budget_guard(spark, sf_dir):
    reads = B.sizes(spark, sf_dir).withColumn("frames", 10 + F.col("p_partkey") % 60).withColumn("fps", F.lit(2.0))
    return budget.guard(reads).select("p_partkey", "tokens", "over", "affordable", "window_s")


LAYOUT = f"""WITH {SIZES}, g AS (SELECT *, greatest(1, CAST(round_even(540 * height / width, 0) AS INTEGER)) AS th FROM sz), o AS (SELECT *, unnest([2, 2, 2, 2, 2, 3, 3, 3, 3, 3]) AS cols, unnest([2, 3, 4, 5, 6, 2, 3, 4, 5, 6]) AS rows, unnest(range(10)) AS k FROM g),
ok AS (SELECT *, 540 * least(1.0, 1568 / greatest(544 * cols, (th + 4) * rows)) >= 380 AS good FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY cols * rows DESC, k) AS n FROM ok WHERE good AND cols * rows > 4)
SELECT sz.p_partkey, coalesce(r.cols, 2) AS cols, coalesce(r.rows, 2) AS rows FROM sz LEFT JOIN r ON r.p_partkey = sz.p_partkey AND r.n = 1"""


@query(
    f"""WITH {SIZES}, d AS (SELECT *, CAST(p_partkey % 400 AS DOUBLE) AS d FROM sz), n AS (SELECT *, CASE WHEN d <= 0 THEN 1 ELSE CAST(greatest(1, least(100, greatest(12, ceil(d / least(greatest(sqrt(d) / 3, 0.5), 4.0)), ceil({floor_sql(S.FLOOR["wide"])})), greatest(1, ceil(d * 3)))) AS INTEGER) END AS frames FROM d),
c AS (SELECT *, unnest(range(384, 513, 2)) AS c FROM n), f AS (SELECT p_partkey, any_value(frames) AS frames, any_value(d) AS d, max(c) FILTER ({price('qwen', 'c', high('c'))} * frames <= 20000) AS best FROM c GROUP BY 1)
SELECT p_partkey, frames, CAST(coalesce(best, 384) AS INTEGER) AS read_width, d > 180 AS needs_force FROM f"""
)
def quick_plan(spark, sf_dir):
    a = B.sizes(spark, sf_dir).withColumn("duration", (F.col("p_partkey") % 400).cast("double"))
    return pipelines.quick(a, "qwen").select("p_partkey", "frames", F.col("read_width").cast("int").alias("read_width"), "needs_force")


@query(LAYOUT)
def sheet_layout(spark, sf_dir):
    return budget.sheet_layout(B.sizes(spark, sf_dir)).select("p_partkey", "cols", "rows")


# ---------------------------------------------------------------- names and caches


@query("SELECT page_id, substr(sha256(CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') OR starts_with(url, 'www.') THEN 'url:' || trim(url) ELSE 'file:' || url || ':' || page_id || ':7' END), 1, 16) AS key FROM pages")
def cache_key(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", S.cache_key(F.col("url"), F.col("page_id"), F.lit(7)).alias("key"))


@query("SELECT p_partkey, substr(sha256('mode=scene|n=' || p_size || '|w=' || p_partkey), 1, 10) AS run FROM part")
def run_id(spark, sf_dir):
    return B.table(spark, sf_dir, "part").select("p_partkey", S.run_id(w=F.col("p_partkey"), n=F.col("p_size"), mode=F.lit("scene")).alias("run"))


@query(f"WITH {EV} SELECT event_id, printf('w%d_raw_t%09d.jpg', 512, CAST(round_even(t * 1000, 0) AS BIGINT)) AS name FROM ev")
def frame_name(spark, sf_dir):
    return B.events(spark, sf_dir).select("event_id", S.frame_name(F.col("t"), F.lit(512), False).alias("name"))


@query(
    """WITH a AS (SELECT o_orderkey AS ask_id, o_custkey, CAST(o_orderkey % 500 AS DOUBLE) AS s, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 500 + 20.0 END AS e FROM orders),
w AS (SELECT c_custkey, c_custkey * 2 + k AS window_id, CASE k WHEN 0 THEN 100.0 ELSE 0.0 END AS s, CASE WHEN c_custkey % 2 = 0 AND k = 1 THEN NULL ELSE 300.0 END AS e, CASE WHEN c_custkey % 5 = 0 THEN 0.3 ELSE 0.15 END AS th FROM customer, (SELECT unnest([0, 1]) AS k))
SELECT ask_id, min(window_id) AS window_id FROM a LEFT JOIN w ON w.c_custkey = a.o_custkey AND abs(w.th - 0.15) < 1e-9 AND w.s <= a.s + 0.01 AND (w.e IS NULL OR w.e >= a.e - 0.01) GROUP BY 1"""
)
def cache_window_reuse(spark, sf_dir):
    o, c = B.table(spark, sf_dir, "orders"), B.table(spark, sf_dir, "customer")
    at = (F.col("o_orderkey") % 500).cast("double")
    asks = o.select(F.col("o_orderkey").alias("ask_id"), F.col("o_custkey").alias("asset_id"), at.alias("start_s"), F.when(F.col("o_orderkey") % 7 != 0, at + 20.0).alias("end_s"), F.lit(0.15).alias("threshold"))
    two = c.select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    windows = two.select(
        F.col("c_custkey").alias("asset_id"),
        (F.col("c_custkey") * 2 + F.col("k")).alias("window_id"),
        F.when(F.col("k") == 0, 100.0).otherwise(0.0).alias("w_start"),
        F.when(~((F.col("c_custkey") % 2 == 0) & (F.col("k") == 1)), 300.0).alias("w_end"),
        F.when(F.col("c_custkey") % 5 == 0, 0.3).otherwise(0.15).alias("w_threshold"),
    )
    return cache.reused_windows(asks, windows).select("ask_id", "window_id")


@query(
    """SELECT c_custkey, coalesce(c_custkey % 4 > 0 AND ((c_custkey % 2 = 0) OR (c_mktsegment = 'BUILDING' AND c_nationkey % 3 = 0) OR (c_mktsegment = 'MACHINERY' AND c_nationkey % 2 = 0)), false) AS reusable FROM customer"""
)
def transcript_reuse(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    source = F.when(F.col("c_mktsegment") == "BUILDING", "captions").when(F.col("c_mktsegment") == "MACHINERY", "embedded").otherwise("whisper")
    same, subs, lang = F.col("c_custkey") % 2 == 0, (F.col("c_nationkey") % 3 == 0), (F.col("c_nationkey") % 2 == 0)
    # Where the key is even all four agree; else the model differs, and the languages agree by the nation.
    params = F.struct(F.lit(True).alias("whisper"), F.lit("base").alias("model"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("sub_langs"))
    wanted = F.struct(F.lit(True).alias("whisper"), F.when(same, "base").otherwise("small").alias("model"), F.when(same | lang, "en").otherwise("de").alias("language"), F.when(same | subs, F.lit(None).cast("string")).otherwise("en").alias("sub_langs"))
    return c.select("c_custkey", cache.reusable(source, F.col("c_custkey") % 4, params, wanted).alias("reusable"))


@query(
    """WITH f AS (SELECT l_orderkey, CASE l_linenumber % 4 WHEN 1 THEN 'captions' WHEN 2 THEN 'embedded' WHEN 3 THEN 'asr' ELSE 'cached' END AS source, sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_linenumber + 3 END) AS segments, l_orderkey % 3 > 0 AS use_asr, l_orderkey % 5 > 0 AS has_audio FROM lineitem GROUP BY ALL),
r AS (SELECT *, CASE source WHEN 'cached' THEN 1 WHEN 'captions' THEN 2 WHEN 'embedded' THEN 3 ELSE 6 END AS k, segments > 0 AND (source <> 'asr' OR (use_asr AND has_audio)) AS ok FROM f)
SELECT CAST(l_orderkey AS VARCHAR) AS asset_id, coalesce(arg_min(source, k) FILTER (ok), CASE WHEN NOT any_value(use_asr) THEN 'none' WHEN NOT any_value(has_audio) THEN 'no audio track' ELSE 'asr' END) AS source,
CAST(coalesce(arg_min(segments, k) FILTER (ok), 0) AS BIGINT) AS segments, coalesce(bool_or(ok), false) AS stored FROM r GROUP BY l_orderkey"""
)
def transcript_priority(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(x) for x in ("cached", "captions", "embedded", "asr")])
    key = F.col("l_orderkey")
    found = li.select(key.cast("string").alias("asset_id"), F.element_at(names, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("source"), F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_linenumber") + 3).alias("segments"), (key % 3 > 0).alias("use_asr"), (key % 5 > 0).alias("has_audio"))
    found = found.groupBy("asset_id", "source", "use_asr", "has_audio").agg(F.sum("segments").alias("segments"))
    return cache.chosen_transcript(found)


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(sum(CAST(o_totalprice AS BIGINT)) AS BIGINT) AS bytes, count(*) AS files, max(o_orderdate) AS last_used FROM orders GROUP BY 1")
def cache_list(spark, sf_dir):
    files = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.bround("o_totalprice").cast("long").alias("bytes"), F.col("o_orderdate").alias("used"))
    return cache.entries(files)


@query("WITH r AS (SELECT o_orderkey AS key, sum(CAST(round_even(o_totalprice * 100, 0) AS BIGINT)) OVER (ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders) SELECT key, CAST(running AS BIGINT) AS running FROM r WHERE running > 100000000000")
def lru_trim(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.bround(F.col("o_totalprice") * 100).cast("long").alias("bytes"), F.col("o_orderdate").alias("last_used"))
    return cache.evicted(o, 100_000_000_000).select("key", "running")


@query("SELECT DISTINCT 'f' || l_partkey AS path FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 11 > 0 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def manifest_diff(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    path = F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("../f"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("f"), F.col("l_partkey").cast("string")))
    return cache.stale_files(li.filter("l_returnflag = 'R'").select(path.alias("path")), li.filter("l_returnflag = 'A'").select(path.alias("path")))


# ---------------------------------------------------------------- findings

FOUND = f"""{AUDIO}, {DENSITY}, {SHOTS.replace(EV + ', ', '')},
hd AS (SELECT asset_id, count(*) AS n, arg_max("end", "index") AS span FROM shots WHERE "start" < 216 GROUP BY 1),
fi AS (SELECT asset_id, 'slow open' AS rule, 0.0 AS "at" FROM hd WHERE n <= 3 AND span < 432
UNION ALL SELECT asset_id, 'upper bound', 0.0 FROM (SELECT asset_id, count(*) AS n FROM shots GROUP BY 1) WHERE n / 12.0 >= 10 AND CAST(asset_id AS BIGINT) % 2 = 0
UNION ALL SELECT asset_id, 'content change', 0.0 FROM ass WHERE CAST(asset_id AS BIGINT) % 2 = 1
UNION ALL SELECT asset_id, CASE WHEN silent_fraction >= 0.6 THEN 'silence' ELSE 'quiet' END, "start" FROM aud WHERE silent_fraction >= 0.6 OR seconds >= 4
UNION ALL SELECT asset_id, 'low speech', 0.0 FROM den WHERE density < 0.5
UNION ALL SELECT asset_id, 'machine transcript', 0.0 FROM ass WHERE CAST(asset_id AS BIGINT) % 3 = 0)"""


def _findings(spark, sf_dir):
    key = F.col("asset_id").cast("long")
    a = B.assets(spark, sf_dir).withColumn("source", F.when(key % 3 == 0, "whisper.cpp").otherwise("captions")).withColumn("cut_method", F.when(key % 2 == 1, "content-change").otherwise("scene"))
    segments = B.segments(spark, sf_dir)
    found = intervals.shots(a, B.luma(spark, sf_dir))
    return findings.findings(a, found, _audio(spark, sf_dir), intervals.speech_density(a, segments))


@query(f'WITH {FOUND} SELECT asset_id, rule, round("at", 6) AS "at" FROM fi')
def findings_report(spark, sf_dir):
    return _findings(spark, sf_dir).select("asset_id", "rule", F.round("at", 6).alias("at"))


@query(f"WITH {FOUND} SELECT rule, count(DISTINCT asset_id) AS assets FROM fi GROUP BY 1 HAVING count(DISTINCT asset_id) >= 2 ORDER BY assets DESC, rule LIMIT 5")
def cross_asset_repeats(spark, sf_dir):
    return findings.repeated(_findings(spark, sf_dir))


@query("WITH c AS (SELECT conv_id, turn, length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) + len(list_filter(regexp_split_to_array(regexp_replace(text, '[\\x{4e00}-\\x{9fff}]', ' ', 'g'), '\\s+'), lambda w: w <> '')) AS units FROM conversations) SELECT conv_id, turn, units, round(units / (turn + 1.0), 6) AS load FROM c")
def reading_load(spark, sf_dir):
    cards = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") + 1.0).alias("seconds"))
    return findings.reading_load(cards).select("conv_id", "turn", "units", F.round("load", 6).alias("load"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'shared,paid' WHEN c_custkey % 3 = 1 THEN 'shared,organic' ELSE 'shared' END AS guides FROM customer")
def intent_guides(spark, sf_dir):
    m = F.col("c_custkey") % 3
    c = B.table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.array_join(S.guides(F.when(m == 0, "paid").when(m == 1, "organic")), ",").alias("guides"))


@query()
def extract_brief(spark, sf_dir):
    """The whole analysis of every timeline as a Markdown brief. SQL can't express it; tests read it."""
    return pipelines.extract(B.assets(spark, sf_dir).withColumn("source", F.lit("captions")), B.events(spark, sf_dir).select("asset_id", "t"), B.segments(spark, sf_dir), B.silence(spark, sf_dir))
