"""Provisional findings about a timeline, each of a rule, with what to check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.scalars import format_time, per_minute


def slow_open(assets: DataFrame, shots: DataFrame) -> DataFrame:
    """Assets whose first third is one to three shots that end before three fifths: asset_id, shots, span."""
    early = shots.join(assets.select("asset_id", "duration"), "asset_id").filter("start < duration * 0.3")
    head = early.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("end", "index").alias("span"), F.max("duration").alias("duration"))
    return head.filter("n <= 3 AND span < duration * 0.6")


def findings(assets: DataFrame, shots: DataFrame, gaps: DataFrame, density: DataFrame) -> DataFrame:
    """asset_id, rule, at, note. assets: asset_id, duration, source, cut_method; gaps: with audio."""
    a = assets.select("asset_id", "duration", "source", "cut_method")
    head = slow_open(a, shots)
    r1 = head.select("asset_id", F.lit("slow open").alias("rule"), F.lit(0.0).alias("at"), F.concat(F.lit("opening of "), format_time(F.col("span")), F.lit(" in "), F.col("n").cast("string"), F.lit(" shots")).alias("note"))
    counted = a.join(shots.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")), "asset_id", "left").withColumn("rate", per_minute(F.coalesce("n", F.lit(0)), F.col("duration")))
    busy = (F.coalesce("n", F.lit(0)) > 0) & (F.col("rate") >= 10) & F.startswith("cut_method", F.lit("scene"))
    r23 = counted.withColumn("rule", F.when(busy, "upper bound").when(F.startswith("cut_method", F.lit("content-change")), "content change")).filter("rule IS NOT NULL")
    r23 = r23.select("asset_id", "rule", F.lit(0.0).alias("at"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" shots")).alias("note"))
    kind = F.when(F.col("audio") == "silent", "silence").when(F.col("seconds") >= 4.0, "quiet")
    r45 = gaps.withColumn("rule", kind).filter("rule IS NOT NULL").select("asset_id", "rule", F.col("start").alias("at"), F.concat(format_time(F.col("start")), F.lit("-"), format_time(F.col("end")), F.lit(" "), F.col("audio"), F.lit(" ("), F.col("where_"), F.lit(")")).alias("note"))
    r6 = density.join(a, "asset_id").filter("density < 0.5 AND duration > 10").select("asset_id", F.lit("low speech").alias("rule"), F.lit(0.0).alias("at"), F.concat(F.bround(F.col("density") * 100).cast("int").cast("string"), F.lit("% speech")).alias("note"))
    r7 = a.filter(F.startswith("source", F.lit("whisper")) | F.startswith("source", F.lit("openai-whisper"))).select("asset_id", F.lit("machine transcript").alias("rule"), F.lit(0.0).alias("at"), F.col("source").alias("note"))
    out = r1
    for more in (r23, r45, r6, r7):
        out = out.unionByName(more)
    return out


# What to check, by rule.
VERIFY = {
    "slow open": "See whether the opening frames show one setup.",
    "upper bound": "Count the real cuts from neighbouring frames; camera movement counts as cuts here.",
    "content change": "Boundaries are exact to about a second.",
    "silence": "The audio track is silent too; see what the picture does.",
    "quiet": "See whether the picture carries this span.",
    "low speech": "See whether the rest does visual work.",
    "machine transcript": "Read names off the frames.",
}


def with_checks(found: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in VERIFY.items() for x in pair])
    return found.withColumn("verify", F.element_at(table, F.col("rule")))


def repeated(found: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """Rules met in several assets, the commonest first: rule, assets."""
    return found.groupBy("rule").agg(F.countDistinct("asset_id").alias("assets")).filter(F.col("assets") >= least).orderBy(F.desc("assets"), "rule").limit(most)


def reading_load(cards: DataFrame) -> DataFrame:
    """Adds load: Chinese characters and other words of a text for each second that it shows. cards: text, seconds."""
    han = F.char_length(F.regexp_replace("text", r"[^\x{4e00}-\x{9fff}]", ""))
    words = F.size(F.filter(F.split(F.regexp_replace("text", r"[\x{4e00}-\x{9fff}]", " "), r"\s+"), lambda w: w != ""))
    return cards.withColumn("units", (han + words).cast("long")).withColumn("load", F.when(F.col("seconds") > 0, F.col("units") / F.col("seconds")))


def debt(beats: DataFrame) -> DataFrame:
    """scored, unsupported, unscored and debt of each asset: the share of all its beats that are known to lack support.

    beats: asset_id, supported (null where a beat wasn't scored). Unscored beats are never a debt, stay in the
    whole, and are told apart.
    """
    return beats.groupBy("asset_id").agg(
        F.count("supported").alias("scored"),
        F.count(F.when(~F.col("supported"), 1)).alias("unsupported"),
        F.count(F.when(F.col("supported").isNull(), 1)).alias("unscored"),
    ).withColumn("debt", F.col("unsupported") / (F.col("scored") + F.col("unscored")))


def placement(assets: DataFrame, marks: DataFrame) -> DataFrame:
    """asset_id, percent: how far into each asset its first mark (asset_id, t) stands."""
    first = marks.groupBy("asset_id").agg(F.min("t").alias("t"))
    return assets.join(first, "asset_id").select("asset_id", F.when(F.col("duration") > 0, F.col("t") / F.col("duration") * 100).alias("percent"))
