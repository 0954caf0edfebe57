"""Scalar rules of media timelines as Column expressions: times, names, sizes, rates, sampling plans.

Integer rounding is half-even (bround) where an index or a size is made; decimals are rounded only when
they are shown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity ranks, sampling minimums, rate limits and the knots of the coverage floor.
SEVERITY = ("low", "medium", "high")
MIN_FRAMES = {"wide": 12, "focus": 18}
RATE_LIMIT = {"wide": 3.0, "focus": 4.0}
MAX_FRAMES = 100
FLOOR = {
    "wide": ((0.0, 0.0), (6.0, 12.0), (12.0, 12.0), (30.0, 40.0), (60.0, 60.0), (180.0, 80.0), (600.0, 100.0)),
    "focus": ((0.0, 0.0), (30.0, 60.0), (40.0, 80.0), (60.0, 100.0)),
}
URL_SCHEMES = ("http://", "https://", "www.")


def parse_time(text: Column) -> Column:
    """SS, MM:SS or HH:MM:SS[.f] with an optional sign, as seconds; null or empty gives null, anything else an error."""
    clean = F.trim(text)
    body = F.regexp_replace(clean, "^-", "")
    value = F.aggregate(F.split(body, ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))
    good = F.regexp_like(clean, F.lit(r"^-?\d+(\.\d*)?$|^-?\d+(:\d+){1,2}(\.\d*)?$"))
    return F.when(clean.isNull() | (clean == ""), F.lit(None).cast("double")).when(good, F.when(F.startswith(clean, F.lit("-")), -value).otherwise(value)).otherwise(F.raise_error(F.concat(F.lit("not a time: "), text)).cast("double"))


def format_time(seconds: Column, millis: bool = False) -> Column:
    """MM:SS, or H:MM:SS from an hour on; with millis the total is rounded to milliseconds first."""
    at = F.greatest(F.lit(0.0), seconds)
    total = F.bround(at * 1000).cast("long") if millis else F.floor(at) * 1000
    whole = F.floor(total / 1000).cast("long")
    h, m, s = F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60
    out = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))
    return F.concat(out, F.format_string(".%03d", total % 1000)) if millis else out


def format_duration(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit("s"))).otherwise(format_time(seconds))


def cue_seconds(h: Column, m: Column, s: Column, fraction: Column) -> Column:
    """The parts of a cue time; the fraction is padded on the right to milliseconds."""
    return h.cast("long") * 3600 + m.cast("long") * 60 + s.cast("long") + F.rpad(fraction, 3, "0").cast("long") / 1000.0


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def text_tokens(words: Column) -> Column:
    return (words * 1.35).cast("long")


def is_url(source: Column) -> Column:
    out = F.startswith(source, F.lit(URL_SCHEMES[0]))
    for scheme in URL_SCHEMES[1:]:
        out = out | F.startswith(source, F.lit(scheme))
    return out


def cache_key(source: Column, size: Column, mtime_ns: Column) -> Column:
    """Sixteen hex digits of a URL, or of a file's path, size and change time."""
    payload = F.when(is_url(source), F.concat(F.lit("url:"), F.trim(source))).otherwise(F.concat_ws(":", F.lit("file"), source, size.cast("string"), mtime_ns.cast("string")))
    return F.substr(F.sha2(payload, 256), F.lit(1), F.lit(16))


def run_id(**params: Column) -> Column:
    """Ten hex digits of the parameters, by name."""
    said = [F.concat(F.lit(f"{k}="), params[k].cast("string")) for k in sorted(params)]
    return F.substr(F.sha2(F.concat_ws("|", *said), 256), F.lit(1), F.lit(10))


def frame_name(t: Column, width: Column, labelled: bool) -> Column:
    return F.format_string(f"w%d_{'lbl' if labelled else 'raw'}_t%09d.jpg", width.cast("long"), F.bround(t * 1000).cast("long"))


def clip_stem(source: Column) -> Column:
    """The last part of a path without its last extension, 60 characters at most, "clip" where nothing is left."""
    last = F.regexp_extract(F.regexp_replace(F.coalesce(source, F.lit("")), "/+$", ""), "[^/]*$", 0)
    return F.coalesce(F.nullif(F.substr(F.regexp_replace(last, r"^(.+)\.[^.]+$", "$1"), F.lit(1), F.lit(60)), F.lit("")), F.lit("clip"))


def handoff_name(place: Column, t: Column) -> Column:
    """The file name of a brief's image: its place from 1 and its time."""
    return F.concat(F.format_string("%02d_", place.cast("long")), F.replace(format_time(t), F.lit(":"), F.lit("m")), F.lit("s.jpg"))


def prescale(setting: str | None, usual: int = 160) -> int:
    """The width at which scenes are compared, 0 for none, from a setting; what isn't a number means the usual one."""
    if setting is None:
        return usual
    said = setting.strip().lower()
    if said in ("", "0", "off", "false", "no"):
        return 0
    try:
        return max(0, int(said))
    except ValueError:
        return usual


def per_minute(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / (seconds / 60.0)).otherwise(F.lit(0.0))


def motion_profile(cuts_per_minute: Column) -> Column:
    return F.when(cuts_per_minute < 1, "static").when(cuts_per_minute < 4, "low motion").when(cuts_per_minute < 15, "edited").otherwise("high motion")


def window_start(start: Column, duration: Column) -> Column:
    """A wanted start held inside a known duration."""
    start = F.coalesce(start, F.lit(0.0))
    return F.when(F.coalesce(duration, F.lit(0.0)) > 0, F.greatest(F.lit(0.0), F.least(start, F.greatest(F.lit(0.0), duration - 0.1)))).otherwise(start)


def window_end(start: Column, end: Column, duration: Column) -> Column:
    """A wanted end; the duration, or a minute after the wanted start where it is unknown."""
    known = F.coalesce(duration, F.lit(0.0)) > 0
    wanted = F.coalesce(end, F.when(known, duration).otherwise(F.coalesce(start, F.lit(0.0)) + 60.0))
    return F.when(known, F.least(wanted, duration)).otherwise(wanted)


def needs_force(seconds: Column, limit: float = 600.0) -> Column:
    return seconds > limit


def height_for(width: Column, source_width: Column, source_height: Column) -> Column:
    """The height that keeps the source's shape, 16:9 where it is unknown."""
    w = F.coalesce(F.nullif(source_width, F.lit(0)), F.lit(16))
    h = F.coalesce(F.nullif(source_height, F.lit(0)), F.lit(9))
    return F.greatest(F.lit(2), F.bround(F.greatest(F.lit(2), width) * h / w).cast("int"))


def fit_edge(side: Column, width: Column, height: Column, edge: Column) -> Column:
    """A side after the longer one is scaled down to edge, made even; null edge leaves it."""
    longest = F.greatest(width, height)
    scaled = F.greatest(F.lit(2), (F.floor(F.floor(side * (edge / longest)) / 2) * 2).cast("int"))
    return F.when(edge.isNull() | (longest <= edge), side).otherwise(scaled)


def desired_interval(duration: Column, focused: bool) -> Column:
    wide = F.least(F.greatest(F.sqrt(duration) / 3.0, F.lit(0.5)), F.lit(4.0))
    return F.when(duration <= 0, F.lit(1.0)).otherwise(F.greatest(wide / 1.75, F.lit(0.25)) if focused else wide)


def coverage_floor(duration: Column, focused: bool) -> Column:
    """Straight lines between the knots, flat beyond them."""
    knots = FLOOR["focus" if focused else "wide"]
    out = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(duration <= x1, y0 + (duration - x0) / (x1 - x0) * (y1 - y0)).otherwise(out)
    return F.when(duration <= knots[0][0], F.lit(knots[0][1])).otherwise(out)


def sample_target(duration: Column, focused: bool, most: int = MAX_FRAMES) -> Column:
    """How many frames an automatic plan takes."""
    kind = "focus" if focused else "wide"
    wanted = F.greatest(F.lit(MIN_FRAMES[kind]), F.ceil(duration / desired_interval(duration, focused)), F.ceil(coverage_floor(duration, focused)))
    limit = F.greatest(F.lit(1), F.ceil(duration * RATE_LIMIT[kind]))
    return F.when(duration <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), wanted, limit))).cast("int")


def plan_target(duration: Column, focused: bool, fps: Column | None = None) -> Column:
    """An automatic target, or the stated rate times the duration, which nothing caps."""
    auto = sample_target(duration, focused)
    if fps is None:
        return auto
    stated = F.greatest(F.lit(1), F.bround(fps * F.greatest(F.lit(0.0), duration)).cast("int"))
    return F.when(F.coalesce(fps, F.lit(0.0)) != 0, stated).otherwise(auto)


def plan_label(focused: bool, fps: Column | None = None) -> Column:
    auto = F.lit("adaptive-focus" if focused else "adaptive-wide")
    if fps is None:
        return auto
    shown = F.regexp_replace(fps.cast("string"), r"\.0$", "")
    return F.when(F.coalesce(fps, F.lit(0.0)) != 0, F.concat(F.lit("explicit "), shown, F.lit("fps"))).otherwise(auto)


def grid_columns(n: Column, most: int = 5) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.sqrt(n) + 0.999).cast("int")))


def grid_rows(n: Column, most: int = 5) -> Column:
    return F.ceil(n / grid_columns(n, most)).cast("int")


def moment_count(duration: Column) -> Column:
    """How many moments a brief shows by default."""
    return F.greatest(F.lit(12), F.least(F.lit(120), F.bround(duration).cast("int")))


def evidence_start(t: Column) -> Column:
    return F.greatest(F.lit(0.0), t - 0.75)


def evidence_end(t: Column, duration: Column) -> Column:
    return F.least(duration, t + 0.75)


def coverage_interval(seconds: Column, kept: Column) -> Column:
    return seconds / F.greatest(F.lit(1), kept)


# The intents that have a guide of their own.
INTENTS = ("paid", "organic")


def guides(intent: Column) -> Column:
    """The analysis guides for a declared intent: the shared one, and that of the intent where there is one."""
    return F.array_compact(F.array(F.lit("shared"), F.when(intent.isin(*INTENTS), intent)))
