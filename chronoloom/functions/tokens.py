"""Image token prices of model families as Column expressions over width and height."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The longest edge each family takes; null is none.
EDGES = {"anthropic": 1568, "anthropic:hires": 2576, "openai:4o": 1536, "openai:5": 1536, "openai:5-high": 2048, "gemini": 1536, "qwen": None, "qwen:video": None}
# Other names of the families.
ALIASES = {"claude": "anthropic", "openai": "openai:4o", "gpt": "openai:4o", "openai:4.1": "openai:4o", "google": "gemini", "qwen3-vl": "qwen"}


# The families that are compared.
COMPARED = ("anthropic", "openai:4o", "openai:5", "gemini", "qwen", "qwen:video")


def patches(width: Column, height: Column, side: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(width / side)) * F.greatest(F.lit(1), F.ceil(height / side))


def tiled(width: Column, height: Column) -> Column:
    """85 and 170 for each 512 tile, after a 2048 box and a short side of 768."""
    w, h = width.cast("double"), height.cast("double")
    box = F.when(F.greatest(w, h) > 2048, 2048 / F.greatest(w, h)).otherwise(F.lit(1.0))
    w, h = w * box, h * box
    short = F.when(F.least(w, h) > 768, 768 / F.least(w, h)).otherwise(F.lit(1.0))
    return 85 + 170 * patches(F.bround(w * short), F.bround(h * short), 512)


def _aligned(side: Column) -> Column:
    return F.greatest(F.lit(32), F.floor(side / 32 + 0.5) * 32)


def tokens(width: Column, height: Column, family: str) -> Column:
    """The price of one image; "generic" is the highest of all families."""
    if family == "generic":
        return F.greatest(*[tokens(width, height, f) for f in EDGES])
    if family.startswith("anthropic"):
        out = patches(width, height, 28)
    elif family == "openai:4o":
        out = tiled(width, height)
    elif family == "openai:5":
        out = patches(width, height, 32)
    elif family == "openai:5-high":
        out = F.least(F.lit(2500), patches(width, height, 32))
    elif family == "gemini":
        out = F.when((width <= 384) & (height <= 384), F.lit(258)).otherwise(258 * patches(width, height, 768))
    elif family in ("qwen", "qwen:video"):
        out = (_aligned(width) / 32) * (_aligned(height) / 32)
        out = F.greatest(F.lit(1), F.ceil(out / 2)) if family == "qwen:video" else out
    else:
        raise ValueError(f"no such family: {family}")
    return out.cast("long")


def edge(family: str) -> int | None:
    """A family's longest edge; the generic one takes what all take."""
    if family == "generic":
        return min(e for e in EDGES.values() if e is not None)
    return EDGES[family]


def frames_for_budget(budget: Column, price: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(budget / F.greatest(F.lit(1), price))).cast("long")


def compare(sizes: DataFrame, families: tuple[str, ...] = COMPARED) -> DataFrame:
    """A row for each row of sizes (width, height) and family."""
    each = F.array(*[F.struct(F.lit(f).alias("family"), tokens(F.col("width"), F.col("height"), f).alias("tokens")) for f in families])
    return sizes.withColumn("_p", each).select(*sizes.columns, F.explode("_p").alias("_p")).select(*sizes.columns, "_p.family", "_p.tokens")


def resolve(requests: DataFrame, default: str | None = None) -> DataFrame:
    """Adds family: the request's own name, the default, or generic, after other names are replaced. Unknown names raise."""
    name = F.lower(F.trim(F.coalesce(F.nullif("request", F.lit("")), F.lit(default), F.lit("generic"))))
    known = reduce(lambda out, pair: F.when(name == pair[0], F.lit(pair[1])).otherwise(out), ALIASES.items(), F.when(name.isin("generic", *EDGES), name))
    return requests.withColumn("family", F.coalesce(known, F.raise_error(F.concat(F.lit("no such family: "), name))))
