"""Order-dependent folds: anchored clusters, merged hits, frames against the last kept one, rolling captions.

Rows are dealt by asset, or by a finer key between whose values no state passes, sorted, and read once as
Arrow batches; the state is one anchor, one vector or one caption, whatever the length of a timeline.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLUSTER = 0.5
MERGE = 0.25
SPAN = 120
SLACK = 1e-9


def streamed(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """df sorted by keys and order in partitions that hold whole keys; start() makes the function that takes a task's
    batches in turn. df comes dealt by its keys, so that windows before this share that one shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for b in batches:
            yield step(b)

    return df.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _chained(points: DataFrame, window: float, time: str) -> DataFrame:
    """Adds _chain: rows of one asset between which no cluster passes.

    Times are summed up by spans of SPAN windows. A span that begins over window after the end of the one before
    must anchor anew, so chains end there, and even one asset of very many times is dealt over tasks. The order of
    spans, not of times, is what one task sees of an asset.
    """
    rows = points.withColumn("_span", F.floor(F.col(time) / (window * SPAN)))
    spans = rows.groupBy("asset_id", "_span").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    order = Window.partitionBy("asset_id").orderBy("_span")
    far = F.coalesce(F.col("_lo") - F.lag("_hi").over(order) > window, F.lit(True))
    spans = spans.withColumn("_far", far).select("asset_id", "_span", F.sum(F.col("_far").cast("int")).over(order).alias("_chain"))
    return rows.join(spans, ["asset_id", "_span"]).drop("_span")


def anchored(points: DataFrame, window: float, time: str = "t", ties: list[str] | None = None) -> DataFrame:
    """Adds anchor to each row: the first time of its cluster. A time opens a cluster if it is over window past the anchor."""

    def start():
        state: dict = {"key": None, "anchor": 0.0}

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            keys = list(zip(b.column("asset_id").to_pylist(), b.column("_chain").to_pylist(), strict=True))
            out = np.empty(b.num_rows)
            for i, t in enumerate(b.column(time).to_pylist()):
                if keys[i] != state["key"] or t - state["anchor"] > window:
                    state["key"], state["anchor"] = keys[i], t
                out[i] = state["anchor"]
            return b.append_column("anchor", pa.array(out))

        return step

    rows = _chained(points.filter(F.col(time).isNotNull()), window, time).repartition("asset_id", "_chain")
    schema = T.StructType([*rows.schema.fields, T.StructField("anchor", T.DoubleType())])
    return streamed(rows, ["asset_id", "_chain"], [time, *(ties or [])], start, schema).drop("_chain")


def cluster(points: DataFrame, window: float = CLUSTER) -> DataFrame:
    """asset_id, t: the times that open clusters."""
    return anchored(points.select("asset_id", "t"), window).select("asset_id", F.col("anchor").alias("t")).distinct()


def merge_hits(hits: DataFrame, window: float = MERGE) -> DataFrame:
    """Hits (asset_id, t, kind, severity, and evidence where there is any) that lie within window of a cluster's first one, as one.

    t is the least, kind the sorted distinct kinds joined by +, severity the highest, hits all of them in order
    with their evidence.
    """
    told = ["t", "kind", "severity", *[c for c in ("start_s", "end_s", "evidence") if c in hits.columns]]
    rank = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    rows = anchored(hits.select("asset_id", *told), window + SLACK, ties=["kind"])
    return rows.groupBy("asset_id", "anchor").agg(
        F.min("t").alias("t"),
        F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kind"),
        F.max_by("severity", rank).alias("severity"),
        F.sort_array(F.collect_list(F.struct(*told))).alias("hits"),
    ).drop("anchor")


def tile_deltas(a: np.ndarray, b: np.ndarray, side: int, tile: int) -> np.ndarray:
    """The mean absolute difference of each tile of two square pictures given as rows of pixels."""
    n = side // tile
    return np.abs(a.astype(np.float64) - b).reshape(n, tile, n, tile).mean(axis=(1, 3)).ravel()


def dedup_frames(frames: DataFrame, threshold: float, side: int, tile: int) -> DataFrame:
    """The frames kept: the first and last of each asset, protected ones, and those whose largest tile differs by
    over threshold from the last kept one. frames: asset_id, t, thumb, and optionally protected.

    An asset of at most two frames, or with a frame of another size, is kept whole. Adds delta, against the
    reference at that time (null for the first).
    """
    if "protected" not in frames.columns:
        frames = frames.withColumn("protected", F.lit(False))
    own = Window.partitionBy("asset_id")
    marked = frames.repartition("asset_id").withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_last", F.row_number().over(own.orderBy(F.desc("t"), F.desc(F.xxhash64("thumb")))) == 1).withColumn("_odd", F.max((F.coalesce(F.size("thumb"), F.lit(-1)) != side * side).cast("int")).over(own))

    def start():
        state: dict = {"asset": object(), "ref": None}

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            keep, delta = np.zeros(b.num_rows, dtype=bool), [None] * b.num_rows
            cols = (b.column(c).to_pylist() for c in ("asset_id", "protected", "_n", "_last", "_odd"))
            pixels, at = b.column("thumb").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(b.column("thumb")), 0).to_numpy())])
            for i, (asset, protected, n, last, odd) in enumerate(zip(*cols, strict=True)):
                if n <= 2 or odd:
                    keep[i] = True
                    continue
                thumb = pixels[at[i] : at[i + 1]].astype(np.float64)
                first = asset != state["asset"]
                if not first:
                    delta[i] = float(tile_deltas(thumb, state["ref"], side, tile).max())
                if first or protected or last or delta[i] > threshold:
                    keep[i], state["asset"], state["ref"] = True, asset, thumb
            return b.append_column("delta", pa.array(delta, pa.float64())).append_column("kept", pa.array(keep))

        return step

    schema = T.StructType([*marked.schema.fields, T.StructField("delta", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return streamed(marked, ["asset_id"], ["t"], start, schema).drop("_n", "_last", "_odd")


def collapse_captions(cues: DataFrame) -> DataFrame:
    """Rolling captions (asset_id, seq, start_s, end_s, text) as segments.

    A cue that repeats the last segment's text extends it; one that begins with it (over 8 characters) replaces
    the text; one that it ends with (over 8 characters) extends it; any other opens a segment. The end is the
    cue's end, also where that is earlier.
    """
    order = Window.partitionBy("asset_id").orderBy("seq")

    def start():
        state: dict = {"asset": object(), "text": "", "part": 0}

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            part, said = [], []
            for asset, text in zip(b.column("asset_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                old = state["text"]
                if asset != state["asset"]:
                    state.update(asset=asset, text=text, part=1)
                elif text == old or old.endswith(text) and len(text) > 8 and not (text.startswith(old) and len(old) > 8):
                    pass
                elif text.startswith(old) and len(old) > 8:
                    state["text"] = text
                else:
                    state["text"], state["part"] = text, state["part"] + 1
                part.append(state["part"])
                said.append(state["text"])
            return b.append_column("part", pa.array(part, pa.int64())).append_column("said", pa.array(said, pa.string()))

        return step

    rows = cues.filter("text IS NOT NULL").select("asset_id", "seq", "start_s", "end_s", "text").repartition("asset_id")
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.LongType()), T.StructField("said", T.StringType())])
    out = streamed(rows, ["asset_id"], ["seq"], start, schema)
    segments = out.groupBy("asset_id", "part").agg(F.min("seq").alias("seq"), F.min_by("start_s", "seq").alias("start_s"), F.max_by("end_s", "seq").alias("end_s"), F.max_by("said", "seq").alias("text"))
    return segments.withColumn("seq", F.row_number().over(order).cast("long")).drop("part")
