"""Detections and tracks: best frames, suppression, matching from frame to frame, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BOX_COLUMNS


def stride(df: DataFrame, fps: float | str, interval_ms: float, frame: str = "frame_idx", max_ms: float | None = None, max_frames: int | None = None, least_sharpness: float = 0.0) -> DataFrame:
    """Every n-th frame with its time in ms; limits on time and on the count of frames kept; blurred ones go. [S1, T6]"""
    rate = F.col(fps) if isinstance(fps, str) else F.lit(float(fps or 25.0))
    rate = F.when(rate > 0, rate).otherwise(25.0)
    n = F.greatest(F.lit(1), F.floor(rate * interval_ms / 1000).cast("long"))
    out = df.withColumns({"_n": n, "ts_ms": F.col(frame) / rate * 1000}).where(F.col(frame) % F.col("_n") == 0)
    if max_ms is not None:
        out = out.where(F.col("ts_ms") <= max_ms)
    if least_sharpness > 0:
        out = out.where(F.col("sharpness") >= least_sharpness)
    if max_frames is not None:
        out = out.withColumn("_i", F.row_number().over(Window.partitionBy("video").orderBy(frame))).where(F.col("_i") <= max_frames).drop("_i")
    return out.drop("_n")


def changed(df: DataFrame, video: str = "video", order: str = "ts_ms", signature: str = "signature", least: float = 0.35) -> DataFrame:
    """Frames that differ enough from the one sampled before, kept or not; the first stays. [S1, W6]"""
    before = F.lag(signature).over(Window.partitionBy(video).orderBy(order))
    return df.withColumn("_d", F.abs(F.col(signature) - before)).where(F.col("_d").isNull() | (F.col("_d") >= least)).drop("_d")


def top_candidates(df: DataFrame, keys: list[str], k: int, score: str = "score", order: str = "ts_ms") -> DataFrame:
    """The k best candidates of each track, the earlier of equals; the limit is pushed before the shuffle. [W1]"""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(order)))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def best_frames(df: DataFrame, keys: list[str], score: str = "score", code_score: str = "qr_score", order: str = "ts_ms", least_seen: int = 1) -> DataFrame:
    """n_seen, best frame and best code frame of each track (the earliest of equals), seen often enough. [W2, W3, W4, T2, T4]"""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n_seen"), F.max(score).alias("best_score"), F.max_by(order, F.struct(score, -F.col(order))).alias("best_ts"), F.max(code_score).alias("best_code_score"), F.max_by(order, F.struct(code_score, -F.col(order))).alias("best_code_ts"))
        .where(F.col("n_seen") >= least_seen)
    )


def cap_tracks(df: DataFrame, n: int | None, score: str = "best_score", *ties: str) -> DataFrame:
    """The n tracks with the best scores; no cap for none or under 1. [P21]"""
    return df if not n or n < 1 else df.orderBy(F.desc(score), *ties).limit(n)


def sessions(df: DataFrame, keys: list[str], gap_ms: float, order: str = "ts_ms") -> DataFrame:
    """Tracks that end when nothing was seen for longer than the gap: session number, from, to, count. [T3]"""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap_ms).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "session").agg(F.min(order).alias("first_ts"), F.max(order).alias("last_ts"), F.count("*").alias("n_seen"))


_NMS = """
aggregate(
  array_sort(collect_list(named_struct('c', -confidence, 'id', det_id, 'b', array(x_min, y_min, x_max, y_max)))),
  cast(array() as array<struct<id: bigint, b: array<double>>>),
  (kept, d) -> if(
    cast(d.b[2] as int) <= cast(d.b[0] as int) or cast(d.b[3] as int) <= cast(d.b[1] as int) or exists(kept, k ->
      greatest(0.0D, least(k.b[2], d.b[2]) - greatest(k.b[0], d.b[0])) * greatest(0.0D, least(k.b[3], d.b[3]) - greatest(k.b[1], d.b[1]))
      > {limit}D * (
        (cast(k.b[2] as int) - cast(k.b[0] as int)) * (cast(k.b[3] as int) - cast(k.b[1] as int)) + (cast(d.b[2] as int) - cast(d.b[0] as int)) * (cast(d.b[3] as int) - cast(d.b[1] as int))
        - greatest(0.0D, least(k.b[2], d.b[2]) - greatest(k.b[0], d.b[0])) * greatest(0.0D, least(k.b[3], d.b[3]) - greatest(k.b[1], d.b[1])))),
    kept, concat(kept, array(named_struct('id', d.id, 'b', d.b)))))
"""


def suppress(df: DataFrame, keys: list[str], limit: float = 0.35) -> DataFrame:
    """det_id of the detections of each frame that stay: in order of confidence, those over the overlap limit with a kept one go. [J14]

    A fold in the JVM over one frame's detections (det_id bigint breaks ties).
    """
    return df.groupBy(*keys).agg(F.expr(_NMS.format(limit=limit)).alias("kept")).select(*keys, F.explode("kept").alias("k")).select(*keys, F.col("k.id").alias("det_id"))


def hybrid(a: DataFrame, b: DataFrame, keys: list[str], limit: float = 0.40) -> DataFrame:
    """Detections of two detectors together, suppressed. [U2]"""
    both = a.unionByName(b)
    return both.join(suppress(both, keys, limit), [*keys, "det_id"], "left_semi")


def match_frames(frames: list[list[tuple]], least: float = 0.25, lost: int = 0, next_id: int = 0) -> list[list[int]]:
    """Track ids of boxes (x_min, y_min, x_max, y_max) frame by frame: each takes the best free track of the frames before, else a new id. [J12]

    lost: for how many frames without a match a track is remembered (0: the frame before only; more: J13, T3).
    """

    import numpy as np

    size = lambda b: np.maximum(0.0, b[2] - b[0]) * np.maximum(0.0, b[3] - b[1])
    known: dict = {}
    out = []
    for number, boxes in enumerate(frames):
        # the tracks that may go on, from left to right; their place among the known decides between equals
        old = [(t, b) for t, (b, seen) in known.items() if number - seen <= lost + 1]
        sides = np.array([b for _, b in old], dtype=float).reshape(-1, 4).T
        by_left = np.argsort(sides[0], kind="stable")
        sides, free = sides[:, by_left], np.ones(len(old), bool)
        areas, widest = size(sides), float((sides[2] - sides[0]).max()) if old else 0.0
        ids = []
        for box in boxes:
            # what doesn't overlap has 0, which a limit over 0 leaves out
            lo, hi = (np.searchsorted(sides[0], box[0] - widest, "left"), np.searchsorted(sides[0], box[2], "right")) if least > 0 else (0, len(old))
            best = None
            if hi > lo and free[lo:hi].any():
                s = sides[:, lo:hi]
                both = np.maximum(0.0, np.minimum(s[2], box[2]) - np.maximum(s[0], box[0])) * np.maximum(0.0, np.minimum(s[3], box[3]) - np.maximum(s[1], box[1]))
                union = areas[lo:hi] + max(0.0, box[2] - box[0]) * max(0.0, box[3] - box[1]) - both
                share = np.where(free[lo:hi], np.divide(both, union, out=np.zeros_like(both), where=union > 0), -1.0)
                if (top := share.max()) >= least:
                    ties = np.nonzero(share == top)[0] + lo
                    best = int(ties[np.argmin(by_left[ties])])
            if best is None:
                ids.append(next_id)
                next_id += 1
            else:
                free[best] = False
                ids.append(old[by_left[best]][0])
        known = {t: v for t, v in known.items() if number - v[1] <= lost} | {t: (b, number) for t, b in zip(ids, boxes, strict=True)}
        out.append(ids)
    return out


def track(df: DataFrame, video: str = "video", order: str = "ts_ms", det: str = "det_id", least: float = 0.25, lost: int = 0) -> DataFrame:
    """video, det_id, track_id: matching from frame to frame within each video (one video's boxes at a time). [J12, J13]"""
    schema = f"{video} {df.schema[video].dataType.simpleString()}, {det} bigint, track_id bigint"

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values([order, det])
        groups = [g for _, g in pdf.groupby(order, sort=True)]
        ids = match_frames([list(g[BOX_COLUMNS].itertuples(index=False, name=None)) for g in groups], least, lost)
        return pd.DataFrame({video: pdf[video], det: pdf[det], "track_id": [i for f in ids for i in f]})

    return df.select(video, order, det, *BOX_COLUMNS).groupBy(video).applyInPandas(run, schema)


def tiles(width: int, height: int, size: int = 640, step: int = 512) -> list[tuple[int, int]]:
    """Corners of the tiles of a frame: a grid by step, the last ones flush with the edges. [J16]"""
    line = lambda n: sorted({*range(0, max(0, n - size) + 1, step), max(0, n - size)})
    return [(x, y) for y in line(height) for x in line(width)]


def tile_grid(df: DataFrame, width: str = "width", height: str = "height", size: int = 640, step: int = 512) -> DataFrame:
    """df with tile_x, tile_y: one row for each tile of the row's frame. [J16]"""
    line = lambda n: F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(n) - size), F.lit(step)), F.array(F.greatest(F.lit(0), F.col(n) - size))))
    return df.withColumn("tile_x", F.explode(line(width))).withColumn("tile_y", F.explode(line(height)))


def _up_to(values, top):
    return F.filter(values, lambda v: v <= top)


def tile_boxes(df: DataFrame, size: int = 640, step: int = 512, least: float = 0.5) -> DataFrame:
    """Boxes by tile: cx, cy, w, h as shares of the tile, where at least half of the box is inside. [J15]

    A box can meet the tiles from its left edge less the size to its right edge only: those are made, not all.
    """
    out = df
    for c, lo, hi, n in (("tile_x", "x_min", "x_max", "width"), ("tile_y", "y_min", "y_max", "height")):
        first = F.greatest(F.lit(0), F.ceil((F.col(lo) - size) / step).cast("int"))
        last = F.floor(F.col(hi) / step).cast("int")
        top = F.greatest(F.lit(0), F.col(n) - size).cast("int")
        near = F.when(last >= first, F.transform(F.sequence(first, last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
        out = out.withColumn(c, F.explode(F.array_distinct(F.concat(_up_to(near, top), F.array(top)))))
    x0, x1 = F.greatest(F.col("x_min"), F.col("tile_x").cast("double")), F.least(F.col("x_max"), F.col("tile_x") + F.lit(float(size)))
    y0, y1 = F.greatest(F.col("y_min"), F.col("tile_y").cast("double")), F.least(F.col("y_max"), F.col("tile_y") + F.lit(float(size)))
    own = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))
    inside = (x1 > x0) & (y1 > y0) & (own > 0) & ((x1 - x0) * (y1 - y0) / own >= least)
    return out.where(inside).withColumns({"cx": ((x0 + x1) / 2 - F.col("tile_x")) / size, "cy": ((y0 + y1) / 2 - F.col("tile_y")) / size, "w": (x1 - x0) / size, "h": (y1 - y0) / size})


def nearest_frames(tags: DataFrame, frames: DataFrame, offsets: list[int], clamp: bool = False, key: str = "tag_id", bucket_ms: int = 1000) -> DataFrame:
    """key, offset, frame_ts: for each tag time plus offset the nearest frame of its video (the earlier of equals). [J18]

    Times under 0 go, or count as 0. Frames within a bucket are found by an equi join with the bucket and both
    beside it; a time with no frame there is left without one.
    """
    asked = tags.select(key, "video", F.col("ts_ms").alias("t0"), F.explode(F.array(*map(F.lit, offsets))).alias("offset")).withColumn("t", F.col("t0") + F.col("offset"))
    asked = asked.withColumn("t", F.greatest(F.col("t"), F.lit(0.0))) if clamp else asked.where("t >= 0")
    asked = asked.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("t") / bucket_ms) + d)))
    own = frames.select("video", F.col("ts_ms").alias("frame_ts"), F.floor(F.col("ts_ms") / bucket_ms).alias("_b"))
    near = asked.join(own, ["video", "_b"]).withColumn("d", F.abs(F.col("frame_ts") - F.col("t"))).where(F.col("d") <= bucket_ms)
    return near.groupBy(key, "offset").agg(F.min_by("frame_ts", F.struct("d", "frame_ts")).alias("frame_ts"))


def code_fallback(voted: DataFrame, best_code: DataFrame, candidates: DataFrame, keys: list[str], within_ms: float = 50.0) -> DataFrame:
    """Voted rows without a code, with the time of the track's best code frame unless a candidate was tried within 50 ms of it. [J19]"""
    from ..functions.presence import empty_plain

    open_ = voted.where(empty_plain("qr_code_barcode")).select(*keys)
    asked = open_.join(best_code.select(*keys, "best_code_ts"), keys)
    tried = asked.join(candidates.select(*keys, "ts_ms"), keys).where(F.abs(F.col("ts_ms") - F.col("best_code_ts")) < within_ms).select(*keys)
    return asked.join(tried, keys, "left_anti")
