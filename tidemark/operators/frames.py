"""Ranking video frames for stills, and where to crop them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.clips import greedy

LEAST_HEIGHT, TEXT_PENALTY, LEAST_GAP = 0.08, 4.0, 60.0


def center_x(box: Column) -> Column:
    return box["x"] + box["w"] / 2


def best_face(faces: Column) -> Column:
    """The face of the best quality that is high enough, the first of equals; null if there is none."""
    fit = F.filter(faces, lambda f: f["box"]["h"] >= LEAST_HEIGHT)
    # fields in this order decide, so the position is negated
    ranked = F.transform(fit, lambda f, i: F.struct(f["quality"].alias("quality"), (-i).alias("i"), f["box"].alias("box")))
    return F.array_max(ranked)


def scored(frames: DataFrame) -> DataFrame:
    """``rec_id, t, box, score`` of frames ``(rec_id, t, faces, text)`` with a usable face: text on screen costs."""
    area = F.aggregate(F.coalesce("text", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")), F.lit(0.0), lambda s, b: s + b["w"] * b["h"])
    f = frames.withColumn("face", best_face(F.col("faces"))).where(F.col("face").isNotNull())
    return f.select("rec_id", "t", F.col("face.box").alias("box"), (F.col("face.quality") - TEXT_PENALTY * area).alias("score"))


def choose(frames: DataFrame, count: int) -> DataFrame:
    """``rec_id, place, t, box, score``: up to ``count`` best frames, at least a minute apart, the earlier of equals."""
    item = F.struct((-F.col("score")).alias("rank"), "t", "box", "score")
    by = scored(frames).groupBy("rec_id").agg(F.array_sort(F.collect_list(item)).alias("items"))  # one recording's sampled frames
    near = lambda x, y: F.abs(x["t"] - y["t"]) < LEAST_GAP
    return by.select("rec_id", F.posexplode(greedy(F.col("items"), count, near)).alias("place", "x")).select("rec_id", "place", "x.t", "x.box", "x.score")


def _even(v: Column) -> Column:
    n = F.floor(v)
    return n - n % 2


def frame_crop(box: Column, width: Column, height: Column) -> Column:
    """``x, y, w, h`` of a 16:9 crop about 5.5 faces high, the face at 68 % across and 18 % down, inside the frame.
    The width is a multiple of 32, the corner even."""
    tall = F.least(height, F.greatest(height / 2, box["h"] * height * 5.5))
    w = F.floor(F.floor(F.least(width, tall * 16 / 9)) / 32) * 32
    h = F.floor(w * 9 / 16)
    clamp = lambda v, most: _even(F.greatest(F.lit(0.0), F.least(most, v)))
    x = clamp(center_x(box) * width - 0.68 * w, width - w)
    y = clamp(box["y"] * height - 0.18 * h, height - h)
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))


def flipped(box: Column) -> Column:
    """A box with its origin at the bottom as one with the origin at the top, to four decimals."""
    r = lambda v: F.round(v, 4)
    return F.struct(r(box["x"]).alias("x"), r(1 - box["y"] - box["h"]).alias("y"), r(box["w"]).alias("w"), r(box["h"]).alias("h"))


def necks(bodies: Column, least: float = 0.3) -> Column:
    """The necks ``(x, y)`` that are seen well enough, of bodies with ``joints (name, x, y, confidence)``."""
    joints = F.transform(bodies, lambda b: F.get(F.filter(b["joints"], lambda j: j["name"] == "neck"), F.lit(0)))
    return F.transform(F.filter(joints, lambda j: F.coalesce(j["confidence"] > least, F.lit(False))), lambda j: F.struct(j["x"].alias("x"), j["y"].alias("y")))


def sampled(frames: DataFrame, rate: float) -> DataFrame:
    """Frames ``(rec_id, t, start, ...)`` thinned to ``rate`` a second from ``start`` on: the first frame at or after each due
    time, one frame for one due time. After a gap frames are taken until what was due has come.

    Of frames in order, as many are taken up to one as were due by then, but at most one for each frame: with a running
    minimum of what was due, no frame needs to know which ones before it were taken.
    """
    by = Window.partitionBy("rec_id").orderBy("t")
    seen = frames.where(F.col("t") + 1e-6 >= F.col("start")).withColumn("__i", F.row_number().over(by))
    due = F.floor((F.col("t") + 1e-6 - F.col("start")) * rate) + 1
    ahead = F.min(due - F.col("__i")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = seen.withColumn("__n", F.col("__i") + F.least(F.lit(0), ahead))
    return seen.withColumn("__before", F.coalesce(F.lag("__n").over(by), F.lit(0))).where("__n > __before").drop("__i", "__n", "__before")
