"""A steady crop window that follows a person: tracked positions to the window's left edge for each output frame."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timecode import FRAMES_PER_SECOND

LEAST_COVERAGE = 0.7


@dataclass(frozen=True)
class Camera:
    frame_width: float
    window_width: float
    steadiness: float = 0.025
    smoothing: float = 0.25


def window_width(height: Column) -> Column:
    return height * 4 / 5


def candidates(necks: Column, faces: Column, bodies: Column) -> Column:
    """Everyone's horizontal place in a frame: necks, else the centres of faces, else of bodies."""
    centres = lambda boxes: F.transform(boxes, lambda b: b["x"] + b["w"] / 2)
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return F.when(some(necks), F.transform(necks, lambda p: p["x"])).when(some(faces), centres(faces)).otherwise(centres(bodies))


def anchored(frames: DataFrame) -> DataFrame:
    """``rec_id, t, x`` of frames ``(rec_id, t, xs)``: the place nearest to where the person was before.

    The search starts from the upper median of all places. Frames without anyone are left out. A fold over one
    clip's frames, which a few minutes of video bound.
    """
    everyone = frames.select("rec_id", F.explode("xs").alias("x")).groupBy("rec_id").agg(F.array_sort(F.collect_list("x")).alias("a"))
    start = everyone.select("rec_id", F.element_at("a", (F.floor(F.size("a") / 2) + 1).cast("int")).alias("start"))
    track = frames.where(F.size("xs") > 0).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("t", "xs"))).alias("fs")).join(start, "rec_id")
    zero = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<t:double,x:double>>").alias("of"))
    nearest = lambda s, f: F.array_min(F.transform(f["xs"], lambda x, i: F.struct(F.abs(x - s["at"]).alias("d"), i.alias("i"), x.alias("x"))))["x"]
    step = lambda s, f: F.struct(nearest(s, f).alias("at"), F.concat(s["of"], F.array(F.struct(f["t"].alias("t"), nearest(s, f).alias("x")))).alias("of"))
    return track.select("rec_id", F.explode(F.aggregate("fs", zero, step)["of"]).alias("p")).select("rec_id", "p.t", "p.x")


def median_filtered(track: DataFrame, width: int = 5) -> DataFrame:
    """The upper median of each place's neighbourhood, which shrinks at the ends."""
    w = Window.partitionBy("rec_id").orderBy("t").rowsBetween(-(width // 2), width // 2)
    near = F.array_sort(F.collect_list("x").over(w))
    return track.withColumn("near", near).withColumn("x", F.element_at("near", (F.floor(F.size("near") / 2) + 1).cast("int"))).drop("near")


def solve_tridiagonal(diag: np.ndarray, off: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Symmetric systems, one in each row: main diagonals, off diagonals, right sides."""
    d, x = diag.T.copy(), y.T.copy()
    o = np.ascontiguousarray(off.T)
    n = len(d)
    for i in range(1, n):
        m = o[i - 1] / d[i - 1]
        d[i] -= m * o[i - 1]
        x[i] -= m * x[i - 1]
    x[-1] /= d[-1]
    for i in range(n - 2, -1, -1):
        x[i] = (x[i] - o[i] * x[i + 1]) / d[i]
    return x.T


def inside(sizes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places of each row are its own."""
    return np.arange(n) < sizes[:, None]


def flattened(xs: np.ndarray, strength: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Total-variation denoising of each row by reweighted least squares: sways go, moves stay. ``sizes``: how many places of
    a row count; the others are tied to nothing."""
    c = xs.astype(float)
    if xs.shape[1] < 2:
        return c
    ties = inside(sizes - 1, xs.shape[1] - 1)
    open_ = np.flatnonzero(strength > 0)
    for _ in range(300):
        if not len(open_):
            break
        w = strength[open_, None] / np.maximum(0.01, np.abs(np.diff(c[open_], axis=1))) * ties[open_]
        diag = np.ones((len(open_), xs.shape[1]))
        diag[:, :-1] += w
        diag[:, 1:] += w
        new = solve_tridiagonal(diag, -w, xs[open_])
        moved = np.max(np.abs(new - c[open_]), axis=1)
        c[open_] = new
        open_ = open_[moved >= 0.01]
    return c


def smoothed(xs: np.ndarray, sigma: float, sizes: np.ndarray) -> np.ndarray:
    """A Gaussian over each row's own places, looking both ways, renormalized at the ends."""
    if sigma <= 0:
        return xs.copy()
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = xs.shape[1]
    own = inside(sizes, n).astype(float)
    wide = np.pad(np.stack([xs * own, own]), ((0, 0), (0, 0), (reach, reach)))
    total = sum(k * wide[:, :, i : i + n] for i, k in enumerate(kernel))
    return total[0] / np.where(own > 0, total[1], 1.0)


def resampled(times: np.ndarray, xs: np.ndarray, n: int) -> np.ndarray:
    """Linear between detections, held at the ends, at each of ``n`` output frames."""
    return np.interp(np.arange(n) / FRAMES_PER_SECOND, times, xs)


def left_edges(tracks: list[tuple[np.ndarray, np.ndarray]], sizes: list[int], camera: Camera, frame_widths: list[float], window_widths: list[float]) -> list[np.ndarray]:
    """The edges for each track (times, places), as many as its output frames; all are solved together."""
    n, size = max(sizes), np.array(sizes)
    frame, window = (np.array(w, dtype=float)[:, None] for w in (frame_widths, window_widths))
    places = np.stack([resampled(t, x, n) for t, x in tracks])
    subject = np.clip(places * frame, window / 2, frame - window / 2)
    strength = camera.steadiness * window[:, 0] * FRAMES_PER_SECOND / 2
    centres = smoothed(flattened(subject, strength, size), camera.smoothing * FRAMES_PER_SECOND, size)
    edges = np.clip(centres - window / 2, 0, frame - window)
    return [e[:k] for e, k in zip(edges, sizes, strict=True)]


#: Clips solved together: so many, and of lengths up to this ratio.
CLIPS_AT_ONCE, ALIKE = 256, 1.5


def path(frames: DataFrame, clips: DataFrame, camera: Camera) -> DataFrame:
    """``rec_id, frame, left`` for clips ``(rec_id, clip_start, frames)``; no rows where under 70 % of the frames show anyone.
    Clips of other sizes than the camera's have them in ``frame_width, window_width``.

    The solver goes along a clip frame by frame, for many clips of similar lengths at once. Tracks stream in by clip, and a
    task holds ``CLIPS_AT_ONCE`` of them.
    """
    seen = frames.groupBy("rec_id").agg(F.count(F.lit(1)).alias("total"), F.sum((F.size("xs") > 0).cast("int")).alias("hits"))
    usable = seen.where((F.col("hits") > 0) & (F.col("hits") >= LEAST_COVERAGE * F.col("total"))).select("rec_id")
    track = median_filtered(anchored(frames.join(usable, "rec_id", "left_semi"))).join(clips, "rec_id")
    sizes = [F.col(c).cast("double") if c in clips.columns else F.lit(float(getattr(camera, c))).alias(c) for c in ("frame_width", "window_width")]
    track = track.select("rec_id", (F.col("t") - F.col("clip_start")).alias("t"), "x", "frames", *sizes)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = sorted(held, key=lambda g: int(g.frames.iloc[0]))
            while held:
                most = ALIKE * int(held[0].frames.iloc[0])
                same = [g for g in held if int(g.frames.iloc[0]) <= most]
                held = held[len(same) :]
                of = lambda c: [g[c].iloc[0] for g in same]  # noqa: B023, E731 - used at once
                edges = left_edges([(g.t.to_numpy(), g.x.to_numpy()) for g in same], of("frames"), camera, of("frame_width"), of("window_width"))
                sizes = [len(e) for e in edges]
                yield pd.DataFrame({"rec_id": np.repeat(of("rec_id"), sizes), "frame": np.concatenate([np.arange(k) for k in sizes]), "left": np.concatenate(edges)})

        rest, held = None, []
        for b in batches:
            whole = b if rest is None else pd.concat([rest, b])
            groups = [g for _, g in whole.groupby("rec_id", sort=False)]
            if not groups:
                continue
            rest = groups.pop()  # its rows may go on in the next batch
            held += groups
            if len(held) >= CLIPS_AT_ONCE:
                yield from solved(held)
                held = []
        if rest is not None:
            held.append(rest)
        if held:
            yield from solved(held)

    by_clip = track.repartition("rec_id").sortWithinPartitions("rec_id", "t")
    return by_clip.mapInPandas(solve, "rec_id bigint, frame bigint, left double")


def crop_commands(path_: DataFrame, zoom: float = 1.0) -> DataFrame:
    """``rec_id, frame, line``: a command for each frame at which the rounded pixel changes."""
    w = Window.partitionBy("rec_id").orderBy("frame")
    p = path_.withColumn("px", F.round(F.col("left") * zoom).cast("long"))
    p = p.withColumn("was", F.lag("px").over(w)).where(F.col("was").isNull() | (F.col("was") != F.col("px")))
    return p.select("rec_id", "frame", F.concat(F.format_string("%.4f", F.col("frame") / FRAMES_PER_SECOND), F.lit(" crop@cam x "), F.col("px").cast("string"), F.lit(";\n")).alias("line"))
