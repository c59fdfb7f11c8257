"""What media tools are to be called with: arrays of arguments, one for each clip, talk, episode or still. Nothing is run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import timecode as tc

#: The canvas of a clip, the place of its window, fades of a talk's video, and what every call begins with.
CANVAS, WINDOW_TOP = (1080, 1920), 285
FADE_IN, FADE_OUT = 0.5, 1.0
QUIET = ("ffmpeg", "-hide_banner", "-nostdin", "-loglevel", "error", "-y")


def arguments(*parts: str | int | Column) -> Column:
    return F.array(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def filter_value(text: Column) -> Column:
    """Text as the value of an option in a filter graph: escaped as a value, then as a part of the graph."""
    value = F.regexp_replace(text, r"([\\':])", r"\\$1")
    return F.regexp_replace(value, r"([\\'\[\],;])", r"\\$1")


def number(c: Column, digits: int = 0) -> Column:
    return F.round(c).cast("long").cast("string") if not digits else F.format_string(f"%.{digits}f", c.cast("double"))


def span_of(source: Column, start: Column, seconds: Column) -> Column:
    return arguments("-ss", tc.argument(start), "-t", tc.argument(seconds), "-i", source)


def clip_graph(frame_height: Column, left: Column, captions: Column, path: Column, fonts: Column) -> Column:
    """The filters of a clip: a blurred background; in front the window that follows ``left``, in pixels of the source, or the
    whole frame where that is null; and captions on top. The frame is enlarged before it is cropped, so that the window
    moves by pixels of the output."""
    w, h = CANVAS
    background = f"[0:v]scale={w}:{h}:force_original_aspect_ratio=increase,crop={w}:{h},gblur=sigma=40,eq=brightness=-0.2[bg]"
    zoom = F.lit(float(w)) / (frame_height * 4 / 5)
    high = number(frame_height * zoom)
    window = F.concat(F.lit("[0:v]scale=-2:"), high, F.lit(":flags=lanczos,sendcmd=f="), filter_value(path), F.lit(f",crop@cam=w={w}:h="), high, F.lit(":x="), number(left * zoom), F.lit(":y=0:exact=1[fg]"))
    front = F.coalesce(window, F.lit(f"[0:v]scale={w}:-2:flags=lanczos[fg]"))
    return F.concat(F.lit(background), F.lit(";"), front, F.lit(f";[bg][fg]overlay=(W-w)/2:{WINDOW_TOP},ass="), filter_value(captions), F.lit(":fontsdir="), filter_value(fonts), F.lit("[v]"))


def clip_command(source: Column, audio: Column, start: Column, seconds: Column, graph: Column, preset: str, crf: int, dest: Column) -> Column:
    return F.concat(
        arguments(*QUIET),
        span_of(source, start, seconds),
        arguments("-i", audio, "-filter_complex", graph, "-map", "[v]", "-map", "1:a:0", "-c:v", "libx264", "-preset", preset, "-crf", crf, "-pix_fmt", "yuv420p"),
        arguments("-c:a", "aac", "-b:a", "192k", "-movflags", "+faststart", "-shortest", dest),
    )


def talk_command(source: Column, audio: Column, start: Column, seconds: Column, rate: Column, preset: str, crf: int, dest: Column) -> Column:
    """A whole talk: short fades, and a key frame every two seconds."""
    fades = F.concat(F.lit(f"fade=t=in:st=0:d={FADE_IN:g},fade=t=out:st="), number(seconds - FADE_OUT, 3), F.lit(f":d={FADE_OUT:g}"))
    return F.concat(
        arguments(*QUIET),
        span_of(source, start, seconds),
        arguments("-i", audio, "-map", "0:v:0", "-map", "1:a:0", "-vf", fades, "-c:v", "libx264", "-preset", preset, "-crf", crf, "-profile:v", "high", "-pix_fmt", "yuv420p"),
        arguments("-g", number(rate * 2), "-bf", 2, "-c:a", "aac", "-b:a", "320k", "-movflags", "+faststart", "-shortest", dest),
    )


def episode_command(audio: Column, chapters: Column, bitrate: str, tags: dict[str, Column], dest: Column) -> Column:
    """A podcast's episode with its tags, in their order; ``chapters`` is a chapter file."""
    own = [p for name, value in tags.items() for p in ("-metadata", F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit(""))))]
    return F.concat(
        arguments(*QUIET, "-i", audio, "-f", "ffmetadata", "-i", chapters, "-map", "0:a", "-map_chapters", 1, "-c:a", "libmp3lame", "-b:a", bitrate, "-id3v2_version", 3),
        arguments(*own, dest),
    )


def still_commands(source: Column, t: Column, crop: Column, title: Column, passage: Column, font: str, dest: Column) -> Column:
    """Two calls, an array each: the frame cut and enlarged, then title and passage set on its darkened left side."""
    still = F.concat(F.regexp_replace(dest, r"\.jpg$", ""), F.lit("-frame.png"))
    cut = F.concat(F.lit("crop="), F.concat_ws(":", *[crop[c].cast("string") for c in "whxy"]), F.lit(",scale=1280:720:flags=lanczos,unsharp=5:5:0.5"))
    frame = arguments(*QUIET, "-ss", tc.argument(t), "-i", source, "-frames:v", 1, "-vf", cut, still)
    shade = ("(", "-size", "1100x720", "-define", "gradient:direction=east", "gradient:rgba(0,0,0,0.92)-rgba(0,0,0,0)", "-background", "none", "-extent", "1280x720", ")", "-compose", "over", "-composite")
    words = ("(", "-size", "560x420", "-background", "none", "-fill", "white", "-stroke", "rgba(0,0,0,0.55)", "-strokewidth", 2, "-font", font, "-gravity", "southwest", F.concat(F.lit("caption:"), tx.caption_argument(tx.capitals(title))), ")", "-gravity", "northwest", "-geometry", "+60+150", "-composite")
    below = ("-font", font, "-fill", "#FFD700", "-pointsize", 44, "-annotate", "+64+620", tx.caption_argument(passage), "-quality", 92, dest)
    return F.array(frame, arguments("magick", still, *shade, *words, *below))
