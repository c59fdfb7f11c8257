"""The stages from recordings to reviewed texts, clips and stills, for many recordings at once.

What tools and models give (recognizer output, speaker lines, silences, loudness reports, tracked poses and faces,
replies) comes in as tables; every stage reads the tables of those before it and writes its own. A recording that one
stage can't handle has an error in that stage's table and is left out of the next ones; it stops no other recording.
Tools are not run: what to ask of them is a table too (``media``).
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable
from dataclasses import astuple, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import prompts, text as tx, timecode as tc
from tidemark.functions.ask import Asker
from tidemark.operators import boundaries, camera, clips, commands, corrections, frames, publish, transcription, turns as tn, words as wd
from tidemark.plans import dag, increment, review
from tidemark.sources import files, logs, sinks, tables

#: Files that a run leaves, by what they are.
CAPTIONS, TRANSCRIPT = "YouTube/captions.srt", "transcript.txt"
DESCRIPTION, TITLES, TAGS = "YouTube/description.txt", "YouTube/titles.txt", "YouTube/tags.txt"
VIDEO, PODCAST, PODCAST_TEXT, PODCAST_CHAPTERS = "YouTube/video.mp4", "Podcast/episode.mp3", "Podcast/description.txt", "Podcast/chapters.txt"
POSTS, REVIEW = "Clips/captions.txt", "review.html"
#: The folder that tools work in, and what of a recording's exported folder is the run's own.
WORK, MANAGED = "work", (REVIEW, TRANSCRIPT, "YouTube", "Podcast", "Clips")
MASTERS = {"video": (2, 48000, 0.0, 0.0), "podcast": (1, 44100, 0.0, 0.0)}
CLIP_FADES = (0.15, 0.3)


@dataclass
class Job:
    """A run's folder, settings and sources.

    ``sources``: ``recordings (rec_id, file, date, report, start_text, end_text, speaker)``, ``regions (rec_id, log)``
    with ``asr_chunks (rec_id, chunk, transcription)`` and optionally ``asr_chunks_again``, or else ``asr (rec_id,
    transcription)`` and optionally ``asr_again`` of whole recordings, ``diarization (rec_id, line_no, value)``,
    ``silences (rec_id, log, offset, end)``, ``loudness (rec_id, name, attempt, log)``, ``poses (rec_id, t, necks, faces,
    bodies)`` and ``faces (rec_id, t, faces, text)``. ``tools`` are their versions, which decide with the settings what is
    run again. ``parts``: into how many each table is divided, and how finely changes are written (``increment``).
    """

    spark: SparkSession
    folder: str
    settings: files.Settings
    asker: Asker
    sources: dict[str, DataFrame]
    tools: dict[str, str] = field(default_factory=dict)
    parts: int = 8
    store: increment.Store = field(init=False, repr=False)
    _words: dict[str, DataFrame] = field(init=False, repr=False, default_factory=dict)
    _lock: threading.Lock = field(init=False, repr=False, default_factory=threading.Lock)

    def __post_init__(self):
        self.store = increment.Store(self.spark, self.folder, self.parts)

    def path(self, name: str) -> str:
        return self.store.path(name)

    def read(self, name: str) -> DataFrame:
        return self.store.read(name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return self.store.write(df, name)

    def source(self, name: str) -> DataFrame:
        """A source's rows of the recordings that are worked on."""
        return self.store.work().of(self.sources[name])

    def words(self, name: str) -> DataFrame:
        """A table of words as operators that use it several times want it, in buckets by recording. Stages that work on
        most recordings share one such copy; it is written once a run."""
        work = self.store.work()
        if not work.most:
            return tables.by_recording(self.read(name), "words", "idx")
        with self._lock:
            if name not in self._words:
                with self.store.scope:
                    self._words[name] = tables.by_recording(self.store.whole(name), "words", "idx")
        return work.of(self._words[name])

    def forget(self) -> None:
        """Lets go of what a run keeps to itself; the tables that it leaves stay."""
        self._words.clear()
        self.store.forget()

    def spans(self) -> DataFrame:
        return self.read("talks").where("error IS NULL").select("rec_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))

    def mains(self) -> DataFrame:
        return self.read("talks").where("error IS NULL AND main IS NOT NULL").select("rec_id", "main")

    def pauses(self) -> DataFrame:
        return tables.written(logs.silences(self.source("silences")).select("rec_id", "start", "end"), "pauses")

    def terms(self) -> list[str]:
        """The people, then the terms that aren't among them."""
        return list(dict.fromkeys([*self.settings.talk.preachers, *self.settings.transcription.glossary]))

    def texts(self, df: DataFrame, name: str, file: str) -> DataFrame:
        """Texts ``(rec_id, text)`` as a table of files."""
        return self.write(df.select("rec_id", F.lit(file).alias("file"), "text"), name)


def probe(job: Job) -> None:
    """What each recording is; one without a usable video has an error."""
    r = job.source("recordings")
    job.write(r.select("rec_id", "file", "date", logs.probe(F.col("report")).alias("p")).select("rec_id", "file", "date", "p.*"), "recordings")


def _media(job: Job, df: DataFrame, name: str, tool: str, dest: str, **more) -> DataFrame:
    """Requests to a tool: ``rec_id, tool, file, start, seconds, dest`` and what else it has to know."""
    extra = [(v if not isinstance(v, str | int | float) else F.lit(v)).alias(k) for k, v in more.items()]
    d = df.join(job.read("recordings").where("error IS NULL").select("rec_id", "file", "width", "height", "fps"), "rec_id")
    return job.write(d.select("rec_id", F.lit(tool).alias("tool"), "file", "start", (F.col("end") - F.col("start")).alias("seconds"), F.lit(dest).alias("dest"), *extra), name)


def analysis_audio(job: Job) -> None:
    """What to take out of each recording for recognizers."""
    r = job.read("recordings").where("error IS NULL").select("rec_id", F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    _media(job, r, "media-analysis", "extract", "audio16k.wav", channels=1, rate=16000)


def transcribe(job: Job) -> None:
    """Words and loops; a second transcription of a chunk, or of a recording, counts where it has fewer loops. With chunks
    come the requests to cut them out, those to hear again being marked."""
    ok = job.read("recordings").where("error IS NULL").select("rec_id")
    of = lambda name: job.source(name).join(ok, "rec_id", "left_semi") if name in job.sources else None
    if "regions" in job.sources:
        units, words, loops = transcription.transcribed(transcription.speech_regions(of("regions")), of("asr_chunks"), of("asr_chunks_again"), tables.written)
        own = transcription.requests(units)
    else:
        words, loops = _whole_transcription(of("asr"), of("asr_again"))
        own = ok.where("false").select("rec_id", F.lit(0).alias("chunk"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit("").alias("dest"), F.lit(False).alias("again"))
    job.write(words, "words")
    job.write(loops, "loops")
    job.write(own.join(job.read("recordings").select("rec_id", "file"), "rec_id").withColumn("preset", wd.alignment_preset(F.lit(job.settings.transcription.model))), "media-chunks")


def _whole_transcription(first: DataFrame, again: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    def read(asr: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        w = tables.by_recording(wd.assemble(files.asr_tokens(asr)), name, "idx")
        return w, wd.repeats(w)

    words, loops = read(first, "asr")
    if again is None:
        return words, loops
    second, its = read(again, "asr_again")
    n = lambda df, c: df.groupBy("rec_id").agg(F.count(F.lit(1)).alias(c))
    counts = again.select("rec_id").distinct().join(n(loops, "a"), "rec_id").join(n(its, "b"), "rec_id", "left")
    better = tables.written(counts.where(wd.retry_chosen(F.col("a"), F.coalesce("b", F.lit(0)))).select("rec_id"), "better")
    mix = lambda old, new: old.join(better, "rec_id", "left_anti").unionByName(new.join(better, "rec_id", "left_semi"))
    return mix(words, second), mix(loops, its)


def diarize(job: Job) -> None:
    ok = job.read("recordings").where("error IS NULL").select("rec_id")
    job.write(tn.clean(logs.diarization_turns(job.source("diarization").join(ok, "rec_id", "left_semi"))), "turns")


def find_talk(job: Job) -> None:
    """The span that a person set, or else the one that the model finds."""
    words, turns = job.words("words"), job.read("turns")
    ok = job.read("recordings").where("error IS NULL").select("rec_id")
    own = boundaries.given(turns, job.source("recordings").join(ok, "rec_id", "left_semi").select("rec_id", "start_text", "end_text"))
    own = tables.written(own.withColumn("source", F.lit("given")), "given")
    rest = words.join(own, "rec_id", "left_anti")
    found = boundaries.asked(rest, turns, job.pauses(), job.settings.talk.preachers, job.settings.talk.ends, job.asker, tables.written)
    silent = transcription.without_speech(ok.join(own, "rec_id", "left_anti"), words.select("rec_id").distinct())
    out = found.withColumn("source", F.lit("found")).unionByName(own, allowMissingColumns=True).unionByName(silent, allowMissingColumns=True)
    job.write(out.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>"))), "talks")


def correct(job: Job) -> None:
    words, terms = job.words("words"), job.terms()
    asked = job.write(corrections.asked(words, job.spans(), terms, job.asker), "proposed")
    proposed = asked.where("error IS NULL").drop("error")
    out = job.write(corrections.outcomes(words, proposed, terms, tables.written).join(proposed.select("rec_id", "pos", "time", "reason"), ["rec_id", "pos"]), "corrections")
    job.write(corrections.applied(words, out), "corrected")


def caption(job: Job) -> None:
    """Subtitles and the readable transcript of each talk."""
    words = wd.within(job.words("corrected"), job.spans())
    starts = job.spans().select("rec_id", F.col("span_start").alias("offset"))
    blocks = wd.srt_lines(wd.cues(words).join(starts, "rec_id"), F.col("offset"))
    every = F.array_sort(F.collect_list(F.struct("cue", "block")))  # a recording's
    job.texts(blocks.groupBy("rec_id").agg(F.array_join(F.transform(every, lambda x: x["block"]), "").alias("text")), "captions", CAPTIONS)
    job.texts(wd.transcript_text(wd.paragraphs(words)), "transcripts", TRANSCRIPT)


def _reports(job: Job) -> DataFrame:
    r = job.source("loudness").select("rec_id", "name", "attempt", logs.loudness(F.col("log")).alias("l"))
    return r.where("l.error IS NULL").select("rec_id", "name", "attempt", "l.integrated", "l.peak", "l.spread")


def _mastered(job: Job, plan: DataFrame, table: str, channels: int, rate: int, fades: tuple[float, float]) -> None:
    """``plan (rec_id, name, target, seconds)`` with the state of its attempts and the filter to run next."""
    p = plan.withColumn("peak", F.lit(job.settings.audio.true_peak))
    out = publish.mastered(p.select("rec_id", "name", "target", "peak"), _reports(job))
    chain = publish.master_filter(F.struct("gain", "ceiling"), rate, F.col("seconds"), *fades)
    out = p.select("rec_id", "name", "seconds").join(out, ["rec_id", "name"], "left").withColumn("filter", chain)
    job.write(out.withColumn("channels", F.lit(channels)).withColumn("rate", F.lit(rate)), table)


def master(job: Job, name: str) -> None:
    channels, rate, *fades = MASTERS[name]
    target = job.settings.audio.video_lufs if name == "video" else job.settings.audio.podcast_lufs
    plan = job.spans().select("rec_id", F.lit(name).alias("name"), F.lit(target).alias("target"), (F.col("span_end") - F.col("span_start")).alias("seconds"))
    _mastered(job, plan, f"audio-{name}", channels, rate, tuple(fades))


def describe(job: Job) -> None:
    t, r = job.settings.talk, job.source("recordings")
    names = job.read("talks").select("rec_id", "name")
    said = F.when(F.coalesce("speaker", F.lit("")) != "", F.col("speaker")).otherwise(F.col("name"))
    facts = r.join(names, "rec_id", "left").select("rec_id", F.lit(t.name).alias("place"), F.lit(t.location).alias("location"), F.lit(t.mission).alias("mission"), F.lit(t.website).alias("website"), "date", said.alias("speaker"))
    out = publish.asked(job.words("corrected"), job.spans(), facts, job.asker, tables.written)
    out = job.write(out, "texts").where("error IS NULL")
    lines = lambda c, by, end: F.concat(F.array_join(c, by), F.lit(end))
    job.texts(out.select("rec_id", "text"), "descriptions", DESCRIPTION)
    job.texts(out.select("rec_id", lines("titles", "\n", "\n").alias("text")), "titles", TITLES)
    job.texts(out.select("rec_id", lines("tags", ", ", "\n").alias("text")), "tags", TAGS)


def _done(job: Job, name: str) -> DataFrame:
    return job.read(f"audio-{name}").where("done").select("rec_id")


def video(job: Job) -> None:
    s, v = job.spans().join(_done(job, "video"), "rec_id", "left_semi"), job.settings.video
    _media(job, s.select("rec_id", F.col("span_start").alias("start"), F.col("span_end").alias("end")), "media-video", "encode", VIDEO, preset=v.preset, crf=v.crf, rate=F.col("fps"), command=commands.talk_command(F.col("file"), F.lit(f"{WORK}/master-video.wav"), F.col("start"), F.col("end") - F.col("start"), F.col("fps"), v.preset, v.crf, F.lit(VIDEO)))


def podcast(job: Job) -> None:
    """The episode's request, description and chapters."""
    s = job.spans().join(_done(job, "podcast"), "rec_id", "left_semi")
    t = job.read("texts").where("error IS NULL")
    c = t.select("rec_id", F.explode("chapters").alias("c")).select("rec_id", "c.at", "c.title")
    ends = publish.chapter_ends(c, s.select("rec_id", (F.col("span_end") - F.col("span_start")).alias("duration"))).select("rec_id", F.col("at").alias("start"), "end", "title")
    marks = ends.groupBy("rec_id").agg(files.chapter_metadata(F.array_sort(F.collect_list(F.struct("start", "end", "title")))).alias("text"))
    job.texts(marks, "episode-chapters", PODCAST_CHAPTERS)
    job.texts(t.select("rec_id", publish.short_description(F.col("short"), F.col("chapters")).alias("text")), "episode-texts", PODCAST_TEXT)
    spans = s.join(t.select("rec_id", "titles"), "rec_id").join(job.read("recordings").select("rec_id", "date"), "rec_id")
    title = publish.first_or(F.col("titles"), F.concat(F.lit("Talk · "), "date"))
    own = spans.select("rec_id", F.col("span_start").alias("start"), F.col("span_end").alias("end"), title.alias("title"), "date")
    k = job.settings
    tags = {"title": F.col("title"), "artist": F.lit(k.talk.name), "album": F.lit(k.talk.podcast or k.talk.name), "date": F.col("date"), "comment": F.lit(k.talk.website)}
    command = commands.episode_command(F.lit(f"{WORK}/master-podcast.wav"), F.lit(PODCAST_CHAPTERS), k.audio.podcast_bitrate, tags, F.lit(PODCAST))
    _media(job, own, "media-podcast", "episode", PODCAST, **tags, bitrate=k.audio.podcast_bitrate, command=command)


def pick_clips(job: Job) -> None:
    k = job.settings.clips
    if k.count == 0:
        out = job.spark.createDataFrame([], "rec_id bigint, pos bigint, number int, title string, caption string, start double, end double, score int, review string, verdict string, clip_id string")
    else:
        out = clips.asked(job.words("corrected"), job.read("turns"), job.pauses(), job.spans(), job.mains(), job.asker, k.count, k.min_seconds, k.max_seconds, k.min_score, tables.written)
    out = job.write(out, "clips")
    job.texts(clips.post_captions(out.where("clip_id IS NOT NULL")), "posts", POSTS)


def _chosen(job: Job) -> DataFrame:
    """Chosen clips under a number of their own, ``clip``, which stands for as long as the table does."""
    return tables.written(job.read("clips").where("clip_id IS NOT NULL").withColumn("clip", F.monotonically_increasing_id()), "chosen")


def render_clips(job: Job) -> None:
    """For each chosen clip: the camera's path, captions, mastering, and the request; ``uncropped`` without a path."""
    k, mine = job.settings.clips, _chosen(job)
    r = job.read("recordings").select("rec_id", "width", "height")
    inside = lambda t: (t >= F.col("start")) & (t < F.col("end"))
    of_clip = mine.select("rec_id", "clip", "start", "end", tn.bins(F.col("start"), F.col("end")).alias("bin"))
    seen = job.source("poses").withColumn("bin", F.floor(F.col("t") / tn.BIN)).join(of_clip, ["rec_id", "bin"]).where(inside(F.col("t")))
    own = seen.select(F.col("clip").alias("rec_id"), "t", F.coalesce(camera.candidates(F.col("necks"), F.col("faces"), F.col("bodies")), F.array().cast("array<double>")).alias("xs"))
    sized = mine.join(r.where("width IS NOT NULL"), "rec_id")
    these = sized.select(F.col("clip").alias("rec_id"), F.col("start").alias("clip_start"), tc.frame_count(F.col("end") - F.col("start")).alias("frames"), F.col("width").cast("double").alias("frame_width"), camera.window_width(F.col("height").cast("double")).alias("window_width"))
    path = camera.path(own.join(these.select("rec_id"), "rec_id", "left_semi"), these, camera.Camera(0.0, 0.0, k.steadiness, k.smoothing_seconds))
    path = tables.by_recording(path, "paths", "frame")
    every = F.array_sort(F.collect_list(F.struct("frame", "line")))  # a clip's changes
    moves = camera.crop_commands(path).groupBy("rec_id").agg(F.array_join(F.transform(every, lambda x: x["line"]), "").alias("commands")).withColumnRenamed("rec_id", "clip")
    words = job.words("corrected").withColumn("bin", F.floor(F.col("start") / tn.BIN)).join(of_clip.withColumnRenamed("start", "c0").withColumnRenamed("end", "c1"), ["rec_id", "bin"]).where((F.col("start") >= F.col("c0")) & (F.col("start") < F.col("c1")))
    words = tables.by_recording(words.select(F.col("clip").alias("rec_id"), "idx", "text", (F.col("start") - F.col("c0")).alias("start"), (F.col("end") - F.col("c0")).alias("end")), "clip_words", "idx")
    captions = wd.caption_file(wd.caption_highlights(words, wd.cues(words, wd.CLIP_CAPTIONS), F.lit(0.0)), k.font_family).withColumnRenamed("rec_id", "clip").withColumnRenamed("text", "captions")
    begins = path.where("frame = 0").select(F.col("rec_id").alias("clip"), F.col("left").alias("left_edge"))
    out = mine.join(moves, "clip", "left").join(captions, "clip", "left").join(begins, "clip", "left").join(job.read("recordings").select("rec_id", F.col("file").alias("path"), "height"), "rec_id")
    dest, own = F.concat(F.lit("Clips/"), "clip_id", F.lit(".mp4")), lambda end: F.concat("clip_id", F.lit(end))
    pictures = commands.clip_graph(F.col("height").cast("double"), F.col("left_edge"), own(".ass"), own(".cmd"), F.lit(str(Path(k.font_file).parent)))
    command = commands.clip_command(F.col("path"), own(".wav"), F.col("start"), F.col("end") - F.col("start"), pictures, job.settings.video.preset, k.crf, dest)
    job.write(out.select("rec_id", "clip_id", dest.alias("file"), "start", "end", "commands", "captions", F.col("commands").isNull().alias("uncropped"), F.lit(k.crf).alias("crf"), command.alias("command")), "clip-renders")
    plan = mine.select("rec_id", F.col("clip_id").alias("name"), F.lit(job.settings.audio.video_lufs).alias("target"), (F.col("end") - F.col("start")).alias("seconds"))
    _mastered(job, plan, "audio-clips", 2, 48000, CLIP_FADES)


def thumbnail_frames(job: Job) -> None:
    """Sampled frames inside the talks."""
    f = job.source("faces").join(job.spans(), "rec_id").where(tc.contains(F.col("span_start"), F.col("span_end"), F.col("t")))
    job.write(f.select("rec_id", "t", "faces", "text"), "faces")


def thumbnails(job: Job) -> None:
    best = frames.choose(job.read("faces"), job.settings.thumbnails.count)
    r = job.read("recordings").select("rec_id", F.col("file").alias("path"), "width", "height")
    t = job.read("texts").where("error IS NULL").select("rec_id", "passage", F.coalesce(F.substring_index(F.get("titles", F.lit(0)), " | ", 1), F.col("passage")).alias("title"))
    crop = frames.frame_crop(F.col("box"), F.col("width").cast("double"), F.col("height").cast("double"))
    dest = F.concat(F.lit("YouTube/thumbnails/"), (F.col("place") + 1).cast("string"), F.lit(".jpg"))
    calls = commands.still_commands(F.col("path"), F.col("t"), crop, F.coalesce("title", F.lit("")), F.coalesce("passage", F.lit("")), job.settings.thumbnails.font_file, dest)
    out = best.join(r, "rec_id").join(t, "rec_id").select("rec_id", "place", "t", "score", crop.alias("crop"), calls.alias("commands"), tx.caption_argument(F.col("title")).alias("title"), tx.caption_argument(F.col("passage")).alias("passage"), dest.alias("file"))
    job.write(out, "thumbnails")


def reviewed(job: Job) -> None:
    """One row for each recording with all that a person has to look at, from whatever the other stages left; of one
    that failed, with what went wrong and where."""
    def maybe(name: str, schema: str) -> DataFrame:
        return job.read(name) if job.store.exists(name) else job.spark.createDataFrame([], schema)

    def failed(name: str, what: str) -> DataFrame:
        own = maybe(name, "rec_id bigint, error string")
        return own.where("error IS NOT NULL").select("rec_id", F.concat(F.lit(f"{what}: "), "error").alias("f"))

    errors = failed("recordings", "The recording")
    for name, what in (("talks", "The talk"), ("proposed", "Corrections"), ("texts", "Titles and descriptions")):
        errors = errors.unionByName(failed(name, what))
    errors = errors.groupBy("rec_id").agg(F.array_sort(F.collect_list("f")).alias("errors"))
    talk = maybe("talks", "rec_id bigint, start double, end double, source string, flags array<string>, start_quote string, end_quote string, confidence string, reasoning string, error string")
    talk = talk.where("error IS NULL").select("rec_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "source", "flags", "start_quote", "end_quote", "confidence", "reasoning")
    base = job.read("recordings").select("rec_id", "file", "date").join(talk, "rec_id", "left").join(errors, "rec_id", "left")
    base = base.withColumn("flags", F.concat(F.coalesce("errors", F.array().cast("array<string>")), F.coalesce("flags", F.array().cast("array<string>"))))
    texts = maybe("texts", "rec_id bigint, titles array<string>, short string, passage string, text string, adjustments array<string>, error string").where("error IS NULL").select("rec_id", "titles", "short", "passage", F.col("text").alias("description"), "adjustments")
    picks = maybe("clips", "rec_id bigint, clip_id string, verdict string, title string, score int, review string").groupBy("rec_id").agg(
        F.count("clip_id").cast("int").alias("n_clips"),
        F.array_sort(F.collect_list(F.when(F.col("clip_id").isNotNull(), F.concat("clip_id", F.lit(": "), "title", F.lit(" ("), F.col("score").cast("string"), F.lit("), "), F.coalesce("review", F.lit("")))))).alias("clips"),
        F.array_sort(F.collect_list(F.when(F.col("clip_id").isNull(), F.concat(F.coalesce("title", F.lit("all")), F.lit(": "), "verdict")))).alias("refused"),
    )
    renders = maybe("clip-renders", "rec_id bigint, clip_id string, uncropped boolean").groupBy("rec_id").agg(F.collect_list(F.when(F.col("uncropped"), F.col("clip_id"))).alias("uncropped"))
    fixes = maybe("corrections", "rec_id bigint, pos int, find string, replace string, time string, applied boolean, skipped string")
    fix = F.concat(F.lit("“"), "find", F.lit("” → “"), "replace", F.lit("” at "), "time")
    ordered = lambda cond, text: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", text.alias("t"))))), lambda x: x["t"])
    fixes = fixes.groupBy("rec_id").agg(ordered(F.col("applied"), fix).alias("fixes"), ordered(~F.col("applied"), F.concat(fix, F.lit(": "), "skipped")).alias("unfixed"))
    stills = maybe("thumbnails", "rec_id bigint, place int, file string").groupBy("rec_id").agg(F.count(F.lit(1)).cast("int").alias("n_stills"))
    faces = maybe("faces", "rec_id bigint, t double").groupBy("rec_id").agg(F.count(F.lit(1)).cast("int").alias("n_faces"))
    loud = lambda name: maybe(f"audio-{name}", "rec_id bigint, done boolean, integrated double, peak double, spread double").where("done").select("rec_id", publish.loudness_text(F.col("integrated"), F.col("peak"), F.col("spread")).alias(f"{name}_loudness"))
    made = lambda name, c: maybe(name, "rec_id bigint").select("rec_id", F.lit(True).alias(c)).distinct()
    loops = boundaries.repeat_flags(maybe("loops", "rec_id bigint, start double, end double"), base.select("rec_id", "span_start", "span_end"))
    loops = loops.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "flag"))), lambda x: x["flag"]).alias("loops"))
    out = base
    for part in (texts, picks, renders, fixes, stills, faces, loud("video"), loud("podcast"), loops, made("captions", "has_captions"), made("media-video", "has_video"), made("media-podcast", "has_podcast")):
        out = out.join(part, "rec_id", "left")
    lacks = [("titles", "titles and descriptions"), ("video_loudness", "mastered audio of the video"), ("podcast_loudness", "mastered audio of the podcast"), ("n_clips", "clip choices"), ("has_captions", "captions"), ("has_video", "the video"), ("has_podcast", "the podcast")]
    # of a recording without a talk that says it all
    missing = F.when(F.col("span_start").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(what)) for c, what in lacks])))
    flags = review.flags(missing, F.col("flags"), F.col("adjustments"), job.settings.clips.count, F.col("n_clips"), F.col("uncropped"), F.col("n_faces"), F.coalesce("n_stills", F.when(F.col("n_faces").isNotNull(), F.lit(0))))
    out = out.withColumn("flags", F.concat(F.coalesce("loops", F.array().cast("array<string>")), flags))
    title = publish.first_or(F.coalesce("titles", F.array().cast("array<string>")), F.substring_index("file", "/", -1))
    out = out.withColumn("title", title).withColumn("folder", tx.folder_name(F.col("date"), F.get("titles", F.lit(0)), F.col("passage")))
    sections = {
        "Talk": F.when(F.col("span_start").isNotNull(), F.array(F.concat(tc.precise(F.col("span_start")), F.lit(" to "), tc.precise(F.col("span_end")), F.lit(" ("), "source", F.lit(")")), F.coalesce("reasoning", F.lit("")))),
        "Loudness": F.array_compact(F.array(F.col("video_loudness"), F.col("podcast_loudness"))),
        "Titles": F.col("titles"), "Description": F.array_compact(F.array("description")), "Clips": F.col("clips"), "Not chosen": F.col("refused"),
        "Corrected": F.col("fixes"), "Not corrected": F.col("unfixed"),
    }
    out = out.withColumn("page", review.html_page(F.col("title"), F.col("flags"), sections))
    job.write(out.select("rec_id", "title", "folder", "span_start", "span_end", "source", "flags", "errors", "n_clips", "n_stills", "clips", "refused", "fixes", "unfixed", "page"), "review")


def exported(job: Job, root: str) -> DataFrame:
    """Puts all texts and the review page of each recording into a folder of its own under ``root``, named for people to
    find it; the files that went, as ``rec_id, folder, file``. Folders of one name get the recording's number."""
    every = [job.store.whole(name).select("rec_id", "file", "text") for name in ("captions", "transcripts", "descriptions", "titles", "tags", "episode-texts", "episode-chapters", "posts") if job.store.exists(name)]
    review_ = job.store.whole("review")
    pages = review_.select("rec_id", F.lit(REVIEW).alias("file"), F.col("page").alias("text"))
    for part in every:
        pages = pages.unionByName(part)
    several = review_.groupBy("folder").count().where("count > 1").select("folder", F.lit(True).alias("several"))
    folders = review_.select("rec_id", "folder").join(several, "folder", "left")
    folders = folders.select("rec_id", F.when(F.col("several"), F.concat("folder", F.lit(" "), F.col("rec_id").cast("string"))).otherwise(F.col("folder")).alias("folder"))
    return sinks.export(pages.join(folders, "rec_id").where("text IS NOT NULL"), root, MANAGED)


def graph(job: Job) -> list[dag.Stage]:
    """All stages with what they need, read and leave."""
    k = job.settings
    ask = lambda name: repr((k.asking, prompts.version(name)))
    tool = lambda *names: repr([(n, job.tools.get(n, "")) for n in names])
    left: dict[str, tuple[str, ...]] = {}

    def stage(name: str, run: Callable[[Job], None], needs: tuple[str, ...], outputs: tuple[str, ...], inputs: tuple[str, ...] = (), sources: tuple[str, ...] = (), **more) -> dag.Stage:
        own = {s: job.sources[s] for s in sources if s in job.sources}
        missing = tuple(s for s in sources if s not in job.sources)
        # a final stage reads what all others leave
        reads = [t for n in (left if more.get("finally_") else needs) for t in left[n]]
        left[name] = outputs
        marks = tuple(f"{s}:{job.store.total(job.store.source(s, df))}" for s, df in own.items())
        settings = json.dumps([name, more.get("version", 1), inputs, missing])
        work = lambda force=more.get("force", False): job.store.step(name, settings, reads, own, list(outputs), lambda: run(job), force)
        return dag.Stage(name, work, needs, (*inputs, *marks, *missing), outputs, **more)

    return [
        stage("probe", probe, (), ("recordings",), (tool("media"),), ("recordings",)),
        stage("analysis-audio", analysis_audio, ("probe",), ("media-analysis",), (tool("media"),)),
        stage("transcribe", transcribe, ("analysis-audio", "probe"), ("words", "loops", "media-chunks"), (k.transcription.model, k.transcription.language, tool("recognizer")), ("regions", "asr_chunks", "asr_chunks_again", "asr", "asr_again")),
        stage("diarize", diarize, ("analysis-audio", "probe"), ("turns",), (tool("diarizer"),), ("diarization",)),
        stage("talk", find_talk, ("probe", "transcribe", "diarize"), ("talks",), (k.talk.ends, *k.talk.preachers, ask("talk-span")), ("recordings", "silences")),
        stage("corrections", correct, ("transcribe", "talk"), ("proposed", "corrections", "corrected"), (*job.terms(), ask("fix-words"))),
        stage("captions", caption, ("corrections", "talk"), ("captions", "transcripts")),
        stage("video-audio", lambda j: master(j, "video"), ("talk",), ("audio-video",), (repr((k.audio.video_lufs, k.audio.true_peak)),), ("loudness",)),
        stage("podcast-audio", lambda j: master(j, "podcast"), ("talk",), ("audio-podcast",), (repr((k.audio.podcast_lufs, k.audio.true_peak, k.audio.podcast_bitrate)),), ("loudness",)),
        stage("video", video, ("probe", "talk", "video-audio"), ("media-video",), (repr(k.video), tool("media"))),
        stage("describe", describe, ("corrections", "talk"), ("texts", "descriptions", "titles", "tags"), (repr(astuple(k.talk)), ask("texts")), ("recordings",)),
        stage("podcast", podcast, ("probe", "podcast-audio", "describe", "talk"), ("media-podcast", "episode-texts", "episode-chapters"), (repr(astuple(k.talk)), k.audio.podcast_bitrate)),
        stage("clip-picks", pick_clips, ("corrections", "diarize", "talk"), ("clips", "posts"), (repr((k.clips.count, k.clips.min_score, k.clips.min_seconds, k.clips.max_seconds)), ask("clip-ideas"), ask("clip-judge")), ("silences",)),
        stage("clips", render_clips, ("probe", "talk", "corrections", "clip-picks"), ("clip-renders", "audio-clips"), (repr((k.clips, k.audio)), tool("tracker")), ("poses", "loudness")),
        stage("thumbnail-frames", thumbnail_frames, ("talk",), ("faces",), (tool("tracker"),), ("faces",)),
        stage("thumbnails", thumbnails, ("probe", "thumbnail-frames", "describe"), ("thumbnails",), (repr(k.thumbnails),)),
        stage("review", reviewed, ("probe",), ("review",), (repr(k.clips.count),), finally_=True),
    ]


class _State:
    """A run's state in a small file beside its tables, wherever they are."""

    def __init__(self, job: Job):
        self.spark, self.path = job.spark, job.path("_known/state.json")

    def load(self) -> dict:
        try:
            return json.loads(tables.get_text(self.spark, self.path) or "{}")
        except ValueError:
            return {}

    def save(self, state: dict) -> None:
        tables.put_text(self.spark, self.path, json.dumps(state, sort_keys=True))


def run(job: Job, targets: list[str] | None = None, slots: int = 3) -> dict[str, dag.Result]:
    """Runs the stages for the recordings that changed; results by name, with how many recordings each worked on."""
    if wrong := job.settings.problems():
        raise ValueError("; ".join(wrong))

    def digest(names: Iterable[str]) -> str:
        every = [job.store.table_digest(n) for n in sorted(names)]
        return "\n".join(every) if all(every) else ""

    job.forget()
    try:
        return dag.run(graph(job), _State(job), targets, slots, digest)
    finally:
        job.forget()
