"""The demonstration of a whole run: what tools and models could give for recordings made of general tables, scripted.

The query ``run_review`` and the tests use it; the library does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import timecode as tc
from tidemark.sources.derived import turns_of_words


def _said(words_: DataFrame, group: list, place, quotes: dict[str, tuple[int, int]], times: dict[str, int]) -> DataFrame:
    """For each group of words, those at some places of it as quotes, and the clocks at some places."""
    w = words_.withColumn("__k", place)
    quote = lambda a, b: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__k").between(a, b), F.struct("idx", "text")))), lambda x: x["text"]), " ")
    clock = lambda a: F.coalesce(tc.clock(F.max(F.when(F.col("__k") == a, F.col("start")))), F.lit("?"))
    return w.groupBy(*group).agg(*[quote(a, b).alias(n) for n, (a, b) in quotes.items()], *[clock(a).alias(n) for n, a in times.items()])


def scripted_run(words_: DataFrame, terms: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Sources of a run and scripted replies, all from words. What is quoted of a short recording isn't there: the run
    has to say so."""
    size = words_.groupBy("rec_id").agg(F.max("idx").alias("n"), F.max("end").alias("seconds"))
    w = words_
    rec = F.col("rec_id")
    fixed = lambda c, k: F.format_string(f"%.{k}f", c.cast("double"))
    report = F.to_json(F.struct(F.array(F.struct(F.lit("video").alias("codec_type"), F.lit(1280).alias("width"), F.lit(720).alias("height"), F.lit("30000/1001").alias("avg_frame_rate"), F.lit("30/1").alias("r_frame_rate"))).alias("streams"), F.struct(fixed(F.col("seconds") + 1, 3).alias("duration")).alias("format")))
    by_hand = rec % 10 == 3
    recordings = size.select(rec, F.concat(F.lit("/in/"), rec.cast("string"), F.lit(".mov")).alias("file"), F.lit("2024-01-07").alias("date"), F.when(rec % 29 == 7, F.lit("{}")).otherwise(report).alias("report"), F.when(by_hand, F.lit("0:10")).alias("start_text"), F.when(by_hand & (rec % 20 == 3), F.lit("2:00")).when(by_hand, F.lit("0:05")).alias("end_text"), F.lit("").alias("speaker"))
    token = F.struct(F.concat(F.lit(" "), "text").alias("text"), F.floor(F.col("start") * 100).cast("int").alias("t_dtw"), F.struct((F.col("start") * 1000).cast("int").alias("from"), (F.col("end") * 1000).cast("int").alias("to")).alias("offsets"))
    segments = w.groupBy("rec_id", F.floor(F.col("idx") / 50).alias("seg")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", token.alias("t")))), lambda x: x["t"]).alias("tokens"))
    asr = segments.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "tokens"))), lambda s: F.struct(F.lit("").alias("text"), s["tokens"].alias("tokens"))).alias("transcription"))
    t = turns_of_words(w)
    diarization = t.select("rec_id", F.col("idx").cast("int").alias("line_no"), F.concat(fixed(F.col("start"), 3), F.lit(" -- "), fixed(F.col("end"), 3), F.lit(" "), "speaker").alias("value"))
    gaps = w.select("rec_id", "idx", F.col("end").alias("a"), F.lead("start").over(Window.partitionBy("rec_id").orderBy("idx")).alias("b")).where("b - a >= 0.2")
    line = F.concat(F.lit("silence_start: "), fixed(F.col("a"), 3), F.lit("\nsilence_end: "), fixed(F.col("b"), 3))
    silences = gaps.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))), lambda x: x["l"]), "\n").alias("log")).join(size, "rec_id").select("rec_id", "log", F.lit(0.0).alias("offset"), F.col("seconds").alias("end"))
    heard = lambda name, attempt, loud, peak: F.struct(F.lit(name).alias("name"), F.lit(attempt).alias("attempt"), F.concat(F.lit('{"input_i": "'), loud.cast("string"), F.lit('", "input_tp": "'), peak.cast("string"), F.lit('", "input_lra": "5.0"}')).alias("log"))
    loudness = size.select("rec_id", F.explode(F.array(heard("video", 0, F.lit(-24.0), F.lit(-6.0)), heard("video", 1, -14.0 - rec % 3, -1.0 - rec % 2), heard("video", 2, F.lit(-14.2), F.lit(-1.6)), heard("podcast", 0, F.lit(-20.0), F.lit(-4.0)), heard("podcast", 1, -16.1 - rec % 5, F.lit(-2.0)))).alias("x")).select("rec_id", "x.*")
    seen = size.select("rec_id", "seconds", F.explode(F.sequence(F.lit(0), F.least(F.floor("seconds"), F.lit(900)).cast("int"))).alias("second"))
    x = (F.sin(F.col("second") / 20 + rec) + 1) / 2
    point = F.struct(x.alias("x"), F.lit(0.3).alias("y"))
    box = lambda q: F.struct((x * 0.8).alias("x"), F.lit(0.2).alias("y"), F.lit(0.1).alias("w"), (F.lit(0.05) + (rec + F.col("second")) % q / 100).alias("h"))
    none = F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")
    poses = seen.select("rec_id", F.col("second").cast("double").alias("t"), F.when((rec % 4 == 1) | (F.col("second") % 7 == 6), F.array().cast("array<struct<x:double,y:double>>")).otherwise(F.array(point)).alias("necks"), none.alias("faces"), none.alias("bodies"))
    faces = seen.where("second % 2 = 0").select("rec_id", F.col("second").cast("double").alias("t"), F.array(F.struct(box(9).alias("box"), (F.col("second") * 31 % 97 / 97).alias("quality"))).alias("faces"), F.array(box(5)).alias("text"))

    # replies
    quoted = _said(w, ["rec_id"], F.col("idx"), {"a": (20, 27), "fix": (60, 61), "name": (100, 101)}, {"at": 20, "fix_at": 60})
    ends = _said(w.join(size.select("rec_id", "n"), "rec_id"), ["rec_id"], F.col("idx") - F.col("n") + 60, {"b": (30, 37)}, {"b_at": 30})
    q = quoted.join(ends, "rec_id").join(size.select("rec_id", "seconds"), "rec_id")
    reply = lambda df, prompt, value: df.select("rec_id", F.lit(prompt).alias("prompt"), value.alias("reply"))
    span = F.struct(F.when(rec % 17 == 2, F.lit("words that nobody said")).otherwise(F.col("a")).alias("start_quote"), F.col("at").alias("start_time"), F.col("b").alias("end_quote"), F.col("b_at").alias("end_time"), F.when(rec % 2 == 0, F.col("name")).otherwise(F.lit("Nobody Known")).alias("name"), F.when(rec % 3 == 0, F.lit("medium")).otherwise("high").alias("confidence"), F.lit("it starts there").alias("reasoning"), F.array_compact(F.array(F.when(rec % 7 == 0, F.lit("it breaks off")))).alias("notes"))
    fix = F.struct(F.array(F.struct(F.col("fix").alias("find"), F.when(rec % 2 == 0, F.lit(terms[0])).otherwise(F.concat("fix", F.lit(" indeed"))).alias("replace"), F.col("fix_at").alias("time"), F.lit("it sounds so").alias("reason"))).alias("corrections"))
    ideas = _said(w.where("idx % 100 < 80"), ["rec_id", F.floor(F.col("idx") / 100).alias("pos")], F.col("idx") % 100, {"start_quote": (5, 10), "end_quote": (70, 76)}, {"start_time": 5, "end_time": 70}).where("pos > 0 AND pos < 8")
    idea = F.struct("start_quote", "start_time", "end_quote", "end_time", F.concat(F.lit("Part "), F.col("pos").cast("string"), F.lit(": it's here")).alias("title"), F.lit("look").alias("caption"))
    ideas = ideas.groupBy("rec_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("pos", idea.alias("c")))), lambda c: c["c"]).alias("candidates"))).alias("v"))
    judge = lambda k: F.struct(F.lit(k).alias("number"), F.lit("reject" if k % 4 == 3 else "keep").alias("verdict"), F.lit("so it is").alias("reason"), F.lit(3 + k * 5 % 8).alias("score"))
    chapter = lambda share, title: F.struct(F.when(rec % 6 == 1, F.lit("soon")).otherwise(tc.clock(F.floor(F.col("seconds") * share))).alias("time"), F.lit(title).alias("title"))
    text = lambda first: F.struct(F.array(F.concat(F.initcap(F.col("name")), F.lit(" | Part"))).alias("titles"), F.concat("a", F.lit(" <b>\n\n"), "b").alias("long"), F.col("b").alias("short"), (F.array(chapter(0.05, "First"), chapter(0.3, "Then"), chapter(0.31, "Soon"), chapter(0.6, "At last")) if first else F.array(chapter(0.1, "Only"))).alias("chapters"), F.lit("Psalm 1:1-3").alias("passage"), F.array(F.lit("John 3:16")).alias("scripture"), F.split("a", " ").alias("tags"), F.split("b", " ").alias("hashtags"))
    every = [reply(q, "talk-span", F.to_json(span)), reply(q, "fix-words", F.to_json(fix)), reply(ideas, "clip-ideas", F.when(rec % 19 == 4, F.lit("{broken")).otherwise(F.col("v"))), reply(q, "clip-judge", F.to_json(F.struct(F.array(*[judge(k) for k in (2, 1, 3, 9, 2, 4, 5)]).alias("reviews")))), reply(q, "texts", F.to_json(text(True))), reply(q, "texts/2", F.to_json(text(False)))]
    replies = every[0]
    for r in every[1:]:
        replies = replies.unionByName(r)
    return {"recordings": recordings, "asr": asr, "diarization": diarization, "silences": silences, "loudness": loudness, "poses": poses, "faces": faces}, replies
