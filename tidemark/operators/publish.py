"""Rules for published texts: chapters, tags, hashtags, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import timecode as tc
from tidemark.functions.ask import Asker, answer
from tidemark.operators import words as wd

CHAPTER_GAP, LEAST_CHAPTERS = 10.0, 3
TAG_BYTES, HASHTAGS, DESCRIPTION_BYTES = 500, 3, 5000


def valid_chapters(chapters: DataFrame, durations: DataFrame) -> DataFrame:
    """Chapters ``(rec_id, pos, at, title)`` with ``place``, ``at`` and ``dropped``, null for those that stay.

    By time, then position: one too near the end goes, then one less than 10 s after the last that stayed. The first
    that stays moves to 0.
    """
    item = F.struct("at", "pos", "title")
    by = chapters.groupBy("rec_id").agg(F.array_sort(F.collect_list(item)).alias("items")).join(durations.select("rec_id", "duration"), "rec_id")  # one recording's
    late = lambda c: c["at"] >= F.col("duration") - CHAPTER_GAP
    zero = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<string>").alias("why"))

    def step(s: Column, c: Column) -> Column:
        why = F.when(late(c), F.lit("in the last 10 s")).when(c["at"] - s["last"] < CHAPTER_GAP, F.lit("under 10 s after the one before"))
        return F.struct(F.when(why.isNull(), c["at"]).otherwise(s["last"]).alias("last"), F.concat(s["why"], F.array(why)).alias("why"))

    flat = by.select("rec_id", F.explode(F.arrays_zip("items", F.aggregate("items", zero, step)["why"].alias("why"))).alias("x")).select("rec_id", "x.items.*", F.col("x.why").alias("dropped"))
    kept = Window.partitionBy("rec_id", F.col("dropped").isNull()).orderBy("at", "pos")
    place = F.when(F.col("dropped").isNull(), F.row_number().over(kept) - 1)
    return flat.select("rec_id", "pos", "title", place.alias("place"), F.when(place == 0, F.lit(0.0)).otherwise(F.col("at")).alias("at"), "dropped")


def chapter_ends(chapters: DataFrame, durations: DataFrame) -> DataFrame:
    """Chapters ``(rec_id, at, title)`` with ``end``: the next one's start, or the recording's end."""
    nxt = F.lead("at").over(Window.partitionBy("rec_id").orderBy("at"))
    return chapters.join(durations.select("rec_id", "duration"), "rec_id").withColumn("end", F.coalesce(nxt, F.col("duration"))).drop("duration")


def chapter_list(chapters: Column) -> Column:
    """Of an array of ``(at, title)`` in order: a heading, then a line each."""
    return F.concat(F.lit("Chapters\n"), F.array_join(F.transform(chapters, lambda c: F.concat(tc.clock(c["at"]), F.lit(" "), c["title"], F.lit("\n"))), ""))


def valid_tags(tags: Column) -> Column:
    """Cleaned tags without one leading #, distinct ignoring case, as many as fit 500 bytes with commas between."""
    bare = F.transform(tags, lambda t: F.trim(F.regexp_replace(tx.without_angles(t), "^#", "")))
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("low"), none.alias("out"), F.lit(0).alias("total"), F.lit(False).alias("full"))

    def step(s: Column, t: Column) -> Column:
        total = s["total"] + F.octet_length(t) + (F.size(s["out"]) > 0).cast("int")
        skip = s["full"] | t.isNull() | (t == "") | F.array_contains(s["low"], F.lower(t))
        full = F.struct(s["low"].alias("low"), s["out"].alias("out"), s["total"].alias("total"), F.lit(True).alias("full"))
        more = F.struct(F.array_append(s["low"], F.lower(t)).alias("low"), F.array_append(s["out"], t).alias("out"), total.alias("total"), F.lit(False).alias("full"))
        return F.when(skip, s).when(total > TAG_BYTES, full).otherwise(more)

    return F.aggregate(bare, zero, step)["out"]


def valid_hashtags(tags: Column) -> Column:
    """Letters and numbers only, distinct ignoring case, the first three, with a # before."""
    bare = F.transform(tags, lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""))
    return F.transform(F.slice(tx.distinct_ignoring_case(bare), 1, HASHTAGS), lambda t: F.concat(F.lit("#"), t))


def assembled(body: Column, scripture: Column, chapters: Column, hashtags: Column, name: Column, location: Column, website: Column) -> Column:
    """The description: prose, passages, chapters, footer, hashtags."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return F.concat(
        body,
        F.when(some(scripture), F.concat(F.lit("\n\nScripture: "), F.array_join(scripture, " · "))).otherwise(""),
        F.when(some(chapters), F.concat(F.lit("\n\n"), chapter_list(chapters))).otherwise(""),
        F.lit("\n"),
        name,
        F.when(F.coalesce(location, F.lit("")) != "", F.concat(F.lit(" · "), location)).otherwise(""),
        F.lit("\n"),
        website,
        F.lit("\n"),
        F.when(some(hashtags), F.concat(F.lit("\n"), F.array_join(hashtags, " "), F.lit("\n"))).otherwise(""),
    )


def broken_rule(chapters: Column, text: Column) -> Column:
    """The first rule that a description breaks, or null."""
    return F.when(F.size(chapters) < LEAST_CHAPTERS, F.concat(F.size(chapters).cast("string"), F.lit(f" chapters hold, {LEAST_CHAPTERS} are needed"))).when(F.octet_length(text) > DESCRIPTION_BYTES, F.concat(F.octet_length(text).cast("string"), F.lit(f" bytes are over {DESCRIPTION_BYTES}")))


def trimmed_to(text: Column, limit: int) -> Column:
    """Whole paragraphs dropped from the end until the text fits ``limit`` bytes with the newline that closes it; cut
    hard if not even the first does. What is looked at is the text's first ``limit`` bytes, without newlines at their end."""
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), 1, limit).cast("string")), "\ufffd+$", "")  # a character that the limit cuts in two goes
    bare = F.regexp_replace(head, "\n+$", "")
    kept = F.substring_index(bare, "\n\n", -1)  # what follows the last blank line
    before = F.substring(bare, F.lit(1), F.length(bare) - F.length(kept) - 2)
    # a line of the paragraph before may end with a newline of its own: the last two of a run are the break
    return F.when(F.octet_length(text) <= limit, text).when(before != "", F.concat(before, F.lit("\n"))).otherwise(head)


def first_or(items: Column, fallback: Column) -> Column:
    return F.coalesce(F.get(items, F.lit(0)), fallback)


def loudness_text(integrated: Column, peak: Column, spread: Column) -> Column:
    zero = (integrated == 0) & (peak == 0) & (spread == 0)
    return F.when(zero, F.lit("")).otherwise(F.format_string("%.1f LUFS · peak %.1f dBTP · range %.1f LU", *(F.bround(c, 1) for c in (integrated, peak, spread))))


def first_gain(target: Column, shaped: Column, peak: Column) -> Column:
    """``gain, ceiling`` of the first attempt at mastering: from the loudness that the shaped audio measured, with the
    limiter half a decibel below the peak that is allowed."""
    return F.struct((target - shaped).alias("gain"), (peak - 0.5).alias("ceiling"))


def next_gain(target: Column, peak: Column, step: Column, measured: Column, measured_peak: Column, attempt: Column) -> Column:
    """``done, failed, gain, ceiling`` after an attempt (from 1) that ran with ``step`` (gain, ceiling): done within half
    a unit of the target and not above the allowed peak; else what is missing is added to the gain, and a peak that is
    too high lowers the limiter by the excess and 0.2. The third attempt is the last."""
    over = measured_peak > peak
    done = (F.abs(target - measured) <= 0.5) & ~over
    ceiling = F.when(over, step["ceiling"] - (measured_peak - peak) - 0.2).otherwise(step["ceiling"])
    return F.struct(done.alias("done"), (~done & (attempt >= ATTEMPTS)).alias("failed"), (step["gain"] + target - measured).alias("gain"), ceiling.alias("ceiling"))


#: Fixed value: the speech chain before gain.
SHAPING = "highpass=f=70,acompressor=threshold=-24dB:ratio=3:attack=15:release=250:knee=6"
ATTEMPTS = 3


def master_filter(step: Column, rate: int, seconds: Column, fade_in: float = 0.0, fade_out: float = 0.0) -> Column:
    """The audio filter of an attempt: shaping, gain, a limiter at four times the rate, and fades."""
    fixed = lambda pattern, c, digits: F.format_string(pattern, F.bround(c, digits))
    parts = [F.lit(SHAPING + ",volume="), fixed("%.2f", step["gain"], 2), F.lit(f"dB,aresample={rate * 4},alimiter=limit="), fixed("%.4f", F.pow(F.lit(10.0), step["ceiling"] / 20), 4), F.lit(f":attack=5:release=60:level=false,aresample={rate}")]
    if fade_in > 0:
        parts.append(F.lit(f",afade=t=in:d={fade_in:.2f}"))
    if fade_out > 0:
        parts += [F.lit(",afade=t=out:st="), fixed("%.3f", seconds - fade_out, 3), F.lit(f":d={fade_out:.2f}")]
    return F.when(step["gain"].isNotNull(), F.concat(*parts))  # nothing measured, nothing to run yet


def mastered(plan: DataFrame, measured: DataFrame) -> DataFrame:
    """What becomes of mastering ``plan (rec_id, name, target, peak)`` as its attempts were ``measured (rec_id, name,
    attempt, integrated, peak, spread)``, attempt 0 being the shaped audio: ``rec_id, name, gain, ceiling, attempts,
    done, failed, integrated, peak, spread``.

    Neither done nor failed: ``gain`` and ``ceiling`` are those to run next.
    """
    m = measured.groupBy("rec_id", "name").agg(F.array_sort(F.collect_list(F.struct("attempt", "integrated", F.col("peak").alias("heard"), "spread"))).alias("ms"))  # four at most count
    p = plan.join(m, ["rec_id", "name"])
    shaped = F.get("ms", F.lit(0))
    begun = first_gain(F.col("target"), shaped["integrated"], F.col("peak"))
    state = lambda step, n, done, failed, loud: F.struct(step["gain"].alias("gain"), step["ceiling"].alias("ceiling"), n.alias("attempts"), done.alias("done"), failed.alias("failed"), loud["integrated"].alias("integrated"), loud["heard"].alias("heard"), loud["spread"].alias("spread"))
    zero = state(begun, F.lit(0), F.lit(False), F.lit(False), shaped)

    def step(s: Column, x: Column) -> Column:
        new = next_gain(F.col("target"), F.col("peak"), s, x["integrated"], x["heard"], s["attempts"] + 1)
        kept = F.struct(F.when(new["done"], s["gain"]).otherwise(new["gain"]).alias("gain"), F.when(new["done"], s["ceiling"]).otherwise(new["ceiling"]).alias("ceiling"))
        return F.when(s["done"] | s["failed"], s).otherwise(state(kept, s["attempts"] + 1, new["done"], new["failed"], x))

    out = p.where(shaped["attempt"] == 0).withColumn("s", F.aggregate(F.slice("ms", F.lit(2), F.size("ms")), zero, step))
    s = F.col("s")
    heard = lambda c, n: F.when(s["attempts"] > 0, s[c]).alias(n)
    return out.select("rec_id", "name", s["gain"].alias("gain"), s["ceiling"].alias("ceiling"), s["attempts"].alias("attempts"), s["done"].alias("done"), s["failed"].alias("failed"), heard("integrated", "integrated"), heard("heard", "peak"), heard("spread", "spread"))


#: What the model has to answer.
ANSWER = answer(titles=["string"], long="string", short="string", chapters=[{"time": "string", "title": "string"}], passage="string", scripture=["string"], tags=["string"], hashtags=["string"])
SHORT_CHARS = 600
CHAPTERS = "array<struct<at:double,title:string>>"


def request(words: DataFrame, spans: DataFrame, facts: DataFrame) -> DataFrame:
    """``rec_id, prompt, request``: facts ``(rec_id, place, location, mission, date, speaker)`` and the talk's lines, timed
    from its start."""
    own = wd.relative(wd.within(words, spans), spans).withColumn("known", F.lit(None).cast("string"))
    fact = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c, F.lit("\n"))).otherwise("")
    head = F.concat(*[fact(label, F.col(c)) for label, c in (("Place", "place"), ("Where", "location"), ("What for", "mission"), ("Date", "date"), ("Speaker", "speaker"))], F.lit("\n"))
    return wd.prompt_lines(wd.lines(own, None)).join(facts, "rec_id").select("rec_id", F.lit("texts").alias("prompt"), F.concat(head, "lines").alias("request"))


def built(answers: DataFrame, spans: DataFrame, facts: DataFrame) -> DataFrame:
    """Answers ``(rec_id, answer)`` cleaned and put together: ``rec_id, titles, short, passage, scripture, tags, hashtags,
    chapters, body, text, adjustments`` and ``broken``, the first rule that the text breaks, else null.

    Chapters without a readable time go, and so do those that the rules for chapters drop; each is an adjustment.
    """
    clean, each = tx.without_angles, lambda c: F.transform(c, tx.without_angles)
    a = answers.select("rec_id", "answer.*")
    c = a.select("rec_id", F.posexplode("chapters").alias("pos", "c")).select("rec_id", F.col("pos").cast("bigint").alias("pos"), "c.time", clean(F.col("c.title")).alias("title")).withColumn("at", tc.parse_clock(F.col("time")))
    durations = spans.select("rec_id", (F.col("span_end") - F.col("span_start")).alias("duration"))
    valid = valid_chapters(c.where("at IS NOT NULL").select("rec_id", "pos", "at", "title"), durations).join(c.select("rec_id", "pos", F.col("at").alias("said")), ["rec_id", "pos"])
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    left_out = F.concat(F.lit("left out "), quoted(F.col("title")), F.lit(": "))
    no_time = c.where("at IS NULL").select("rec_id", F.lit(0).alias("kind"), F.col("pos").cast("double").alias("by"), F.concat(left_out, F.lit("no time "), quoted(F.col("time"))).alias("what"))
    dropped = valid.where("dropped IS NOT NULL").select("rec_id", F.lit(1).alias("kind"), F.col("said").alias("by"), F.concat(left_out, "dropped").alias("what"))
    moved = valid.where("place = 0 AND said <> 0").select("rec_id", F.lit(2).alias("kind"), F.lit(0.0).alias("by"), F.concat(quoted(F.col("title")), F.lit(" begins at 0:00 now, not at "), tc.clock(F.col("said"))).alias("what"))
    ordered = lambda fields, name: F.transform(F.array_sort(F.collect_list(F.struct(*fields))), lambda x: x[name])
    changes = no_time.unionByName(dropped).unionByName(moved).groupBy("rec_id").agg(ordered(("kind", "by", "what"), "what").alias("adjustments"))  # a recording's
    kept = valid.where("dropped IS NULL").groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "at", "title"))), lambda x: F.struct(x["at"].alias("at"), x["title"].alias("title"))).alias("kept"))
    out = a.join(kept, "rec_id", "left").join(changes, "rec_id", "left").join(facts, "rec_id")
    out = out.select(
        "rec_id", each("titles").alias("titles"), tx.limit_chars(clean(F.col("short")), SHORT_CHARS).alias("short"), clean(F.col("passage")).alias("passage"), each("scripture").alias("scripture"),
        valid_tags(F.col("tags")).alias("tags"), valid_hashtags(F.col("hashtags")).alias("hashtags"), F.coalesce("kept", F.array().cast(CHAPTERS)).alias("chapters"), clean(F.col("long")).alias("body"),
        F.coalesce("adjustments", F.array().cast("array<string>")).alias("adjustments"), "place", "location", "website",
    )
    out = out.withColumn("text", _assembled(F.col("chapters")))
    return out.withColumn("broken", broken_rule(F.col("chapters"), F.col("text")))


def _assembled(chapters: Column) -> Column:
    return assembled(F.col("body"), F.col("scripture"), chapters, F.col("hashtags"), F.col("place"), F.col("location"), F.col("website"))


def asked(words: DataFrame, spans: DataFrame, facts: DataFrame, asker: Asker, keep=lambda df, name: df) -> DataFrame:
    """Texts that the model writes, as ``built`` gives them, and ``error`` for a reply that can't be read.

    One that breaks a rule is asked for once more, with the rule; if that breaks one too, its chapters go, the text is
    cut to its limit, and the adjustments say so. ``facts`` also has ``website``.
    """
    first = keep(request(words, spans, facts), "requests")
    replies = keep(asker.ask(first, ANSWER), "replies")
    one = keep(built(replies.where("error IS NULL"), spans, facts), "texts-first")
    again = first.join(one.where("broken IS NOT NULL").select("rec_id", "broken"), "rec_id")
    again = again.select("rec_id", F.lit("texts/2").alias("prompt"), F.concat("request", F.lit("\n\nThe last answer can't be used: "), "broken", F.lit(". Mend that.")).alias("request"))
    two = built(keep(asker.ask(again, ANSWER), "again").where("error IS NULL"), spans, facts)
    both = one.withColumn("attempt", F.lit(1)).unionByName(two.withColumn("attempt", F.lit(2)))
    # the first that holds, else the last
    best = Window.partitionBy("rec_id").orderBy(F.col("broken").isNotNull(), F.when(F.col("broken").isNull(), F.col("attempt")).otherwise(-F.col("attempt")))
    out = both.withColumn("k", F.row_number().over(best)).where("k = 1")
    bad, none = F.col("broken").isNotNull(), F.array().cast(CHAPTERS)
    out = out.withColumn("adjustments", F.when(bad, F.array_append("adjustments", F.concat("broken", F.lit("; the chapters are left out")))).otherwise(F.col("adjustments")))
    out = out.withColumn("text", F.when(bad, trimmed_to(_assembled(none), DESCRIPTION_BYTES)).otherwise(F.col("text"))).withColumn("chapters", F.when(bad, none).otherwise(F.col("chapters")))
    failed = replies.where("error IS NOT NULL").select("rec_id", "error")
    return out.drop("k", "attempt", "broken", "place", "location", "website", "body").unionByName(failed, allowMissingColumns=True)


def short_description(short: Column, chapters: Column) -> Column:
    """Of an episode: its text, then its chapters, if it has any."""
    return F.concat(short, F.lit("\n"), F.when(F.size(chapters) > 0, F.concat(F.lit("\n"), chapter_list(chapters))).otherwise(""))
