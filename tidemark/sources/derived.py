"""Domain tables from general ones (documents, events, conversations, embeddings): the same rules in Spark and in SQL.

Times come from whole milliseconds and are divided last, so that both agree in every digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.sources import tables

WORD = r"[^\x20\x09-\x0D]+"


def word_times(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """``rec_id, idx, text, start_ms, end_ms``: a document's words, timed by their lengths, with pauses after sentences
    and a long one after each 397th word.

    Documents are dealt out by recording before they become words, which are many times their size: what follows
    works by recording and needs no further shuffle. Parts, as many as the documents' size asks for unless given, are
    small enough that a task sorts its words in memory.
    """
    by_rec = documents.select(F.col("doc_id").alias("rec_id"), "text").repartition(parts or tables.parts_of(documents), "rec_id")
    w = by_rec.select("rec_id", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("idx", "text"))
    dur = spoken_ms(F.col("text"))
    pause = F.when(F.col("idx") % 397 == 396, 3000).when(F.col("text").rlike("[.?!]$"), 700).otherwise(40)
    by = Window.partitionBy("rec_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("dur", dur).withColumn("step", dur + pause)
    start = F.coalesce(F.sum("step").over(by), F.lit(0))
    return w.select("rec_id", "idx", "text", start.alias("start_ms"), (start + F.col("dur")).alias("end_ms"))


def spoken_ms(text: Column) -> Column:
    return F.least(F.lit(1000), 80 + 65 * F.length(text))


def words(documents: DataFrame) -> DataFrame:
    w = word_times(documents)
    return w.select("rec_id", "idx", "text", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))


def stored_words(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """``words`` written once by recording, for those that read them several times; ends follow from starts and texts."""
    parts = parts or tables.parts_of(documents)
    w = tables.by_recording(word_times(documents, parts).drop("end_ms"), "words", "idx", dealt=parts)
    return w.select("rec_id", "idx", "text", (F.col("start_ms") / 1000).alias("start"), ((F.col("start_ms") + spoken_ms(F.col("text"))) / 1000).alias("end"))


WORDS_SQL = rf"""
wt0 AS (SELECT doc_id AS rec_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents),
wt1 AS (SELECT rec_id, i - 1 AS idx, ws[i] AS text FROM (SELECT rec_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM wt0)),
wt2 AS (SELECT *, least(1000, 80 + 65 * length(text)) AS dur, CASE WHEN idx % 397 = 396 THEN 3000 WHEN regexp_matches(text, '[.?!]$') THEN 700 ELSE 40 END AS pause FROM wt1),
wt AS (SELECT rec_id, idx, text, dur, coalesce(sum(dur + pause) OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM wt2),
words AS (SELECT rec_id, idx, text, start_ms, start_ms + dur AS end_ms, start_ms / 1000.0 AS "start", (start_ms + dur) / 1000.0 AS "end" FROM wt)
"""


def looped(documents: DataFrame) -> DataFrame:
    """Documents in which every fourth begins with its first six words said four times over."""
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, 6), " ")
    return documents.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.repeat(F.concat(head, F.lit(". ")), F.lit(4)), "text")).otherwise(F.col("text")))


LOOPED_WORDS_SQL = rf"""
lo0 AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}')[1:6] AS h FROM documents),
lo AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN repeat(array_to_string(h, ' ') || '. ', 4) || text ELSE text END AS text FROM lo0),
""" + WORDS_SQL.replace("FROM documents", "FROM lo").lstrip()


def asr_tokens(documents: DataFrame) -> DataFrame:
    """Recognizer tokens of the words: each in one or two pieces, some without an aligned time, special ones before each 50th."""
    w = word_times(documents).withColumn("seg", F.floor(F.col("idx") / 50).cast("int")).withColumn("half", F.ceil(F.length("text") / 2).cast("int"))
    # a row for each kind of token, then what it is, so that no array of tokens is made
    kind = F.col("kind")
    t = w.select("*", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("kind")).where(F.when(kind == -1, F.col("idx") % 50 == 0).when(kind == 0, F.lit(True)).otherwise(F.length("text") > F.col("half")))
    text = F.when(kind == -1, F.lit("[_BEG_]")).when(kind == 0, F.concat(F.lit(" "), F.expr("substring(text, 1, half)"))).otherwise(F.expr("substring(text, half + 1)"))
    dtw = F.when((kind != 0) | (F.col("idx") % 7 == 0), -1).otherwise(F.floor(F.col("start_ms") / 10)).cast("int")
    return t.select("rec_id", "seg", (F.col("idx") * 3 + kind).alias("pos"), text.alias("text"), dtw.alias("t_dtw"), F.col("start_ms").cast("int").alias("offset_ms"))


#: Words of a speech region; two regions are a chunk, and six seconds of silence are before each chunk.
REGION_WORDS, SILENCE_MS = 40, 6000


def speech(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a detector and a recognizer make of the words: ``regions (rec_id, log)`` and chunks ``(rec_id, chunk,
    transcription)`` as first heard and as heard again.

    In every fourth chunk the first transcription says one sentence four times in place of the chunk's first second
    half; of these, every other one is heard again without that, and the rest loops in the same way. Every fifth chunk
    has a word timed past its end.
    """
    w = word_times(documents).withColumn("chunk", F.floor(F.col("idx") / (2 * REGION_WORDS)).cast("int"))
    w = w.withColumn("at", F.col("start_ms") + SILENCE_MS * F.col("chunk")).withColumn("till", F.col("end_ms") + SILENCE_MS * F.col("chunk"))
    r = w.groupBy("rec_id", F.floor(F.col("idx") / REGION_WORDS).alias("r")).agg(F.min("at").alias("a"), F.max("till").alias("b"))
    line = F.format_string("start = %d.%d0, end = %d.%d0", *[x for c in ("a", "b") for x in (F.floor(F.col(c) / 10).cast("long"), (F.col(c) % 10).cast("long"))])
    regions = r.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), "\n").alias("log"))
    token = lambda text, ms: F.struct(text.alias("text"), F.lit(-1).alias("t_dtw"), F.struct(ms.cast("int").alias("from"), ms.cast("int").alias("to")).alias("offsets"))
    by = Window.partitionBy("rec_id", "chunk")
    own = w.withColumn("zero", F.greatest(F.lit(0), F.min("at").over(by) - 300)).withColumn("ms", F.col("at") - F.col("zero"))
    c = own.groupBy("rec_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", token(F.concat(F.lit(" "), "text"), F.col("ms")).alias("t")))).alias("ws"), F.max(F.col("till") - F.col("zero")).alias("length"))
    plain = F.transform("ws", lambda x: x["t"])
    late = F.when(F.col("chunk") % 5 == 1, F.array(token(F.lit(" late"), F.col("length") + 900))).otherwise(F.array())
    looped = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: token(F.concat(F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in LOOP.split()]), (k % 5 + 1).cast("int"))), k * 40))
    loop = F.concat(looped, F.filter(plain, lambda t: t["offsets"]["from"] >= 1000))
    segment = lambda tokens: F.array(F.struct(F.lit("").alias("text"), F.concat(tokens, late).alias("tokens")))
    k = F.col("rec_id") + F.col("chunk")
    heard = c.select("rec_id", "chunk", segment(F.when(k % 4 == 0, loop).otherwise(plain)).alias("transcription"))
    again = c.where(k % 4 == 0).select("rec_id", "chunk", segment(F.when(k % 8 == 0, plain).otherwise(loop)).alias("transcription"))
    return regions, heard, again


LOOP = "and so it goes on."
#: Seconds past a chunk's end at which the SQL still has words: a loop of ``speech`` begins its last one up to 0.315 s after
#: the end of a chunk of one short word. Those that it has not begin 0.6 s after.
LATE = 0.5

SPEECH_SQL = WORDS_SQL.rstrip() + f""",
sp0 AS (SELECT *, idx // {2 * REGION_WORDS} AS chunk, start_ms + {SILENCE_MS} * (idx // {2 * REGION_WORDS}) AS a_ms, end_ms + {SILENCE_MS} * (idx // {2 * REGION_WORDS}) AS till FROM words),
sp AS (SELECT *, a_ms - zero AS ms, (rec_id + chunk) % 8 = 4 AS loops FROM (SELECT *, greatest(0, min(a_ms) OVER (PARTITION BY rec_id, chunk) - 300) AS zero, max(till) OVER (PARTITION BY rec_id, chunk) + 300 AS ende FROM sp0)),
hd AS (SELECT rec_id, chunk, idx AS k, text, ms, zero, ende FROM sp WHERE NOT loops OR ms >= 1000
 UNION ALL SELECT DISTINCT rec_id, chunk, -20 + i, string_split('{LOOP}', ' ')[i % 5 + 1], i * 40, zero, ende FROM sp, range(20) t(i) WHERE loops),
hw AS (SELECT *, least(1000, 80 + 65 * length(text)) AS dur, lead(ms) OVER (PARTITION BY rec_id, chunk ORDER BY k) AS next_ms FROM hd WHERE regexp_matches(text, '[\\p{{L}}\\p{{Nd}}]'))
"""


def turns(events: DataFrame) -> DataFrame:
    """A day's events as a recording's turns: 24 hours in 24 minutes, three speakers."""
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    e = events.select(F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("bigint").alias("rec_id"), F.floor(seconds * 1000 / 60).alias("a"), (500 + F.col("event_id") % 50 * 100).alias("d"), F.concat(F.lit("speaker_"), (F.col("user_id") % 3).cast("string")).alias("speaker"), "event_id")
    by = Window.partitionBy("rec_id").orderBy("a", "d", "speaker", "event_id")
    return e.select("rec_id", (F.row_number().over(by) - 1).alias("idx"), (F.col("a") / 1000).alias("start"), ((F.col("a") + F.col("d")) / 1000).alias("end"), "speaker")


TURNS_SQL = """
tu0 AS (SELECT date_diff('day', DATE '2020-01-01', CAST(ts AS DATE))::BIGINT AS rec_id, floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000 / 60)::BIGINT AS a, 500 + event_id % 50 * 100 AS d, 'speaker_' || (user_id % 3) AS speaker, event_id FROM events),
turns AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY a, d, speaker, event_id) - 1 AS idx, a / 1000.0 AS "start", (a + d) / 1000.0 AS "end", speaker FROM tu0)
"""


def turn_points(events: DataFrame) -> DataFrame:
    """A moment of each event, shifted off its start."""
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return events.select(F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("bigint").alias("rec_id"), F.col("event_id").alias("point_id"), ((F.floor(seconds * 1000 / 60) + F.col("event_id") % 7 * 1300) / 1000).alias("t"))


POINTS_SQL = """
points AS (SELECT date_diff('day', DATE '2020-01-01', CAST(ts AS DATE))::BIGINT AS rec_id, event_id AS point_id, (floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000 / 60)::BIGINT + event_id % 7 * 1300) / 1000.0 AS t FROM events)
"""


def turn_spans(turns_: DataFrame) -> DataFrame:
    """The middle of each recording: from a tenth to nine tenths of its last start."""
    m = turns_.groupBy("rec_id").agg(F.max(F.round(F.col("start") * 1000).cast("long")).alias("m"))
    return m.select("rec_id", (F.floor(F.col("m") / 10) / 1000).alias("span_start"), (F.floor(F.col("m") * 9 / 10) / 1000).alias("span_end"))


SPANS_SQL = """
spans AS (SELECT rec_id, floor(m / 10) / 1000.0 AS span_start, floor(m * 9 / 10) / 1000.0 AS span_end FROM (SELECT rec_id, max(CAST(round("start" * 1000) AS BIGINT)) AS m FROM turns GROUP BY rec_id))
"""


def speakers_known(words_: DataFrame) -> DataFrame:
    """Words with a speaker by position, and stretches without one."""
    who = F.when(F.floor(F.col("idx") / 23) % 4 == 3, F.lit(None)).otherwise(F.concat(F.lit("S"), (F.floor(F.col("idx") / 61) % 3).cast("string")))
    return words_.withColumn("known", who)


#: Letters by which documents are looked up for phrases.
HEAD_LETTERS = 12


def phrases(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each benchmark text as a phrase to find in each document in which a word begins with its first letters (as many as
    12, run on over the next words, of normal forms), near its middle."""
    b = benchmark.select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"), F.substring(tx.normal(F.col("text")), 1, HEAD_LETTERS).alias("head"))
    b = b.where("head <> ''").withColumn("letters", F.length("head"))
    own = documents.select(F.col("doc_id").alias("rec_id"), F.array_remove(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), tx.normal), "").alias("w")).where(F.size("w") > 0)
    heads = F.array_distinct(F.transform("w", lambda _, i: F.substring(F.array_join(F.slice("w", i + 1, HEAD_LETTERS), ""), 1, HEAD_LETTERS)))
    each = own.select("rec_id", F.explode(heads).alias("long")).join(F.broadcast(b.select("letters").distinct()))  # 12 at most
    found = each.select("rec_id", F.substring("long", F.lit(1), F.col("letters")).alias("head")).join(b, "head").select("rec_id", "phrase_id", "phrase").distinct()
    return found.select("*", F.lit(100.0).alias("near"), F.lit(1e6).alias("window"))


def with_whole_references(pages: DataFrame) -> DataFrame:
    """Pages in which an ampersand that begins no whole reference, up to its semicolon, is text, as it is in the SQL.
    Browsers also read some references without their semicolon, and so does ``web.parsed``."""
    return pages.withColumn("html", F.regexp_replace("html", "&(?!#?[A-Za-z0-9]+;)", "&amp;"))


def face_frames(embeddings: DataFrame) -> DataFrame:
    """Frames every seven seconds: two faces and one box of text from components."""
    e = lambda k: F.abs(F.col("embedding")[k].cast("double"))
    box = lambda k: F.struct(e(k).alias("x"), e(k + 1).alias("y"), e(k + 2).alias("w"), e(k + 3).alias("h"))
    face = lambda k: F.struct(box(k).alias("box"), e(k + 4).alias("quality"))
    return embeddings.select(F.col("label").cast("bigint").alias("rec_id"), (F.col("vec_id") * 7.0).alias("t"), F.array(face(0), face(5)).alias("faces"), F.array(box(10)).alias("text"))


def tracks(embeddings: DataFrame) -> DataFrame:
    """One clip for each vector: 64 sampled frames at 10 a second with two places each, some empty."""
    places = F.transform("embedding", lambda v: (F.tanh(v.cast("double")) + 1) / 2)
    t = embeddings.select(F.col("vec_id").alias("rec_id"), places.alias("all"), F.posexplode(places).alias("i", "x"))
    other = F.get("all", (F.col("i") + 7) % 64)
    return t.select("rec_id", (F.col("i") / 10).alias("t"), F.when(F.col("i") % 9 == 8, F.array().cast("array<double>")).otherwise(F.array("x", other)).alias("xs"))


def turns_of_words(words_: DataFrame) -> DataFrame:
    """Turns of three speakers, each 150 words in order."""
    k = F.floor(F.col("idx") / 150)
    return words_.groupBy("rec_id", k.alias("idx")).agg(F.min("start").alias("start"), F.max("end").alias("end")).select("rec_id", "idx", "start", "end", F.concat(F.lit("speaker_"), F.pmod(F.floor(F.col("idx") / 3), F.lit(2)).cast("string")).alias("speaker"))
