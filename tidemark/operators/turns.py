"""Operators on speaker turns: ``turns(rec_id, idx, start, end, speaker)``, in order of start unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import timecode as tc

UNCLEAR = "(unclear)"
MERGE_GAP, LEAST_SECONDS, FILL_GAP = 1.5, 2.0, 60.0


def by_start() -> WindowSpec:
    return Window.partitionBy("rec_id").orderBy("start", "end", "speaker")


def clean(turns: DataFrame, gap: float = MERGE_GAP, least: float = LEAST_SECONDS) -> DataFrame:
    """Turns of one speaker less than ``gap`` apart are merged, then those shorter than ``least`` go.

    Another speaker's turn in between prevents a merge, even one that goes later.
    """
    t = turns.withColumn("new", F.coalesce(F.lag("speaker").over(by_start()) != F.col("speaker"), F.lit(True)).cast("int"))
    t = t.withColumn("run", F.sum("new").over(by_start()))
    in_run = Window.partitionBy("rec_id", "run").orderBy("start", "end", "speaker")
    so_far = F.max("end").over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("part", F.sum((F.col("start") - so_far >= gap).cast("int")).over(in_run)).withColumn("part", F.coalesce("part", F.lit(0)))
    merged = t.groupBy("rec_id", "run", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("speaker").alias("speaker"))
    kept = merged.where(F.col("end") - F.col("start") >= least)
    return kept.select("rec_id", (F.row_number().over(by_start()) - 1).alias("idx"), "start", "end", "speaker")


#: Seconds of a bin: what may overlap in time meets by equality of recording and bin.
BIN = 16.0


def bins(start: Column, end: Column, width: float = BIN) -> Column:
    """The bins that a span touches, its end included."""
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def _first_open(turns: DataFrame) -> Column:
    """When a turn begins to be the first of those that contain a moment, which ends with it; null if never.

    Turns are numbered by their starts, so only one that ends later than all before it can be the first, and it is from
    its start or from the last of their ends on.
    """
    there = (F.col("end") > F.col("start")) & F.col("rec_id").isNotNull()
    before = F.max(F.when(there, F.col("end"))).over(Window.partitionBy("rec_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return F.when(there & (before.isNull() | (F.col("end") > before)), F.greatest("start", before))  # greatest skips nulls


def _along(points: DataFrame, marks: DataFrame, *names: str) -> DataFrame:
    """Points with the last mark of each name at or before them: ``marks (rec_id, t, t1, speaker, *names)`` and points go
    along time together, in one pass however many turns there are at a time."""
    own = points.select("rec_id", "t", F.lit(1).alias("kind"), F.struct(*[c for c in points.columns if c not in ("rec_id", "t")]).alias("point"))
    order = Window.partitionBy("rec_id").orderBy("t", "kind", "t1", "speaker").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.withColumn("kind", F.lit(0)).unionByName(own.repartition("rec_id"), allowMissingColumns=True)
    both = both.select("rec_id", "t", "kind", "point", *[F.last(n, ignorenulls=True).over(order).alias(n) for n in names]).where("kind = 1")
    return both.select(*[F.col(c) if c in ("rec_id", "t") else F.col(f"point.{c}").alias(c) for c in points.columns], *names)


def _speaker_at() -> Column:
    return F.when(F.col("t") < F.col("open.till"), F.col("open.speaker"))


def at(points: DataFrame, turns: DataFrame) -> DataFrame:
    """Points ``(rec_id, point_id, t)`` with ``at``: the speaker of the first turn that contains each, else null."""
    first = turns.select("rec_id", _first_open(turns).alias("t"), F.struct(F.col("end").alias("till"), "speaker").alias("open")).where(F.col("t").isNotNull())
    first = first.select("rec_id", "t", F.lit(None).cast("double").alias("t1"), F.lit(None).cast("string").alias("speaker"), "open")
    return _along(points, first, "open").select(*[F.col(c) for c in points.columns], _speaker_at().alias("at"))


def speaking(points: DataFrame, turns: DataFrame, gap: float = FILL_GAP) -> DataFrame:
    """Points with ``speaker``: who speaks there; in a silence of at most ``gap`` seconds between two turns of one
    speaker, that one; else null. A turn is passed twice: where it starts, and where it begins to be the first that is open."""
    t = turns.select("rec_id", "start", "end", "speaker", _first_open(turns).alias("from"), F.lead("start").over(by_start()).alias("next_start"), F.lead("speaker").over(by_start()).alias("after"))
    turn = F.struct(F.col("end").alias("t1"), F.col("speaker").alias("before"), "next_start", "after")
    opened = F.struct(F.col("end").alias("till"), "speaker")
    starts = F.struct(F.col("start").alias("t"), F.col("end").alias("t1"), "speaker", turn.alias("turn"), F.when(F.col("from") <= F.col("start"), opened).alias("open"))
    opens = F.when(F.col("from") > F.col("start"), F.struct(F.col("from").alias("t"), F.lit(None).cast("double").alias("t1"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast(TURN).alias("turn"), opened.alias("open")))
    marks = t.select("rec_id", F.explode(F.array_compact(F.array(starts, opens))).alias("m")).select("rec_id", "m.*")
    silent = (F.col("turn.before") == F.col("turn.after")) & (F.col("t") < F.col("turn.next_start")) & (F.col("turn.next_start") - F.col("turn.t1") <= gap)
    return _along(points, marks, "turn", "open").select(*[F.col(c) for c in points.columns], F.coalesce(_speaker_at(), F.when(silent, F.col("turn.before"))).alias("speaker"))


TURN = "struct<t1:double,before:string,next_start:double,after:string>"


def talk_time(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """``rec_id, speaker, seconds`` inside each recording's span ``(rec_id, span_start, span_end)``."""
    shared = tc.overlap(F.col("start"), F.col("end"), F.col("span_start"), F.col("span_end"))
    return turns.join(spans, "rec_id").groupBy("rec_id", "speaker").agg(F.sum(shared).alias("seconds"))


def main_speaker(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """``rec_id, main``: who speaks longest in the span, the smaller name of equals; no row if nobody does."""
    best = Window.partitionBy("rec_id").orderBy(F.col("seconds").desc(), "speaker")
    t = talk_time(turns, spans).where(F.col("seconds") > 0).withColumn("k", F.row_number().over(best))
    return t.where("k = 1").select("rec_id", F.col("speaker").alias("main"))


def others(turns: DataFrame, spans: DataFrame, mains: DataFrame) -> DataFrame:
    """Turns in the span of others than the main speaker ``(rec_id, main)``."""
    t = turns.join(spans, "rec_id").join(mains, "rec_id", "left")
    return t.where((tc.overlap(F.col("start"), F.col("end"), F.col("span_start"), F.col("span_end")) > 0) & ~F.col("speaker").eqNullSafe(F.col("main"))).select(turns.columns)


def neutral_names(turns: DataFrame) -> DataFrame:
    """``rec_id, speaker, name``: "Speaker 1" for who speaks most, and so on; names decide between equals."""
    total = turns.groupBy("rec_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))
    k = F.row_number().over(Window.partitionBy("rec_id").orderBy(F.col("seconds").desc(), "speaker"))
    return total.select("rec_id", "speaker", F.concat(F.lit("Speaker "), k.cast("string")).alias("name"))


def names_with_main(turns: DataFrame, mains: DataFrame, role: str = "Preacher") -> DataFrame:
    """``rec_id, speaker, name``: the main speaker by role, others by first appearance, from 2, or from 1 without a main one."""
    first = turns.groupBy("rec_id", "speaker").agg(F.min("idx").alias("first")).join(mains, "rec_id", "left")
    is_main = F.col("speaker").eqNullSafe(F.col("main"))
    k = F.row_number().over(Window.partitionBy("rec_id", is_main).orderBy("first"))
    number = k + F.when(F.col("main").isNull(), 0).otherwise(1)
    return first.select("rec_id", "speaker", F.when(is_main, F.lit(role)).otherwise(F.concat(F.lit("Speaker "), number.cast("string"))).alias("name"))


def labelled(points: DataFrame, turns: DataFrame, names: DataFrame, unclear: str = UNCLEAR) -> DataFrame:
    """Points with ``label``: the name of who speaks there, or ``unclear``."""
    own = names.groupBy("rec_id").agg(F.collect_list(F.struct("speaker", "name")).alias("__names"))  # a recording's; points stay where they are
    name = F.get(F.filter("__names", lambda n: n["speaker"] == F.col("speaker")), F.lit(0))["name"]
    return speaking(points, turns).join(own, "rec_id", "left").withColumn("label", F.coalesce(name, F.lit(unclear))).drop("__names")


def known_speakers(words: DataFrame, turns: DataFrame, names: DataFrame) -> DataFrame:
    """Words with ``known``, the name of who speaks as each begins, or null: the input of ``words.lines``."""
    points = words.select("rec_id", F.col("idx").alias("point_id"), F.col("start").alias("t"))
    who = speaking(points, turns).join(names, ["rec_id", "speaker"], "left").select("rec_id", F.col("point_id").alias("idx"), F.col("name").alias("known"))
    return words.join(who, ["rec_id", "idx"], "left")


def overlaps_any(start: Column, end: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: tc.overlap(start, end, s["start"], s["end"]) > 0)
