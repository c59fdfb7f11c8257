"""Scoring detected spans against hand labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timecode as tc


def errors(spans: DataFrame, labels: DataFrame) -> DataFrame:
    """``rec_id, start_error, end_error`` (detected less labelled) of labelled recordings with a detected span."""
    a = spans.select("rec_id", F.col("start").alias("s"), F.col("end").alias("e"))
    b = labels.select("rec_id", F.col("start").alias("s0"), F.col("end").alias("e0"))
    return a.join(b, "rec_id").where(F.col("s").isNotNull() & F.col("e").isNotNull()).select("rec_id", (F.col("s") - F.col("s0")).alias("start_error"), (F.col("e") - F.col("e0")).alias("end_error"))


def labelled(labels: DataFrame) -> DataFrame:
    """``recording, start, end, wrong`` of labels with clocks as texts ``(recording, start, end)``: seconds, or why they
    can't be used."""
    given = labels.select("recording", F.col("start").alias("a"), F.col("end").alias("b"))
    wrong = F.coalesce(tc.override(F.col("a"), F.col("b")), F.when((F.coalesce("a", F.lit("")) == "") & (F.coalesce("b", F.lit("")) == ""), F.lit("start and end must be given")))
    return given.select("recording", F.when(wrong.isNull(), tc.parse_clock(F.col("a"))).alias("start"), F.when(wrong.isNull(), tc.parse_clock(F.col("b"))).alias("end"), wrong.alias("wrong"))


def compared(talks: DataFrame, recordings: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each label: ``recording, rec_id, start_error, end_error, failed``, with ``talks (rec_id, start, end, error)``
    of ``recordings (rec_id, file)``. A recording whose talk wasn't found, or that no run has, has no errors but a reason;
    the others are compared all the same. A label that can't be used is an error of the whole comparison, as it says
    nothing about any talk."""
    l = labelled(labels)  # noqa: E741
    unusable = F.raise_error(F.concat("recording", F.lit(": "), "wrong"))
    l = l.withColumn("start", F.when(F.col("wrong").isNotNull(), unusable.cast("double")).otherwise(F.col("start"))).drop("wrong")  # noqa: E741
    r = recordings.select("rec_id", F.col("file").alias("recording")).join(talks.select("rec_id", F.col("start").alias("s"), F.col("end").alias("e"), "error"), "rec_id", "left")
    out = l.join(r, "recording", "left")
    failed = F.when(F.col("rec_id").isNull(), F.lit("no run has it")).when(F.col("error").isNotNull(), F.col("error")).when(F.col("s").isNull() | F.col("e").isNull(), F.lit("it has no talk"))
    return out.select("recording", "rec_id", F.when(failed.isNull(), F.col("s") - F.col("start")).alias("start_error"), F.when(failed.isNull(), F.col("e") - F.col("end")).alias("end_error"), failed.alias("failed"))


def summary(errors_: DataFrame) -> DataFrame:
    """One row: how many have errors, and the means of what these are off."""
    return errors_.agg(F.count("start_error").alias("n"), F.avg(F.abs("start_error")).alias("start_mae"), F.avg(F.abs("end_error")).alias("end_mae"))
