"""Proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled within each source by a seeded hash; a row's fractional rank is (rank - offset) / rows of its source,
with a seeded offset in (0, 1) for each source. Sorted by that fraction, every stretch of the sequence holds the sources
in proportion, so cutting it into equal stretches gives shards that match the mixture, with row counts at most one
apart. The offset spreads sources that have one row, or equally many, over the whole sequence: with the same offset
all of them would fall into the same places.

Ranks come from counts: rows fall into hash (then fraction) buckets, a running sum over the bucket counts says how
many rows stand before a bucket, and only rows of one bucket are sorted together. No task holds a source. Rows that are
equal in id and text have one hash and share a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

SHARDS = 16
SEED = 20240607
BUCKET_ROWS = 1000
MOST_BITS = 16


def bucket_bits(rows: int) -> int:
    """Bits of a bucket number: buckets of about ``BUCKET_ROWS``, of which there are at most 65,536."""
    return min(MOST_BITS, max(1, (rows // BUCKET_ROWS).bit_length()))


def _numbered(df: DataFrame, group: list[str], bucket: str, order: list[str | Column], rank: str, total: str | None = None) -> DataFrame:
    """Adds the number (from 1) of each row within ``group`` in the order of ``bucket``, then ``order``."""
    counts = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*group).orderBy(bucket)
    before = counts.withColumn("__before", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n"))
    if total:
        before = before.withColumn(total, F.sum("__n").over(Window.partitionBy(*group)))
    within = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    return df.join(before.drop("__n"), [*group, bucket]).withColumn(rank, F.col("__before") + within).drop("__before", bucket)


def sharded(docs: DataFrame, *, keep: list[str], source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` with ``size, text_crc32, shard, slot``.

    Null texts count as empty (size 1), null sources are a source of their own, rows with equal ids and texts are
    ordered arbitrarily among themselves (their results are interchangeable). Fewer rows than shards leave shards
    empty; an empty table gives no rows. The texts are read once and never shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = written(
        docs.select(
            *[F.col(k).alias(f"k_{k}") for k in keep],
            F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string"))).alias("__source"),
            F.xxhash64(F.lit(seed), F.col(id_col), text).alias("__key"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "shard-rows",
    )
    rows = slim.count()
    bits = bucket_bits(rows)
    tie = ["__key", *(f"k_{k}" for k in keep), "text_crc32"]
    ranked = _numbered(slim.withColumn("__bucket", F.shiftrightunsigned("__key", 64 - bits)), ["__source"], "__bucket", tie, "__rank", "__rows")
    # 52 bits of a hash, never 0 or 1
    offset = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("offset"), "__source"), 12) + 0.5) / float(1 << 52)
    ranked = written(ranked.withColumn("__share", (F.col("__rank") - offset) / F.col("__rows")), "shard-ranks")
    ranked = ranked.withColumn("__slice", F.least(F.floor(F.col("__share") * (1 << bits)), F.lit((1 << bits) - 1)))
    placed = _numbered(ranked.withColumn("__all", F.lit(0)), ["__all"], "__slice", ["__share", "__source", *tie], "__place")
    n = F.lit(max(rows, 1)).cast("long")
    at = F.col("__place") - 1
    shard = F.expr(f"(__place - 1) * {shards} div {max(rows, 1)}")
    first = F.expr(f"(((__place - 1) * {shards} div {max(rows, 1)}) * {max(rows, 1)} + {shards - 1}) div {shards}")
    return placed.where(n > 0).select(*[F.col(f"k_{k}").alias(k) for k in keep], "size", "text_crc32", shard.cast("int").alias("shard"), (at - first).alias("slot"))


def op2_stratified_interleaving(docs: DataFrame) -> DataFrame:
    """Digest per document under the law ``rows``: shards' row counts are at most one apart."""
    out = sharded(docs, keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
