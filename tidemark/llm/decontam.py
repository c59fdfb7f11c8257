"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words. Patterns (windows of ten consecutive item words) are grouped by length; each group has a
shift table over blocks of two words: a block that no pattern holds skips as far as a pattern can reach. A block
that ends some pattern has shift zero and selects the bucket of patterns with that suffix, which are compared
directly.

A benchmark of up to ``block_windows`` windows is searched in one pass over the texts. A larger one is cut into blocks
of so many, and each block has a pass of its own, in which a task builds its tables once; the next block is sent when
the last one has been taken back. So neither a task nor the driver ever holds more than one block, and passes grow with
the benchmark. What a pass finds is known by 128-bit hashes of the texts, and is little, unless most texts are hit.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator
from hashlib import sha256

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import alnum_words, map_rows, schema_of, values, written

WINDOW_WORDS = 10
BLOCK_WINDOWS = 100_000


def windows_of(words: list[bytes], size: int = WINDOW_WORDS) -> list[tuple[bytes, ...]]:
    """Windows of ``size`` consecutive words; fewer words, but not none, are one window."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Finds all occurrences of word patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], dict[str, None]], length: int):
        self.length, self.block = length, min(2, length)
        self.reach = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[tuple[bytes, ...], dict[str, None]]] = {}
        for pattern, ids in patterns.items():
            for end in range(self.block, length + 1):
                key = b" ".join(pattern[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.reach), length - end)
            self.buckets.setdefault(b" ".join(pattern[length - self.block :]), {})[pattern] = ids

    def scan(self, words: list[bytes]):
        """(start, ids) of each occurrence, in order."""
        at, n, shift, reach, m = self.length - 1, len(words), self.shift, self.reach, self.length
        pair = self.block == 2
        while at < n:
            key = words[at - 1] + b" " + words[at] if pair else words[at]
            skip = shift.get(key, reach)
            if skip:
                at += skip
                continue
            ids = self.buckets[key].get(tuple(words[at - m + 1 : at + 1]))
            if ids is not None:
                yield at - m + 1, ids
            at += 1


def build(items: list[tuple[str | None, tuple[bytes, ...]]]) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], dict[str, None]]] = {}
    for item, window in items:
        ids = by_length.setdefault(len(window), {}).setdefault(window, {})
        if item is not None:
            ids[item] = None
    return [WuManber(found, length) for length, found in sorted(by_length.items())]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_windows: int) -> Iterator[list]:
    """Blocks of (item id, window), one at a time: the driver reads the benchmark a partition at a time."""
    block = []
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        for window in windows_of(alnum_words(text.encode() if text else None)):
            block.append((item, window))
            if len(block) >= block_windows:
                yield block
                block = []
    if block:
        yield block


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = "array<struct<start:bigint,end:bigint>>"
#: Names a text in the passes over blocks.
KEY = ["__t1", "__t2"]


def searched(docs: DataFrame, block: Broadcast | None, *, keep: list[str], read: str) -> DataFrame:
    """The columns ``keep`` with ``n_words, spans, item_ids`` of what the block's windows hit; tables are built once a task."""
    out = schema_of(docs, *keep, more=f"n_words bigint, spans {SPANS}, item_ids array<string>")

    def make():
        searchers = build(block.value) if block else []

        def fn(batch):
            n_words, spans, items = [], [], []
            for text in values(batch.column(read), binary=True):
                own = alnum_words(text)
                hits, owners = [], {}  # a window's items are looked at once, however often it is there
                for s in searchers:
                    for start, found in s.scan(own):
                        hits.append((start, start + s.length))
                        owners[id(found)] = found
                n_words.append(len(own))
                spans.append([{"start": a, "end": b} for a, b in merged(hits)])
                items.append(sorted(set().union(*owners.values())))
            return {k: batch.column(k) for k in keep} | {"n_words": n_words, "spans": spans, "item_ids": items}

        return fn

    return map_rows(docs, make, out)


def _runs(spans: Column) -> Column:
    """Maximal runs of an array of sorted or unsorted spans."""
    empty = F.array().cast(SPANS)
    last = lambda s: F.element_at(s, -1)

    def add(s: Column, x: Column) -> Column:
        joined = F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(last(s)["start"].alias("start"), F.greatest(last(s)["end"], x["end"]).alias("end"))))
        return F.when((F.size(s) > 0) & (x["start"] <= F.try_element_at(s, F.lit(-1))["end"]), joined).otherwise(F.array_append(s, x))

    return F.aggregate(F.array_sort(spans), empty, add)


def contamination(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns ``keep`` of every document with ``n_words, n_hit, n_items, item_ids, spans, contaminated``.

    ``spans`` are maximal runs of hit words (start, end exclusive). Null or empty texts have no words and are clean.
    An item with a null id still hits words but is not listed. Repeated rows and items each give their own result;
    an empty benchmark leaves every document clean. Map-only over the documents for a benchmark of up to
    ``block_windows`` windows; beyond, what the passes found is joined by hashes of the texts.
    """
    spark = docs.sparkSession
    read = text_col if text_col in keep else "__text"
    own = docs.select(*keep, *([] if read in keep else [F.col(text_col).cast("string").alias(read)]))
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_windows)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        found = searched(own, spark.sparkContext.broadcast(first) if first else None, keep=keep, read=read)
    else:
        found = _in_passes(own, itertools.chain([first, second], blocks), keep, read)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(*keep, "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), "item_ids", "spans", (F.size("spans") > 0).alias("contaminated"))


def _in_passes(docs: DataFrame, blocks: Iterable[list], keep: list[str], read: str) -> DataFrame:
    spark = docs.sparkSession
    keyed = docs.withColumns({"__t1": F.xxhash64(read), "__t2": F.xxhash64(F.lit(1), read)})
    hits = []
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)
        hit = searched(keyed.select(*KEY, read), sent, keep=KEY, read=read).where(F.size("spans") > 0)
        hits.append(written(hit.drop("n_words"), "decontam-hits"))
        sent.destroy()
    # equal texts were hit alike: one row of a text and block is enough
    every = functools.reduce(DataFrame.unionByName, [h.dropDuplicates(KEY) for h in hits])
    of_text = every.groupBy(KEY).agg(_runs(F.flatten(F.collect_list("spans"))).alias("__s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("__i"))
    counted = searched(keyed, None, keep=[*keep, *(k for k in KEY)], read=read).drop("spans", "item_ids")
    out = counted.join(written(of_text, "decontam-texts"), KEY, "left")
    none = lambda kind: F.array().cast(kind)
    return out.select(*keep, "n_words", F.coalesce("__s", none(SPANS)).alias("spans"), F.coalesce("__i", none("array<string>")).alias("item_ids"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a benchmark window, with all their columns."""
    own = [f"k_{c}" for c in docs.columns]
    found = contamination(docs.toDF(*own), benchmark, keep=own, text_col=f"k_{text_col}", **options)
    return found.where(~F.col("contaminated")).select(*own).toDF(*docs.columns)


def op10_wu_manber(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest per document; see ``contamination``."""
    found = contamination(docs, benchmark, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def items_digest(ids: list[str]) -> str:
    return sha256(",".join(sorted(ids)).encode()).hexdigest()


#: Words with positions, item windows, and the positions that some occurrence covers.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS pat
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM p),
o AS (SELECT rid, i, m, array_to_string(w[i : i + m - 1], ' ') AS pat
      FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT o.rid, o.i, o.m, p.item FROM o JOIN p USING (m, pat)),
n AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS pos FROM (SELECT DISTINCT rid, i, m FROM h)) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""
