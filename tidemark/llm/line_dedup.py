"""Line dedup by the spread of a line over sites.

Rows of (line hash, site) are aggregated to HyperLogLog sketches of the distinct sites of each line; sketches merge
in the aggregation, so a line that is everywhere needs no more room than another. Lines whose estimate lies near
the threshold get an exact distinct count. Lines on at least ``min_sites`` sites are boilerplate: they go from
every document but their first.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, schema_of, values, written

MIN_SITES = 10
#: Sketch size (standard error 1.6 %), and the band around the threshold, in which lines are counted exactly.
LOG_REGISTERS = 12
BAND = 0.15
LINE = ["__h1", "__h2"]
ROW = ["__r1", "__r2"]
#: Up to so many boilerplate lines go to every task (some 10 MB there); more are joined.
SENT_LINES = 100_000
#: Leads a line's second hash; both have Spark's seed.
SALT, SEED = "\x07", 42


def _hashes(*of: Column) -> list[Column]:
    return [F.xxhash64(*of), F.xxhash64(F.lit(SALT), *of)]


def _line_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line), F.xxhash64(F.concat(F.lit(SALT), line))]


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """Of rows (line, site, id), the lines on at least ``min_sites`` sites, with ``__first``: their smallest id."""
    # a line in fewer rows than that can't be on as many sites
    often = lines.groupBy(LINE).agg(F.count(F.lit(1)).alias("__rows"), F.min("__site").alias("__lo"), F.max("__site").alias("__hi"), F.min("__id").alias("__first"))
    often = written(often.where((F.col("__rows") >= min_sites) & ((F.col("__lo") < F.col("__hi")) | (F.lit(min_sites) <= 1))).select(*LINE, "__first"), "line-often")
    theirs = lines.join(often, LINE, "left_semi").select(*LINE, "__site")
    sketches = theirs.groupBy(LINE).agg(F.hll_sketch_agg("__site", F.lit(LOG_REGISTERS)).alias("__sketch"))
    spread = written(sketches.select(*LINE, F.hll_sketch_estimate("__sketch").alias("__sites")), "line-spread")
    slack = max(1.0, BAND * min_sites)
    near = spread.where(F.abs(F.col("__sites") - min_sites) <= slack)
    exact = theirs.where(F.col("__site").isNotNull()).join(near, LINE, "left_semi").distinct().groupBy(LINE).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_sites)
    chosen = spread.where(F.col("__sites") > min_sites + slack).select(*LINE).unionByName(exact.select(*LINE))
    return often.join(chosen, LINE, "left_semi")


def without_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, counts: bool = True, sent_lines: int = SENT_LINES) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text_col`` and, with ``counts``, the columns ``n_lines, n_removed``.

    A line is the text between newlines without blanks at its ends; empty lines are kept and never counted. Null
    texts stay null with no lines, rows with a null site or id count for no site and are no line's first document.
    In rows that are equal in id and text a line's first document is each of them. An empty table stays empty.
    Boilerplate lines are few as a rule: up to ``sent_lines`` go to the tasks, which then read each text once and
    shuffle none; more are joined, with the same result.
    """
    row = _hashes(F.col(id_col), F.col(text_col))
    lines = docs.where(F.col(text_col).isNotNull()).select(
        row[0].alias("__r1"), row[1].alias("__r2"), F.col(id_col).alias("__id"), F.col(site_col).cast("string").alias("__site"),
        F.explode(F.array_distinct(F.transform(F.split(text_col, "\n"), lambda x: F.trim(x)))).alias("__line"),
    )
    lines = written(lines.where(F.col("__line") != "").select(*ROW, "__id", "__site", *(h.alias(n) for h, n in zip(_line_hashes(F.col("__line")), LINE, strict=True))), "line-rows")
    spread = written(spread_lines(lines, min_sites), "line-boilerplate")
    if spread.count() <= sent_lines:
        return _told(docs, spread, id_col, text_col, counts)
    gone = lines.join(spread, LINE).where(F.col("__id").isNull() | F.col("__first").isNull() | (F.col("__id") != F.col("__first")))
    # as many values as the text has lines
    gone = written(gone.groupBy(ROW).agg(F.collect_set("__h1").alias("__g1"), F.collect_set(F.concat_ws(":", *LINE)).alias("__gone")), "line-gone")
    out = docs.withColumns(dict(zip(ROW, row, strict=True))).join(gone, ROW, "left")
    out = out.withColumn("__all", F.split(text_col, "\n"))
    key = lambda x: F.concat_ws(":", *_line_hashes(F.trim(x)))
    out = out.withColumn("__left", F.when(F.col("__gone").isNull(), F.col("__all")).otherwise(F.filter("__all", lambda x: ~(F.array_contains("__g1", F.xxhash64(F.trim(x))) & F.array_contains("__gone", key(x))))))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join("__left", "\n"))
    same = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    words = F.when(F.col("__all").isNull(), F.lit(0)).otherwise(n(F.filter("__all", lambda x: F.trim(x) != "")))
    removed = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(n("__all") - n("__left"))
    if not counts:
        return out.select(*same)
    return out.select(*same, words.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def _told(docs: DataFrame, spread: DataFrame, id_col: str, text_col: str, counts: bool) -> DataFrame:
    """The same with the boilerplate lines in every task."""
    first = docs.sparkSession.sparkContext.broadcast({(a, b): f for a, b, f in spread.select(*LINE, "__first").toLocalIterator()})
    own = [f"k_{c}" for c in docs.columns]
    text, doc_id = f"k_{text_col}", f"k_{id_col}"
    out = schema_of(docs.toDF(*own), *own, more="n_lines bigint, n_removed bigint")
    digest, salt = xxhash.xxh64_intdigest, SALT.encode()
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def make():
        known = first.value
        heads = {a % (1 << 64) for a, _ in known}

        def gone(line: bytes, doc) -> bool:
            h = digest(line, SEED)
            if h not in heads or (key := (signed(h), signed(digest(salt + line, SEED)))) not in known:
                return False
            return doc is None or known[key] is None or doc != known[key]

        def fn(batch):
            texts, n, removed = [], [], []
            for doc, t in zip(values(batch.column(doc_id)), values(batch.column(text), binary=True), strict=True):
                lines = [] if t is None else t.split(b"\n")
                bare = [x.strip(b" ") for x in lines]
                left = [x for x, b in zip(lines, bare, strict=True) if not b or not gone(b, doc)]
                n.append(sum(map(bool, bare)))
                removed.append(len(lines) - len(left))
                texts.append(t if t is None else (t if len(left) == len(lines) else b"\n".join(left)).decode())
            return {c: batch.column(c) for c in own if c != text} | {text: texts, "n_lines": n, "n_removed": removed}

        return fn

    done = map_rows(docs.toDF(*own).withColumn(text, F.col(text).cast("string")), make, out)
    done = done.select(*[F.col(k).alias(c) for k, c in zip(own, docs.columns, strict=True)], "n_lines", "n_removed")
    return done if counts else done.select(*docs.columns)


def with_lines_left(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without boilerplate lines, and without the documents that had nothing else.

    Lines, null sites and ids, ties and repeated rows count as in ``without_boilerplate``. Null, empty and blank texts
    lost nothing and stay; a very long text is read whole. All columns keep their names, whatever these are.
    """
    own = [f"k_{c}" for c in docs.columns]
    cols = {k: f"k_{options.pop(k, v)}" for k, v in (("id_col", "doc_id"), ("site_col", "source"))}
    out = without_boilerplate(docs.toDF(*own), text_col=f"k_{text_col}", **cols, **options)
    empty = (F.col("n_removed") > 0) & ~F.col(f"k_{text_col}").rlike("[^ \n]")
    return out.where(~F.coalesce(empty, F.lit(False))).select(*own).toDF(*docs.columns)


def op1_site_spread(docs: DataFrame) -> DataFrame:
    """Per document: its lines, how many went, and a digest of the text that stays."""
    return without_boilerplate(docs.select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, source, p, ls[p] AS raw, trim(ls[p]) AS line FROM (SELECT rid, doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS p FROM d)),
b AS (SELECT line, min(doc_id) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (SELECT l.*, b.first IS NOT NULL AND l.doc_id <> b.first AS gone FROM l LEFT JOIN b ON l.line = b.line)
SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY rid, doc_id
"""
