"""Ranked lexical search over an index of documents.

The index has a row for each shard of documents: their ids, the shard's terms, and its postings in compressed sparse
rows (for each term, the documents that hold it, in order), each with its impact, the part of the score that does not
depend on the query, as an integer. Impacts need the sizes of the whole corpus, which one pass counts before.

A query's terms are taken one at a time: a term's impacts, times its weight, are added to an array with a place for
each document of the shard. The best of a shard are selected by partial sorting, all that tie with the last of them
being looked at; what a task's shards found is merged there, and what tasks found by windows, in two steps.

Queries go to the tasks in blocks of bounded size, each with the document frequencies of its own terms.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import alnum_words, arrow_schema, values, written

#: Documents of a shard at most (their numbers are of 16 bits), and words at which it is full.
SHARD_DOCS, SHARD_WORDS = 1 << 14, 1 << 20
#: Queries of a block, and terms at which it is full.
BLOCK_ITEMS, BLOCK_TERMS = 4096, 200_000
#: Parts in which the tasks' results are merged first.
PARTS = 64
#: Stands for a null id: it comes after every other.
NO_ID = np.iinfo(np.int64).max
BEST = 10

INDEX = "shard bigint, n_docs bigint, ids binary, vocabulary binary, starts binary, docs binary, impacts binary"


@dataclass(frozen=True)
class Index:
    """``shards`` as in ``INDEX``, written; the number of documents with a term, and of all their terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def packed(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else a.tobytes())


def unpacked(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def corpus_size(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Documents with at least one term, and all their terms."""
    out = arrow_schema("n_docs bigint, n_terms bigint")

    def run(batches):
        sizes = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for text in values(batch.column(0), binary=True):
                n = len(alnum_words(text))
                sizes += (n > 0, n)
        yield pa.RecordBatch.from_arrays([pa.array(sizes[:1]), pa.array(sizes[1:])], schema=out)

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "n_docs bigint, n_terms bigint")
    found = counted.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return found[0] or 0, found[1] or 0


def length_factors(sizes: list[int], n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of so many terms; with exact integers, which may be beyond 64 bits on the way."""
    return np.array([25 + 75 * n * n_docs // n_terms for n in sizes], dtype=np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def built_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows of ``docs``. Null and empty texts, and those without a term, are in no posting."""
    n_docs, n_terms = corpus_size(docs, text_col)
    out = T._parse_datatype_string(INDEX)
    arrow = arrow_schema(out)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        found: list[np.ndarray] = []
        words = 0
        vocabulary: dict[bytes, int] = {}

        def shard():
            nonlocal number, words
            sizes = [len(t) for t in found]
            doc = np.repeat(np.arange(len(found)), sizes)
            places, tf = np.unique(np.concatenate(found) * len(found) + doc, return_counts=True)
            term, doc = np.divmod(places, len(found))
            starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
            own = impacts(tf, length_factors(sizes, n_docs, n_terms)[doc])
            cols = [number, len(ids), packed(np.array(ids, dtype="<i8")), packed(b" ".join(vocabulary)), packed(starts.astype("<i4")), packed(doc.astype("<u2")), packed(own.astype("<i4"))]
            number, words = number + 1, 0
            ids.clear(), found.clear(), vocabulary.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for doc, text in zip(values(batch.column("id")), values(batch.column("text"), binary=True), strict=True):
                own = alnum_words(text)
                if own:
                    ids.append(NO_ID if doc is None else doc)
                    found.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in own), dtype=np.int64, count=len(own)))
                    words += len(own)
                    if words >= SHARD_WORDS or len(ids) == SHARD_DOCS:
                        yield shard()
        if ids:
            yield shard()

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return Index(written(source.mapInArrow(run, out), "lexical-index"), n_docs, n_terms)


@dataclass(frozen=True)
class Block:
    """Some queries: their ids, their terms as numbers in ``vocabulary`` with how often they ask for each."""

    items: list[str | None]
    terms: list[list[tuple[int, int]]]
    vocabulary: dict[bytes, int]


def query_blocks(queries: DataFrame, item_col: str, text_col: str, block_items: int, block_terms: int) -> Iterator[Block]:
    """Blocks of queries, one at a time: the driver reads the table a partition at a time."""
    block, size = Block([], [], {}), 0
    for item, text in queries.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        count = Counter(alnum_words(text.encode() if text else None))
        if not count:
            continue
        block.items.append(item)
        block.terms.append([(block.vocabulary.setdefault(t, len(block.vocabulary)), c) for t, c in count.items()])
        size += len(count)
        if len(block.items) >= block_items or size >= block_terms:
            yield block
            block, size = Block([], [], {}), 0
    if block.items:
        yield block


def own_terms(vocabulary: bytes, asked: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the terms that a shard and the queries share: theirs, the shard's."""
    pairs = [(asked[t], k) for k, t in enumerate(zstandard.ZstdDecompressor().decompress(vocabulary).split(b" ")) if t in asked]
    both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def document_frequencies(index: Index, vocabulary: dict[bytes, int]) -> np.ndarray:
    """For each of the terms, the documents that hold it; a task adds up its shards."""
    asked = index.shards.sparkSession.sparkContext.broadcast(vocabulary)
    arrow = arrow_schema("term bigint, df bigint")

    def run(batches):
        total = np.zeros(len(asked.value), dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                theirs, own = own_terms(batch.column("vocabulary")[k].as_py(), asked.value)
                starts = unpacked(batch.column("starts")[k].as_py(), "<i4")
                total[theirs] += starts[own + 1] - starts[own]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int64()), pa.array(total[some])], schema=arrow)

    out = np.zeros(len(vocabulary), dtype=np.int64)
    for term, df in index.shards.select("vocabulary", "starts").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    asked.destroy()
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` highest scores above 0, of equal scores those with the smallest ids."""
    some = np.flatnonzero(scores)
    if len(some) > k:
        own = scores[some]
        least = own[np.argpartition(own, len(own) - k)[len(own) - k]]
        some = some[own >= least]  # all that tie with the last
    some = some[np.lexsort((ids[some], -scores[some]))[:k]]
    return ids[some], scores[some]


class Shard:
    """One row of the index, opened for a block's terms."""

    def __init__(self, row: dict, asked: dict[bytes, int]):
        self.ids = unpacked(row["ids"], "<i8")
        starts = unpacked(row["starts"], "<i4").tolist()
        docs, own = unpacked(row["docs"], "<u2"), unpacked(row["impacts"], "<i4")
        self.postings: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for theirs, k in zip(*(x.tolist() for x in own_terms(row["vocabulary"], asked)), strict=True):
            here = slice(starts[k], starts[k + 1])
            self.postings[theirs] = docs[here].astype(np.intp), own[here].astype(np.int64)

    def scores(self, terms: list[tuple[int, int]]) -> np.ndarray:
        """Of every document, for a query's (term, weight times how often it is asked for)."""
        total = np.zeros(len(self.ids), dtype=np.int64)
        for term, w in terms:
            if (found := self.postings.get(term)) is not None:
                total[found[0]] += found[1] * w
        return total


def _found(index: Index, block: Block, k: int) -> DataFrame:
    """``item, item_id, doc_id, score`` of each task's best."""
    df = document_frequencies(index, block.vocabulary).tolist()
    weights = [weight(index.n_docs, x) if x else 0 for x in df]
    weighted = [[(t, c * weights[t]) for t, c in terms if weights[t]] for terms in block.terms]
    sent = index.shards.sparkSession.sparkContext.broadcast((block.items, weighted, block.vocabulary))
    ddl = "item bigint, item_id string, doc_id bigint, score bigint"
    arrow = arrow_schema(ddl)

    def run(batches):
        items, queries, vocabulary = sent.value
        best = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))] * len(items)
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard({n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}, vocabulary)
                for q, terms in enumerate(queries):
                    ids, scores = best_of(shard.scores(terms), shard.ids, k)
                    if len(ids):
                        best[q] = best_of(np.r_[best[q][1], scores], np.r_[best[q][0], ids], k)
        for q, (ids, scores) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(ids)), pa.array([items[q]] * len(ids), type=pa.string()), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], schema=arrow)

    return index.shards.drop("shard", "n_docs").mapInArrow(run, ddl)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best of all tasks: of parts of them first, so that no task gets a row from every other."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = found.withColumn("part", F.spark_partition_id() % PARTS)
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(index: Index, queries: DataFrame, *, k: int = BEST, item_col: str = "item_id", text_col: str = "text", block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for each row of ``queries``,
    of equal scores the smallest ids first, null ids last.

    Each row is a query of its own, also if its id is null or another row has it; one without any term, or of which no
    document holds a term, gives no rows. Rows of the index with equal ids are different documents. An empty index or
    table of queries gives no rows. One block of ``block_items`` queries, or as many as have ``block_terms`` terms,
    is with the driver and the tasks at a time.
    """
    spark = queries.sparkSession
    blocks = query_blocks(queries, item_col, text_col, block_items, block_terms)
    first, second = next(blocks, None), next(blocks, None)
    if first is None or not index.n_docs:
        found = spark.createDataFrame([], "item_id string, rank int, doc_id bigint, score bigint")
    elif second is None:
        found = _merged(_found(index, first, k), k)
    else:
        parts = [written(_merged(_found(index, b, k), k), "lexical-found") for b in (first, second)]
        parts += [written(_merged(_found(index, b, k), k), "lexical-found") for b in blocks]
        found = functools.reduce(DataFrame.unionByName, parts)
    return found.withColumn("item_id", F.col("item_id").cast(queries.schema[item_col].dataType))


def op11_sharded_postings(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The ten best documents of each benchmark item; see ``search``."""
    return search(built_index(docs), benchmark)


#: The same scores from words, their counts and joins.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS iid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
st AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY rid, t),
wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS wt FROM tf, st GROUP BY t),
q AS (SELECT iid, t, count(*) AS asked FROM (SELECT iid, unnest(w) AS t FROM b) GROUP BY iid, t),
m AS (SELECT rid, doc_id, 25 + (75 * CAST(len(w) AS BIGINT) * n_docs) // n_terms AS m FROM d, st),
s AS (SELECT iid, rid, CAST(sum(asked * wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (rid) GROUP BY iid, rid)
SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s JOIN m USING (rid) JOIN b USING (iid) WHERE score > 0
QUALIFY rank <= 10
"""
