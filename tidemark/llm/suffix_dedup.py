"""Removal of passages that an earlier document has: every byte inside a 50-byte string that also starts in a
document with a smaller id.

A suffix sort of the whole corpus would be many times its size. Instead each 50-byte window picks an anchor, the
16-byte string in it with the smallest hash; equal windows pick equal anchors. Anchors in one document only can't
belong to a shared window and go no further. For the others, the 84 bytes around them (all windows that can have
picked them) go, copies merged, to the shard of their anchor. A shard is suffix-sorted by external induction
(``suffix_sort``); neighbours that agree over 50 bytes form a run, and a run's smallest id decides for its members.

Texts are first written as compressed batches. Anchors and verdicts travel as packed arrays, a verdict for the
anchors of a batch being one bit each, so what is shuffled stays below the size of the texts. Copies are merged in
each batch before anything moves.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_schema, values, written
from tidemark.llm.suffix_sort import suffix_order

WINDOW = 50
ANCHOR = 16
#: Windows that can pick an anchor: those that begin up to ``BACK`` bytes before it.
BACK = WINDOW - ANCHOR
AROUND = BACK + WINDOW
BATCH_BYTES = 8 << 20
AT_ONCE = 1 << 20
#: Anchors of a shard in a small corpus; anchors that a batch should send to a shard at least, before the rows of their
#: packed arrays outweigh these; and anchors of a shard at most (some 20 MB of them, and 340 MB of contexts if all are shared).
SHARD_ANCHORS, ROW_ANCHORS, MOST_ANCHORS = 200_000, 32, 4_000_000
#: Stands for a null id: it comes after every other and before none.
NO_ID = np.iinfo(np.int64).max


def anchor_hashes(buf: bytes) -> np.ndarray:
    """A hash, never 0, of the 16 bytes at each place of ``buf``."""
    n = len(buf) - ANCHOR + 1
    words = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    with np.errstate(over="ignore"):
        h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += words[8 : 8 + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return np.maximum(h, np.uint64(1), out=h)  # 0 marks windows that pick nothing


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) over each ``width`` neighbours."""
    got = 1
    while got * 2 <= width:
        x, got = f(x[:-got], x[got:]), got * 2
    return f(x[: len(x) - (width - got)], x[width - got :]) if got < width else x


@dataclass
class Batch:
    """Documents laid end to end, with their anchors."""

    ids: np.ndarray
    starts: np.ndarray  # of documents in buf, and the end
    buf: bytes
    at: np.ndarray = None  # places of anchors
    hash: np.ndarray = None
    doc: np.ndarray = None  # index of their document

    def find_anchors(self) -> Batch:
        """Finds the anchors, over about ``AT_ONCE`` bytes of whole documents at a time."""
        places, hashes = [np.array([], dtype=np.int64)], [np.array([], dtype=np.uint64)]
        first = 0
        while first < len(self.ids):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + AT_ONCE, side="right")) - 1)
            begin, end = int(self.starts[first]), int(self.starts[last])
            if end - begin >= WINDOW:
                h = anchor_hashes(self.buf[begin:end])
                least = sliding(h, BACK + 1, np.minimum)
                for stop in (self.starts[first + 1 : last + 1] - begin).tolist():
                    least[max(stop - WINDOW + 1, 0) : stop] = 0  # windows that reach over a document's end pick nothing
                edge = np.zeros(BACK, dtype=h.dtype)
                picked = sliding(np.concatenate([edge, least, edge]), BACK + 1, np.maximum)
                at = np.flatnonzero((picked == h) & (h > 0))
                places.append(at + begin)
                hashes.append(h[at])
            first = last
        self.at, self.hash = np.concatenate(places), np.concatenate(hashes)
        self.doc = np.searchsorted(self.starts, self.at, side="right") - 1
        return self

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes, whether several documents of the batch have them, and each anchor's index there."""
        own, index = np.unique(self.hash, return_inverse=True)
        lo, hi = np.full(len(own), len(self.ids)), np.full(len(own), -1)
        np.minimum.at(lo, index, self.doc)
        np.maximum.at(hi, index, self.doc)
        return own, lo != hi, index

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """For each of the anchors, the bytes around it, then how many before and after it are its document's (plus 1)."""
        at, doc = self.at[which], self.doc[which]
        before = np.minimum(at - self.starts[doc], BACK)
        after = np.minimum(self.starts[doc + 1] - at, WINDOW)
        padded = np.frombuffer(b"\0" * BACK + self.buf + b"\0" * WINDOW, dtype=np.uint8)
        rows = np.empty((len(at), AROUND + 2), dtype=np.uint8)
        span = np.arange(AROUND)
        for a in range(0, len(at), 1 << 16):
            rows[a : a + (1 << 16), :AROUND] = padded[at[a : a + (1 << 16), None] + span]
        rows[:, :AROUND][(span < BACK - before[:, None]) | (span >= BACK + after[:, None])] = 0
        rows[:, AROUND], rows[:, AROUND + 1] = before + 1, after + 1
        return np.ascontiguousarray(rows).view(f"S{AROUND + 2}").ravel()


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unpacked(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def shard_count(total: int) -> int:
    """Shards for so many bytes of text: of ``SHARD_ANCHORS`` while a batch has ``ROW_ANCHORS`` for each of them, then as
    many, the shards growing to ``MOST_ANCHORS`` (1.2 TB of text), then of that size."""
    of = lambda size: size * 2 // (BACK + 2)  # noqa: E731 - a window of 35 places picks one; random places have that density
    return max(8, min(of(total) // SHARD_ANCHORS, max(of(BATCH_BYTES) // ROW_ANCHORS, of(total) // MOST_ANCHORS)) + 1)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes % np.uint64(shards)).astype(np.int64)


def by_shard(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, indices in ascending order)."""
    order = np.argsort(shard, kind="stable")
    if not len(order):
        return []
    edges = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0])
    return [(int(shard[order[a]]), order[a:b]) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True)]


def batches_of(docs: DataFrame) -> DataFrame:
    """Rows of whole documents: about ``BATCH_BYTES`` each, or one document that is longer."""
    out = T._parse_datatype_string("batch bigint, bytes bigint, ids binary, sizes binary, texts binary")
    arrow = arrow_schema(out)

    def run(found):
        import pyarrow as pa

        number = TaskContext.get().partitionId() << 36
        ids, texts, size = [], [], 0

        def row():
            nonlocal number, ids, texts, size
            number += 1
            cols = [number - 1, size, np.array(ids, dtype="<i8").tobytes(), np.array([len(t) for t in texts], dtype="<i8").tobytes(), zstandard.ZstdCompressor(level=1).compress(b"".join(texts))]
            ids, texts, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in found:
            for doc, text in zip(values(batch.column("id")), values(batch.column("text"), binary=True), strict=True):
                ids.append(NO_ID if doc is None else doc)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield row()
        if ids:
            yield row()

    return docs.mapInArrow(run, out)


def read_batch(row: dict) -> Batch:
    sizes = np.frombuffer(row["sizes"], dtype="<i8")
    buf = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, row["bytes"])) if row["bytes"] else b""
    return Batch(np.frombuffer(row["ids"], dtype="<i8"), np.r_[0, np.cumsum(sizes)], buf).find_anchors()


def each_row(df: DataFrame, fn, ddl: str) -> DataFrame:
    """``mapInArrow`` that hands ``fn`` one row (a dict) at a time; it yields dicts of columns."""
    import pyarrow as pa

    out = T._parse_datatype_string(ddl)
    arrow = arrow_schema(out)

    def run(found):
        for batch in found:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                for cols in fn(row):
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def each_shard(df: DataFrame, fn, ddl: str) -> DataFrame:
    """``applyInArrow`` by ``shard``: ``fn`` gets the shard's rows as dicts and returns columns."""
    import pyarrow as pa

    out = T._parse_datatype_string(ddl)
    arrow = arrow_schema(out)

    def run(table):
        cols = fn(table.to_pylist())
        return pa.table([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.groupBy("shard").applyInArrow(run, out)


def send_anchors(shards: int):
    """Of a batch, for each shard: its distinct anchors (40 bits of their hashes) and which are in several documents."""

    def fn(row):
        own, several, _ = read_batch(row).distinct()
        found = by_shard(shard_of(own, shards))
        yield {
            "shard": [s for s, _ in found],
            "batch": [row["batch"]] * len(found),
            "anchors": [np.ascontiguousarray((own[i] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes() for _, i in found],
            "several": [np.packbits(several[i]).tobytes() for _, i in found],
        }

    return fn


def find_shared(rows: list[dict]) -> dict:
    """Which anchors of each batch are in two documents or more; two that agree in 40 bits and shard only cost time."""
    own, several = [], []
    for r in rows:
        raw = np.frombuffer(r["anchors"], dtype=np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), dtype=np.uint8)
        wide[:, :5] = raw
        own.append(wide.view("<u8").ravel())
        several.append(np.unpackbits(np.frombuffer(r["several"], dtype=np.uint8), count=len(raw)).astype(bool))
    everything = np.concatenate(own)
    _, index, count = np.unique(everything, return_inverse=True, return_counts=True)
    shared = count >= 2
    shared[index[np.concatenate(several)]] = True
    verdict, at, bits = shared[index], 0, []
    for a in own:
        bits.append(np.packbits(verdict[at : at + len(a)]).tobytes())
        at += len(a)
    return {"batch": [r["batch"] for r in rows], "from_shard": [r["shard"] for r in rows], "bits": bits}


def shared_contexts(row: dict, shards: int) -> tuple[Batch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The batch, its anchors that are shared, the distinct contexts of these, each anchor's context, each context's shard."""
    batch = read_batch(row)
    own, _, index = batch.distinct()
    flags = np.zeros(len(own), dtype=bool)
    bits = {v["from_shard"]: v["bits"] for v in row["verdicts"] or ()}
    for s, i in by_shard(shard_of(own, shards)):
        flags[i] = np.unpackbits(np.frombuffer(bits[s], dtype=np.uint8), count=len(i)).astype(bool)
    which = np.flatnonzero(flags[index])
    contexts, of = np.unique(batch.contexts(which), return_inverse=True)
    shard = np.zeros(len(contexts), dtype=np.int64)
    shard[of] = shard_of(batch.hash[which], shards)
    return batch, which, contexts, of, shard


def send_contexts(shards: int):
    """Of a batch, for each shard: the distinct contexts of its shared anchors, with their smallest ids."""

    def fn(row):
        batch, which, contexts, of, shard = shared_contexts(row, shards)
        least = np.full(len(contexts), NO_ID)
        np.minimum.at(least, of, batch.ids[batch.doc[which]])
        for s, i in by_shard(shard):
            yield {"shard": [s], "batch": [row["batch"]], "contexts": [packed(contexts[i])], "ids": [packed(least[i])]}

    return fn


def reaches(sides: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How far each row of bytes agrees with the one most like it in its group. ``sides``: uint8, zero past the end of
    what a context has (so rows may agree in zeros too: an upper bound)."""
    wide = np.ascontiguousarray(np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), sides], axis=1))
    order = np.argsort(wide.view(f"V{wide.shape[1]}").ravel(), kind="stable")
    rows = wide[order]
    differ = rows[1:] != rows[:-1]
    agree = np.where(differ.any(axis=1), differ.argmax(axis=1), wide.shape[1]) - 4
    best = np.zeros(len(rows), dtype=np.int64)
    best[1:] = np.maximum(best[1:], agree)
    best[:-1] = np.maximum(best[:-1], agree)
    out = np.empty(len(rows), dtype=np.int64)
    out[order] = best
    return out


def earlier_windows(contexts: np.ndarray, least: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each of distinct contexts, bit o is set if the window that begins o bytes before the anchor also stands in
    a context with a smaller id.

    A window reaches o bytes before its anchor and ``BACK`` - o past it, so a context that agrees with no other of its
    anchor (``group``) that far on both sides has none to share; of the rest only the part that can agree is sorted.
    """
    masks = np.zeros(len(contexts), dtype=np.uint64)
    rows = contexts.view(np.uint8).reshape(-1, AROUND + 2)
    before = np.minimum(rows[:, AROUND].astype(np.int64) - 1, reaches(rows[:, :BACK][:, ::-1], group))
    after = np.minimum(rows[:, AROUND + 1].astype(np.int64) - 1, ANCHOR + reaches(rows[:, BACK + ANCHOR : AROUND], group))
    some = np.flatnonzero(before + after >= WINDOW)
    if not len(some):
        return masks
    rows, before, after, least = rows[some], before[some], after[some], least[some]
    size = before + after
    starts = np.r_[0, np.cumsum(size + 1)]
    text = np.ones(starts[-1] + 1, dtype=np.uint16)  # 1 separates contexts, 0 ends the text
    text[-1] = 0
    inside = (np.arange(AROUND) >= BACK - before[:, None]) & (np.arange(AROUND) < BACK + after[:, None])
    of = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    place = np.arange(len(of)) + of
    letters = rows[:, :AROUND][inside]
    text[place] = letters.astype(np.uint16) + 2
    order = suffix_order(text, WINDOW)
    # only places where a window of the context begins
    offset = np.full(len(text), -1, dtype=np.int8)
    offset[place] = before[of] - (place - starts[of])
    offset[place[(offset[place] < 0) | (WINDOW - offset[place] > after[of])]] = -1
    owner = np.zeros(len(text), dtype=np.int32)
    owner[place] = of
    order = order[offset[order] >= 0]
    raw = np.zeros(len(text) + 8, dtype=np.uint8)
    raw[place] = letters
    word = np.ndarray(shape=(len(text),), dtype="<u8", buffer=raw.tobytes(), strides=(1,))
    equal = np.ones(max(len(order) - 1, 0), dtype=bool)
    for k in (0, 8, 16, 24, 32, 40, WINDOW - 8):
        w = word[order + k]
        equal &= w[1:] == w[:-1]
    runs = np.flatnonzero(np.r_[True, ~equal])
    smallest = np.repeat(np.minimum.reduceat(least[owner[order]], runs), np.diff(np.r_[runs, len(order)]))
    hit = order[smallest < least[owner[order]]]
    found = np.zeros(len(rows), dtype=np.uint64)
    np.bitwise_or.at(found, owner[hit], np.uint64(1) << offset[hit].astype(np.uint64))
    masks[some] = found
    return masks


def judge_contexts(rows: list[dict]) -> dict:
    """For each context sent: the smallest id that has it, and the windows in it that a smaller one has elsewhere."""
    sent = [unpacked(r["contexts"], f"S{AROUND + 2}") for r in rows]
    contexts, of = np.unique(np.concatenate(sent), return_inverse=True)
    least = np.full(len(contexts), NO_ID)
    np.minimum.at(least, of, np.concatenate([unpacked(r["ids"], "<i8") for r in rows]))
    masks = np.zeros(len(contexts), dtype=np.uint64)
    anchors = np.ascontiguousarray(contexts.view(np.uint8).reshape(-1, AROUND + 2)[:, BACK : BACK + ANCHOR]).view(f"V{ANCHOR}").ravel()
    _, group, count = np.unique(anchors.view("<u8,<u8") if len(anchors) else anchors, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(count[group] > 1)  # one context alone has no other window to compare
    if len(mixed):
        masks[mixed] = earlier_windows(np.ascontiguousarray(contexts[mixed]), least[mixed], group[mixed])
    at, ids, bits = 0, [], []
    for s in sent:
        mine = of[at : at + len(s)]
        ids.append(packed(least[mine]))
        bits.append(packed(masks[mine]))
        at += len(s)
    return {"batch": [r["batch"] for r in rows], "from_shard": [r["shard"] for r in rows], "least": ids, "masks": bits}


def removed_bytes(row: dict, shards: int) -> tuple[Batch, np.ndarray]:
    """The batch and, for each of its bytes, whether it goes."""
    batch, which, contexts, of, shard = shared_contexts(row, shards)
    least, masks = np.full(len(contexts), NO_ID), np.zeros(len(contexts), dtype=np.uint64)
    judged = {v["from_shard"]: v for v in row["judged"] or ()}
    for s, i in by_shard(shard):
        least[i], masks[i] = unpacked(judged[s]["least"], "<i8"), unpacked(judged[s]["masks"], "<u8")
    at, doc = batch.at[which], batch.doc[which]
    change = np.zeros(len(batch.buf) + 1, dtype=np.int32)
    later = batch.ids[doc] > least[of]
    # every window around the anchor, as far as it is the document's
    first = np.maximum(at[later] - BACK, batch.starts[doc[later]])
    last = np.minimum(at[later], batch.starts[doc[later] + 1] - WINDOW)
    np.add.at(change, first, 1)
    np.add.at(change, last + WINDOW, -1)
    some = ~later & (masks[of] > 0)
    at, mask = at[some], masks[of[some]]
    for o in range(BACK + 1):
        begin = at[(mask >> np.uint64(o)) & np.uint64(1) > 0] - o
        np.add.at(change, begin, 1)
        np.add.at(change, begin + WINDOW, -1)
    return batch, np.cumsum(change)[:-1] > 0


def results(shards: int, with_text: bool):
    def fn(row):
        batch, gone = removed_bytes(row, shards)
        buf = np.frombuffer(batch.buf, dtype=np.uint8)
        cols = {k: [] for k in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")}
        for doc, a, b in zip(batch.ids.tolist(), batch.starts[:-1].tolist(), batch.starts[1:].tolist(), strict=True):
            own = gone[a:b]
            kept = buf[a:b][~own].tobytes()
            cols["id"].append(None if doc == NO_ID else doc)
            cols["n_bytes"].append(b - a)
            cols["n_removed"].append(b - a - len(kept))
            cols["n_spans"].append(int(np.count_nonzero(own[1:] & ~own[:-1])) + int(b > a and own[0]))
            cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                cols["text"].append(kept)
        yield cols

    return fn


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` of each document and, with ``with_bytes``, ``text``: the
    bytes that stay (removal may cut characters).

    Null texts are empty. Documents with equal ids take nothing from each other; one with a null id loses what any
    numbered document has and takes nothing. Texts under 50 bytes stay whole. Very long ones are batches of their own.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    batches = written(batches_of(source), "suffix-batches")
    total = batches.agg(F.sum("bytes")).first()[0] or 0
    shards = shard_count(int(total))
    sent = each_row(batches, send_anchors(shards), "shard bigint, batch bigint, anchors binary, several binary")
    shared = each_shard(sent, find_shared, "batch bigint, from_shard bigint, bits binary")
    of_batch = shared.groupBy("batch").agg(F.collect_list(F.struct("from_shard", "bits")).alias("verdicts"))  # one for each shard
    flagged = batches.join(of_batch, "batch", "left")
    sent = each_row(flagged, send_contexts(shards), "shard bigint, batch bigint, contexts binary, ids binary")
    judged = each_shard(sent, judge_contexts, "batch bigint, from_shard bigint, least binary, masks binary")
    of_batch2 = judged.groupBy("batch").agg(F.collect_list(F.struct("from_shard", "least", "masks")).alias("judged"))
    out = each_row(flagged.join(of_batch2, "batch", "left"), results(shards, with_bytes), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text binary" * with_bytes)
    return out.withColumnRenamed("id", id_col)


def op5_induced_suffixes(docs: DataFrame) -> DataFrame:
    """Digest per document; see ``without_repeats``."""
    return without_repeats(docs)
