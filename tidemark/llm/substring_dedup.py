"""Removal of repeated passages of words: every word inside a window of 50 that also starts in a document with a smaller id.

Suffixes of words go to groups by their prefixes, each group's suffix tree is built in memory, and the tree's nodes of 50
words or more with several leaves are the repeats.

* Which suffixes: each window picks an anchor, the place in its first 35 words where the hash of the 8 words on is
  smallest; equal windows pick equal anchors. Only suffixes around anchors whose 8 words two documents have can be in a
  repeat; the others go no further.
* Prefixes of variable length: a group is the suffixes around anchors with the same 8 words. A group too large for a task's
  memory is split by 16 words, which are inside every window that picked the anchor, and what is still too large by all 50:
  a suffix cut to its whole window, of which only the smallest id is kept, wherever it is.
* Subtrees: of each anchor come the 34 words before it and the 50 on. The tree of suffixes that begin at the anchors grows
  from the root a word at a time; nodes of suffixes that begin o words before follow from those for o - 1 by a word put in
  front, as in Weiner's construction. Branches with one leaf are not followed. A node that spells 50 words knows the
  smallest id below it.

Texts are written as batches of word numbers and vocabularies first, in buckets, so that later passes read them in place:
only what is said about them is shuffled. What a batch sends to a group has copies merged, its words as numbers of a
vocabulary that goes along; comparisons are of words, not hashes, but for whole windows of groups that no prefix splits,
which are compared by 128 bits.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, values, written
from tidemark.llm.suffix_dedup import NO_ID, by_shard, each_row, each_shard, packed, shard_of, sliding, unpacked
from tidemark.sources.tables import in_buckets

WINDOW = 50
#: Words of the prefixes by which groups are split; a window picks an anchor that leaves room for the longest.
SHORT, LONG = 8, 16
BACK = WINDOW - LONG
AROUND = BACK + WINDOW
BATCH_BYTES = 8 << 20
#: Suffixes of a group before it is split further.
MOST = 20_000
#: Bytes of text for one anchor, about (words have some six letters, and one in 18 is an anchor).
ANCHOR_BYTES = 108
#: Anchors of a shard of groups, what a batch should send to one at least, and anchors of a shard at most.
SHARD_ANCHORS, ROW_ANCHORS, MOST_ANCHORS = 100_000, 32, 2_000_000
PIECE = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def mixed(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of two hashes, in their order."""
    with np.errstate(over="ignore"):
        x = (a ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(23)) | (b >> np.uint64(41))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def grams(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each ``size`` words in a row, from hashes of the words."""
    have, h = 1, words
    parts = [(h, 1)] if size & 1 else []
    while have * 2 <= size:
        h, have = mixed(h[: max(0, len(h) - have)], h[have:], seed), have * 2
        if size & have:
            parts.append((h, have))
    n, at, out = len(words) - size + 1, 0, None
    for part, width in reversed(parts):
        here = part[at : at + max(0, n)]
        out, at = here if out is None else mixed(out, here, seed), at + width
    return out


def pieces(text: bytes):
    """Parts of a text that cut no word."""
    at = 0
    while at < len(text):
        m = BLANK.search(text, at + PIECE)
        yield text[at : m.start() if m else len(text)]
        at = m.start() if m else len(text)


def squeezed(x: bytes | np.ndarray) -> bytes:
    """Compressed; numbers byte by byte of their place, since most are small."""
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueezed(b: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


BATCHES = "batch bigint, bytes bigint, ids binary, sizes binary, names binary, vocabulary binary"


def word_batches(docs: DataFrame) -> DataFrame:
    """Rows of whole documents (``id, text``), of about ``BATCH_BYTES`` or one document that is longer: ids, how many words
    each has, the words as numbers, and the words that these stand for."""
    import pyarrow as pa

    arrow = arrow_schema(BATCHES)
    most = BATCH_BYTES

    def run(found):
        number = TaskContext.get().partitionId() << 36
        ids, sizes, names, size = [], [], [], 0
        numbers = defaultdict()
        numbers.default_factory = numbers.__len__

        def row():
            nonlocal number, ids, sizes, names, size
            number += 1
            every = np.concatenate([np.empty(0, dtype="<i4"), *names])
            cols = [number - 1, size, np.array(ids, dtype="<i8").tobytes(), np.array(sizes, dtype="<i8").tobytes(), squeezed(every), squeezed(b" ".join(numbers))]
            ids, sizes, names, size = [], [], [], 0
            numbers.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in found:
            for doc, text in zip(values(batch.column("id")), values(batch.column("text"), binary=True), strict=True):
                ids.append(NO_ID if doc is None else doc)
                sizes.append(0)
                for piece in pieces(text or b""):
                    own = piece.split()
                    names.append(np.fromiter(map(numbers.__getitem__, own), dtype="<i4", count=len(own)))
                    sizes[-1] += len(own)
                size += len(text or b"")
                if size >= most:
                    yield row()
        if ids:
            yield row()

    return docs.mapInArrow(run, BATCHES)


@dataclass
class Words:
    """The words of documents laid end to end, and their anchors."""

    ids: np.ndarray
    starts: np.ndarray  # of documents, and the end
    names: np.ndarray  # of each word, its place in the vocabulary
    vocabulary: list[bytes]
    known: dict[int, np.ndarray] = field(default_factory=dict)  # hashes of so many words

    @staticmethod
    def of(row: dict) -> Words:
        vocabulary = zstandard.ZstdDecompressor().decompress(row["vocabulary"])
        sizes = np.frombuffer(row["sizes"], dtype="<i8")
        return Words(np.frombuffer(row["ids"], dtype="<i8"), np.r_[0, np.cumsum(sizes)], unsqueezed(row["names"], "<i4"), vocabulary.split(b" ") if vocabulary else []).find_anchors()

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self.vocabulary), dtype=np.uint64, count=len(self.vocabulary))[self.names]

    def find_anchors(self) -> Words:
        """``at``: places of anchors, ``doc``: the index of the document of each."""
        self.at = np.empty(0, dtype=np.int64)
        if len(self.names) >= WINDOW:
            h = np.maximum(self.grams(SHORT), np.uint64(1))  # 0 marks windows that pick nothing
            least = sliding(h, BACK + 1, np.minimum)[: len(self.names) - WINDOW + 1]
            for stop in self.starts[1:].tolist():
                least[max(stop - WINDOW + 1, 0) : stop] = 0  # no window reaches over a document's end
            edge = np.zeros(BACK, dtype=h.dtype)
            picked = sliding(np.concatenate([edge, least, edge]), BACK + 1, np.maximum)
            self.at = np.flatnonzero((picked == h[: len(picked)]) & (picked > 0))
        self.doc = np.searchsorted(self.starts, self.at, side="right") - 1
        return self

    def grams(self, size: int) -> np.ndarray:
        if size not in self.known:
            self.known[size] = grams(self.hashes, size)
        return self.known[size]

    def prefixes(self, size: int) -> np.ndarray:
        """A hash of the ``size`` words from each anchor on."""
        return self.grams(size)[self.at] if len(self.at) else np.empty(0, dtype=np.uint64)

    def contexts(self, which: np.ndarray, level: np.ndarray) -> np.ndarray:
        """For each of the anchors: its level, and the names of the words around it, -1 where the document has none."""
        at, doc = self.at[which], self.doc[which]
        rows = np.full((len(at), AROUND + 1), -1, dtype=np.int32)
        rows[:, AROUND] = level
        span = np.arange(-BACK, WINDOW)
        for a in range(0, len(at), 1 << 14):
            place = at[a : a + (1 << 14), None] + span
            inside = (place >= self.starts[doc[a : a + (1 << 14)], None]) & (place < self.starts[doc[a : a + (1 << 14)] + 1, None])
            rows[a : a + (1 << 14), :AROUND][inside] = self.names[place[inside]]
        return rows

    def windows(self, which: np.ndarray) -> np.ndarray:
        """Places where windows around the anchors begin."""
        first = np.maximum(self.at[which] - BACK, self.starts[self.doc[which]])
        last = np.minimum(self.at[which], self.starts[self.doc[which] + 1] - WINDOW)
        change = np.zeros(len(self.names) + 1, dtype=np.int32)
        np.add.at(change, first, 1)
        np.add.at(change, last + 1, -1)
        return np.flatnonzero(np.cumsum(change) > 0)


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a matrix, and of each row which one it is."""
    if not len(rows):
        return rows, np.empty(0, dtype=np.int64)
    whole = np.ascontiguousarray(rows)
    own, of = np.unique(whole.view(f"V{whole.shape[1] * whole.itemsize}").ravel(), return_inverse=True)
    return own.view(whole.dtype).reshape(-1, whole.shape[1]), of


def smallest(of: np.ndarray, n: int, ids: np.ndarray) -> np.ndarray:
    """Of each of ``n`` groups the smallest id."""
    out = np.full(n, NO_ID)
    np.minimum.at(out, of, ids)
    return out


def shard_count(total: int) -> int:
    """Shards of groups for so many bytes: of ``SHARD_ANCHORS`` while a batch has ``ROW_ANCHORS`` for each, then as many,
    the shards growing to ``MOST_ANCHORS``, then of that size."""
    of = lambda size: size // ANCHOR_BYTES
    return max(8, min(of(total) // SHARD_ANCHORS, max(of(BATCH_BYTES) // ROW_ANCHORS, of(total) // MOST_ANCHORS)) + 1)


def counted(batch: int, hashes: np.ndarray, doc: np.ndarray, shards: int):
    """For each shard: a batch's distinct prefixes (40 bits of their hashes), which are in several of its documents, how
    often each is there (at most 255 times)."""
    own, of, count = np.unique(hashes, return_inverse=True, return_counts=True)
    first, last = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), -1)
    np.minimum.at(first, of, doc)
    np.maximum.at(last, of, doc)
    found = by_shard(shard_of(own, shards))
    yield {
        "shard": [s for s, _ in found],
        "batch": [batch] * len(found),
        "prefixes": [np.ascontiguousarray((own[i] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes() for _, i in found],
        "several": [np.packbits(first[i] != last[i]).tobytes() for _, i in found],
        "counts": [packed(np.minimum(count[i], 255).astype(np.uint8)) for _, i in found],
    }


SENT = "shard bigint, batch bigint, prefixes binary, several binary, counts binary"
VERDICT = "batch bigint, from_shard bigint, shared binary, large binary"


def judged_prefixes(most: int):
    """Which prefixes of each batch two documents have, and which have more than ``most`` suffixes. Two that agree in 40
    bits and shard only cost time."""

    def fn(rows: list[dict]) -> dict:
        own, several, counts = [], [], []
        for r in rows:
            raw = np.frombuffer(r["prefixes"], dtype=np.uint8).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), dtype=np.uint8)
            wide[:, :5] = raw
            own.append(wide.view("<u8").ravel())
            several.append(np.unpackbits(np.frombuffer(r["several"], dtype=np.uint8), count=len(raw)).astype(bool))
            counts.append(unpacked(r["counts"], np.uint8))
        _, of, batches = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = batches >= 2
        shared[of[np.concatenate(several)]] = True
        large = shared & (np.bincount(of, weights=np.concatenate(counts)) > most)
        ends = np.cumsum([len(a) for a in own])[:-1]
        bits = lambda flags: [np.packbits(x).tobytes() for x in np.split(flags[of], ends)]
        return {"batch": [r["batch"] for r in rows], "from_shard": [r["shard"] for r in rows], "shared": bits(shared), "large": bits(large)}

    return fn


def verdicts(hashes: np.ndarray, found: list | None, shards: int) -> np.ndarray:
    """Of each anchor, by its prefix: 0 in one document only, 1 shared, 2 in a group that is too large."""
    own, of = np.unique(hashes, return_inverse=True)
    out = np.zeros(len(own), dtype=np.int64)
    bits = {v["from_shard"]: v for v in found or ()}
    for s, i in by_shard(shard_of(own, shards)):
        for name in ("shared", "large"):
            out[i] += np.unpackbits(np.frombuffer(bits[s][name], dtype=np.uint8), count=len(i))
    return out[of]


def levels(words: Words, row: dict, shards: int) -> np.ndarray:
    """Of each anchor: 0 not shared, 1 grouped by its short prefix, 2 by its long one, 3 by whole windows."""
    level = verdicts(words.prefixes(SHORT), row["short"], shards)
    large = np.flatnonzero(level == 2)
    if len(large):
        longer = verdicts(words.prefixes(LONG)[large], row["long"], shards)
        level[large] = np.where(longer > 0, longer + 1, 0)
    return level


def send_short(shards: int):
    def fn(row):
        words = Words.of(row)
        yield from counted(row["batch"], words.prefixes(SHORT), words.doc, shards)

    return fn


def send_long(shards: int):
    """Of anchors in groups that are too large, the long prefixes."""

    def fn(row):
        words = Words.of(row)
        large = np.flatnonzero(verdicts(words.prefixes(SHORT), row["short"], shards) == 2)
        if len(large):
            yield from counted(row["batch"], words.prefixes(LONG)[large], words.doc[large], shards)

    return fn


@dataclass
class Sent:
    """What a batch sends: distinct contexts, and distinct windows of groups that no prefix splits; each with its smallest
    id and its shard, and which one each anchor or place has."""

    contexts: np.ndarray
    of: np.ndarray
    anchors: np.ndarray
    least: np.ndarray
    shard: np.ndarray
    windows: np.ndarray  # two hashes each
    window_of: np.ndarray
    places: np.ndarray
    window_least: np.ndarray
    window_shard: np.ndarray

    @staticmethod
    def by(words: Words, row: dict, shards: int) -> Sent:
        level = levels(words, row, shards)
        some = np.flatnonzero((level == 1) | (level == 2))
        contexts, of = distinct_rows(words.contexts(some, level[some]))
        shard = np.zeros(len(contexts), dtype=np.int64)
        if len(some):
            shard[of] = shard_of(np.where(level[some] == 1, words.prefixes(SHORT)[some], words.prefixes(LONG)[some]), shards)
        places = words.windows(np.flatnonzero(level == 3))
        pair = np.stack([grams(words.hashes, WINDOW, seed)[places] for seed in (1, 2)], axis=1) if len(places) else np.empty((0, 2), dtype=np.uint64)
        windows, window_of = distinct_rows(pair)
        doc = np.searchsorted(words.starts, places, side="right") - 1
        return Sent(contexts, of, some, smallest(of, len(contexts), words.ids[words.doc[some]]), shard, windows, window_of, places, smallest(window_of, len(windows), words.ids[doc]), shard_of(windows[:, 0], shards))


def number_kind(vocabulary: list) -> str:
    """The numbers of its words, from 1; 0 is none."""
    return "<u2" if len(vocabulary) < (1 << 16) - 1 else "<u4"


def send_suffixes(shards: int):
    """Of a batch, for each shard: contexts as numbers of a vocabulary that is sent along, and windows."""

    def fn(row):
        words = Words.of(row)
        sent = Sent.by(words, row, shards)
        none = {"vocabulary": [b""]} | {k: [packed(np.empty(0, dtype=np.uint8))] for k in ("contexts", "levels", "least", "windows", "window_least")}
        own, other = dict(by_shard(sent.shard)), dict(by_shard(sent.window_shard))
        for s in sorted({*own, *other}):
            cols = {"shard": [s], "batch": [row["batch"]]} | none
            if s in own:
                rows = sent.contexts[own[s]]
                there = np.zeros(len(words.vocabulary) + 1, dtype=bool)
                there[rows[:, :AROUND] + 1] = True
                there[0] = False  # no word
                number = np.cumsum(there, dtype=np.int32)  # 0 for none, then those used from 1
                vocabulary = [words.vocabulary[w] for w in np.flatnonzero(there[1:]).tolist()]
                number[0] = 0
                cols |= {
                    "vocabulary": [squeezed(b" ".join(vocabulary))],
                    "contexts": [squeezed(number[rows[:, :AROUND] + 1].astype(number_kind(vocabulary)).ravel())],
                    "levels": [packed(rows[:, AROUND].astype(np.uint8))],
                    "least": [packed(sent.least[own[s]])],
                }
            if s in other:
                cols |= {"windows": [packed(sent.windows[other[s]])], "window_least": [packed(sent.window_least[other[s]])]}
            yield cols

    return fn


SUFFIXES = "shard bigint, batch bigint, vocabulary binary, contexts binary, levels binary, least binary, windows binary, window_least binary"


def children(nodes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node that each leaf comes to by a word from its node, and of each leaf whether another one is there too."""
    _, below, leaves = np.unique(nodes.astype(np.int64) * (int(words.max(initial=0)) + 1) + words, return_inverse=True, return_counts=True)
    return below.astype(np.int32), leaves[below] > 1


def subtree_minima(contexts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For distinct contexts (rows of words, 0 where there is none, the level last) with ids, the smallest id of a
    context that has the same window o words before the anchor, for each o; ``NO_ID`` where there is no such window or
    no other context has it."""
    out = np.full((len(contexts), BACK + 1), NO_ID)
    prefix = contexts[:, BACK : BACK + LONG].copy()
    prefix[contexts[:, AROUND] == 1, SHORT:] = 0
    _, group = distinct_rows(np.concatenate([prefix, contexts[:, AROUND:]], axis=1))
    count = np.bincount(group, minlength=1)
    some = np.flatnonzero(count[group] > 1) if len(group) else group
    if not len(some):
        return out
    rows, ids, group = np.ascontiguousarray(contexts[some].T), least[some], group[some].astype(np.int32)
    # on[t]: nodes of the suffixes from the anchors, t words deep, and leaves of branches that go on
    node, alive, on = group, np.ones(len(some), dtype=bool), {}
    for t in range(SHORT, WINDOW):
        live = np.flatnonzero(alive & (rows[BACK + t] > 0))
        alive = np.zeros(len(some), dtype=bool)
        below, several = children(node[live], rows[BACK + t][live])
        node = node.copy()
        node[live] = below
        alive[live] = several
        if t + 1 >= WINDOW - BACK:
            on[t + 1] = (node, alive)
    node, alive = group, np.ones(len(some), dtype=bool)
    for o in range(BACK + 1):
        if o:  # a word put in front
            live = np.flatnonzero(alive & (rows[BACK - o] > 0))
            alive = np.zeros(len(some), dtype=bool)
            below, several = children(node[live], rows[BACK - o][live])
            node = node.copy()
            node[live] = below
            alive[live] = several
        further, goes_on = on[WINDOW - o]
        both = np.flatnonzero(alive & goes_on)
        if not len(both):
            continue
        _, deep, leaves = np.unique(node[both].astype(np.int64) * (int(further.max(initial=0)) + 1) + further[both], return_inverse=True, return_counts=True)
        low = smallest(deep, len(leaves), ids[both])
        repeat = leaves[deep] > 1
        out[some[both[repeat]], o] = low[deep[repeat]]
    return out


def judge_suffixes(rows: list[dict]) -> dict:
    """For each context sent, a bit for each of its windows, and for each window sent one: whether a smaller id than the
    batch's has it somewhere."""
    numbers: dict[bytes, int] = {}
    sent, ids = [], []
    for r in rows:
        vocabulary = zstandard.ZstdDecompressor().decompress(r["vocabulary"]).split(b" ") if r["vocabulary"] else []
        to = np.r_[0, np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in vocabulary), dtype=np.int32, count=len(vocabulary))].astype(np.int32)
        own = unsqueezed(r["contexts"], number_kind(vocabulary)).reshape(-1, AROUND)
        sent.append(np.concatenate([to[own], unpacked(r["levels"], np.uint8).astype(np.int32)[:, None]], axis=1))
        ids.append(unpacked(r["least"], "<i8"))
    contexts, of = distinct_rows(np.concatenate(sent))
    every = np.concatenate(ids)
    least = smallest(of, len(contexts), every)
    low = np.minimum(subtree_minima(contexts, least), least[:, None])
    masks = np.zeros(len(of), dtype=np.uint64)
    for o in range(BACK + 1):
        masks |= (low[of, o] < every).astype(np.uint64) << np.uint64(o)
    windows, window_of = distinct_rows(np.concatenate([unpacked(r["windows"], "<u8") for r in rows]).reshape(-1, 2))
    window_ids = np.concatenate([unpacked(r["window_least"], "<i8") for r in rows])
    earlier = smallest(window_of, len(windows), window_ids)[window_of] < window_ids
    ends, window_ends = np.cumsum([len(x) for x in ids])[:-1], np.cumsum([len(unpacked(r["window_least"], "<i8")) for r in rows])[:-1]
    return {
        "batch": [r["batch"] for r in rows],
        "from_shard": [r["shard"] for r in rows],
        "masks": [packed(x) for x in np.split(masks, ends)],
        "earlier": [np.packbits(x).tobytes() for x in np.split(earlier, window_ends)],
    }


def removed_words(row: dict, shards: int) -> tuple[Words, np.ndarray]:
    """A batch's words and which of them go."""
    words = Words.of(row)
    sent = Sent.by(words, row, shards)
    masks, earlier = np.zeros(len(sent.contexts), dtype=np.uint64), np.zeros(len(sent.windows), dtype=bool)
    judged = {v["from_shard"]: v for v in row["judged"] or ()}
    for s, i in by_shard(sent.shard):
        masks[i] = unpacked(judged[s]["masks"], "<u8")
    for s, i in by_shard(sent.window_shard):
        earlier[i] = np.unpackbits(np.frombuffer(judged[s]["earlier"], dtype=np.uint8), count=len(i)).astype(bool)
    change = np.zeros(len(words.names) + 1, dtype=np.int32)
    at, doc = words.at[sent.anchors], words.doc[sent.anchors]
    later = words.ids[doc] > sent.least[sent.of]  # an earlier document of the batch has the whole context
    for o in range(BACK + 1):
        begin = at - o
        hit = (later | ((masks[sent.of] >> np.uint64(o)) & np.uint64(1)).astype(bool)) & (begin >= words.starts[doc]) & (begin + WINDOW <= words.starts[doc + 1])
        np.add.at(change, begin[hit], 1)
        np.add.at(change, begin[hit] + WINDOW, -1)
    doc = np.searchsorted(words.starts, sent.places, side="right") - 1
    hit = sent.places[(words.ids[doc] > sent.window_least[sent.window_of]) | earlier[sent.window_of]]
    np.add.at(change, hit, 1)
    np.add.at(change, hit + WINDOW, -1)
    return words, np.cumsum(change)[:-1] > 0


def results(shards: int, with_text: bool):
    def fn(row):
        words, gone = removed_words(row, shards)
        cols: dict[str, list] = {k: [] for k in ("id", "n_words", "n_removed", "n_spans", "kept_sha256", "text")}
        for doc, a, b in zip(words.ids.tolist(), words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
            own = gone[a:b]
            kept = words.names[a:b][~own].tolist()
            text = b" ".join([words.vocabulary[k] for k in kept])
            cols["id"].append(None if doc == NO_ID else doc)
            cols["n_words"].append(b - a)
            cols["n_removed"].append(b - a - len(kept))
            cols["n_spans"].append(int(np.count_nonzero(own[1:] & ~own[:-1])) + int(b > a and own[0]))
            cols["kept_sha256"].append(hashlib.sha256(text).hexdigest())
            if with_text:
                cols["text"].append(text.decode())
        yield cols

    return fn


def _verdicts(sent: DataFrame, most: int, name: str) -> DataFrame:
    """A row for each batch with the judged prefixes of each shard."""
    found = each_shard(sent, judged_prefixes(most), VERDICT)
    return written(found.groupBy("batch").agg(F.collect_list(F.struct("from_shard", "shared", "large")).alias(name)), f"words-{name}")  # one for each shard


def without_repeated_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, most: int = MOST) -> DataFrame:
    """``id_col, n_words, n_removed, n_spans, kept_sha256`` of each document and, with ``with_text``, ``text``: the words
    that stay, joined by single blanks. ``most``: suffixes of a group before it is split by a longer prefix.

    Words ``[^\\x20\\x09-\\x0D]+`` are compared as they are. Null texts have no words; texts under 50 words stay whole, and
    very long ones are batches of their own. Documents with equal ids take nothing from each other; one with a null id
    loses what any numbered document has and takes nothing. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    batches = in_buckets(word_batches(source), "words_batches", "batch")
    shards = shard_count(int(batches.agg(F.sum("bytes")).first()[0] or 0))
    short = _verdicts(each_row(batches, send_short(shards), SENT), most, "short")
    known = batches.join(short, "batch", "left")
    split = short.where(F.exists("short", lambda v: F.hex(v["large"]).rlike("[^0]")))
    if split.limit(1).count():
        known = known.join(_verdicts(each_row(known, send_long(shards), SENT), most, "long"), "batch", "left")
    else:
        known = known.withColumn("long", F.lit(None).cast(short.schema["short"].dataType))
    sent = each_row(known, send_suffixes(shards), SUFFIXES)
    judged = each_shard(sent, judge_suffixes, "batch bigint, from_shard bigint, masks binary, earlier binary")
    of_batch = judged.groupBy("batch").agg(F.collect_list(F.struct("from_shard", "masks", "earlier")).alias("judged"))
    out = each_row(known.join(of_batch, "batch", "left"), results(shards, with_text), "id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text string" * with_text)
    return out.withColumnRenamed("id", id_col)


def op12_prefix_subtrees(docs: DataFrame) -> DataFrame:
    """Digest per document; see ``without_repeated_words``."""
    return without_repeated_words(docs).drop("n_spans")


#: Windows as joined words, the smallest id of each, and the places that windows of larger ids cover.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT doc_id, rid, i, sha256(array_to_string(w[i : i + 49], ' ')) AS win FROM (SELECT doc_id, rid, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT win, min(doc_id) AS first_id FROM o GROUP BY win),
h AS (SELECT rid, i FROM o JOIN f USING (win) WHERE coalesce(doc_id > first_id, first_id IS NOT NULL)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS i FROM h),
p AS (SELECT rid, w[i] AS word, i FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT rid, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) AS BIGINT) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
