"""Packing of tokenized documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's tokens are cut into full windows, each a sequence of its own, and a rest, which is cut into pieces of
at most ``piece`` tokens. Pieces of about ``block_windows`` windows form a block: differencing repeatedly merges
the two partial partitions with the largest spread, the largest window of one with the smallest of the other, so
that imbalances cancel; if a window exceeds the capacity, the block is packed anew with one window more.

Each task packs what it reads, block by block, so nothing is shuffled and a lost task is redone alone.
"""

from __future__ import annotations

import functools
import heapq
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, schema_of, values

CAPACITY = 2048
END_ID = 1
PIECE = 512
BLOCK_WINDOWS = 256
SPECIAL = "<|endoftext|>"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` windows of near-equal sums (windows may be empty)."""
    # a partial partition: sums that are not zero, largest first, and a tree of indices for each
    heap = [(-s, i, np.array([s]), [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            sums, trees = np.concatenate([a, b]), ta + tb
        else:  # the smallest `over` of a meet the smallest of b, small with large
            free_a, free_b = len(a) - over, len(b) - over
            sums = np.concatenate([a[:free_a], b[:free_b], a[free_a:] + b[free_b:][::-1]])
            trees = ta[:free_a] + tb[:free_b] + list(zip(ta[free_a:], reversed(tb[free_b:]), strict=True))
        order = np.argsort(-sums, kind="stable")
        sums, trees = sums[order], [trees[j] for j in order.tolist()]
        spread = int(sums[0] - sums[-1]) if len(sums) == k else int(sums[0])
        n += 1
        heapq.heappush(heap, (-spread, n, sums, trees))
    out = []
    for tree in heap[0][3] if heap else []:
        found, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                found.append(x)
        out.append(sorted(found))
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``; their count starts at the least possible and rises when one is exceeded."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        out = [w for w in difference(sizes, k) if w]
        if max(sum(sizes[i] for i in w) for w in out) <= capacity:
            return out
        k += 1


def cut(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then near-equal parts of the rest."""
    full = [(i, capacity) for i in range(0, n - capacity + 1, capacity)]
    at, rest = len(full) * capacity, n % capacity
    parts = -(-rest // piece)
    cuts = [at + rest * i // parts for i in range(parts + 1)] if parts else []
    return full + [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.cache
def encoders(name: str, ranks: str | None):
    """A function from a text to ids. With ``ranks`` (the same vocabulary as ranks), the faster library encodes all
    texts but those that hold the special token, which only the tokenizer's own file knows."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(name))
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    if ranks is None:
        return slow
    import base64

    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: slow(text) if SPECIAL in text else fast.encode_ordinary(text)


def packed(docs: DataFrame, *, keep: list[str], text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY, piece: int = PIECE, block_windows: int = BLOCK_WINDOWS, with_ids: bool = False) -> DataFrame:
    """A row for each piece: the columns ``keep``, ``start, length, ids_crc32, doc_tokens, sequence_id, offset`` and,
    with ``with_ids``, ``ids``.

    Every document ends with id 1; null and empty texts have only that one. Very long texts give many full windows.
    Repeated rows are packed each. Sequence ids hold the task's number in their upper bits and are unique.
    """
    out = schema_of(docs, *keep, more="start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids)
    arrow = arrow_schema(out)

    def run(batches):
        import pyarrow as pa

        encode = encoders(tokenizer, ranks)
        sequence = TaskContext.get().partitionId() << 36
        wait: list[tuple] = []  # kept values, start, ids, document's tokens
        waiting = 0
        done: list[tuple] = []  # a waiting piece, sequence, offset

        def pack():
            nonlocal sequence, waiting, wait
            for window in windows([len(w[2]) for w in wait], capacity):
                offset = 0
                for i in window:
                    done.append((wait[i], sequence, offset))
                    offset += len(wait[i][2])
                sequence += 1
            wait, waiting = [], 0

        def flush():
            nonlocal done
            cols = {k: [d[0][0][j] for d in done] for j, k in enumerate(keep)}
            cols |= {"start": [d[0][1] for d in done], "length": [len(d[0][2]) for d in done], "ids_crc32": [zlib.crc32(d[0][2].tobytes()) for d in done], "doc_tokens": [d[0][3] for d in done], "sequence_id": [d[1] for d in done], "offset": [d[2] for d in done], "ids": [d[0][2] for d in done]}
            done = []
            return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for *kept, text in zip(*(values(batch.column(k)) for k in (*keep, "__text")), strict=True):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                for start, length in cut(len(ids), capacity, piece):
                    part = (kept, start, ids[start : start + length], len(ids))
                    if length == capacity:
                        done.append((part, sequence, 0))
                        sequence += 1
                    else:
                        wait.append(part)
                        waiting += length
                if waiting >= block_windows * capacity:
                    pack()
                if len(done) >= 4096:
                    yield flush()
        pack()
        if done:
            yield flush()

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, out)


def op8_differencing(docs: DataFrame) -> DataFrame:
    """Digest per piece; see ``packed``."""
    return packed(docs, keep=["doc_id"])
