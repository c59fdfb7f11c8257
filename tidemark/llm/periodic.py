"""Periodic runs of words: maximal stretches in which every word equals the one a period before it.

A run of period p that is two periods long holds a word i, a multiple of p, whose successor i + p it holds too, and
these two are equal. So for each period there is a grid of places to look at, n / p of them, and n ln n in all. The
common extensions of (i, i + p) to both sides are found by binary search over prefix hashes, for all pairs of a block
at once; they say where the run begins and ends. Runs found for several periods are one run of the smallest period.
The words of every run are compared; where a hash erred, the texts go again with exact names of all stretches of 1, 2,
4 ... words in place of hashes.

Several short texts are laid end to end and searched together; a pair never reaches over a text's end.
"""

from __future__ import annotations

import binascii
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, schema_of, values

#: A run has this many words at least, and two periods.
LEAST = 12
#: Words of texts searched together, unless one text has more; pairs looked at together.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 18
#: Runs longer than this save the search inside them for multiples of their period.
LONG = 256
#: An odd number; powers of it place words in hashes modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)

#: Number of text, start, length, period.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: (i, j, most) -> how many words from i and j on are equal, at most ``most`` of them; and the same backwards from i - 1, j - 1.
Extensions = tuple[Callable, Callable]


def scattered(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value for each id, as if at random."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * BASE
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def by_hashes(ids: np.ndarray) -> Extensions:
    """Extensions by binary search over prefix hashes. A result may be too long where hashes collide, never too short."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(ids), BASE)])
        prefix = np.r_[np.uint64(0), np.cumsum(scattered(ids) * power[:-1])]

    def search(i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()  # what is equal for certain, what may be
        open_ = np.flatnonzero(high > 0)
        while len(open_):
            middle = (low[open_] + high[open_] + 1) >> 1
            a, b = (i[open_] - middle, j[open_] - middle) if back else (i[open_], j[open_])
            with np.errstate(over="ignore"):
                same = (prefix[a + middle] - prefix[a]) * power[b - a] == prefix[b + middle] - prefix[b]
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)
            open_ = open_[low[open_] < high[open_]]
        return low

    return lambda i, j, most: search(i, j, most, False), lambda i, j, most: search(i, j, most, True)


def by_names(ids: np.ndarray) -> Extensions:
    """Exact extensions from a name for every stretch of 1, 2, 4 ... words; takes n log n space."""
    names, width = [np.unique(ids, return_inverse=True)[1].astype(np.int64)], 1
    while width * 2 <= len(ids):
        last = names[-1]
        names.append(np.unique(last[: len(last) - width] * len(ids) + last[width:], return_inverse=True)[1])
        width *= 2

    def search(i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        got = np.zeros_like(most)
        for level in range(len(names) - 1, -1, -1):
            step = 1 << level
            for _ in range(2 if level == len(names) - 1 else 1):
                some = np.flatnonzero(got + step <= most)
                a, b = (i[some] - got[some] - step, j[some] - got[some] - step) if back else (i[some] + got[some], j[some] + got[some])
                got[some[names[level][a] == names[level][b]]] += step
        return got

    return lambda i, j, most: search(i, j, most, False), lambda i, j, most: search(i, j, most, True)


def grid(sizes: np.ndarray, starts: np.ndarray, ids: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text, place i, period) by rising period in each text: multiples i of each period, counted from the
    text's start, that can be in a run. Texts of one size share their grid.

    A run has max(p, 12 - p) words or more in a row that equal the one p later, so one of them is on the grid, and in a
    row of so many the one half as many before or after it is there too.
    """
    end = len(ids) - 1
    for n in np.unique(sizes[sizes >= LEAST]).tolist():
        texts = np.flatnonzero(sizes == n)
        periods = np.arange(1, n // 2 + 1)
        last = np.cumsum((n - 1) // periods)  # pairs up to each period: i + p < n
        group = max(1, at_once // int(last[-1]))
        for first in range(0, len(texts), group):
            some = texts[first : first + group]
            for begin in range(0, int(last[-1]), at_once):
                t = np.arange(begin, min(begin + at_once, int(last[-1])))
                which = np.searchsorted(last, t, side="right")
                p = periods[which]
                i = (t - (last[which] - (n - 1) // p)) * p
                row, pair = np.nonzero(ids[starts[some][:, None] + i] == ids[starts[some][:, None] + i + p])
                text, p = some[row], p[pair]
                place = starts[text] + i[pair]
                least = np.maximum(p, LEAST - p)
                on, back = place + least // 2, place - (least - least // 2)
                can = ids[np.minimum(on, end)] == ids[np.minimum(on + p, end)]
                can |= ids[np.maximum(back, 0)] == ids[np.maximum(back + p, 0)]
                if can.any():
                    yield text[can], place[can], p[can]


class Covered:
    """For each place the long run last found that holds it: pairs inside one, whose period is a multiple of its, say
    nothing new."""

    def __init__(self, n: int):
        self.end, self.period = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)

    def new(self, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (i + p >= self.end[i]) | (p % self.period[i] != 0)

    def add(self, begin: np.ndarray, length: np.ndarray, period: np.ndarray) -> None:
        for a, n, p in zip(begin.tolist(), length.tolist(), period.tolist(), strict=True):
            if n > LONG and not (self.end[a] >= a + n and p % self.period[a] == 0):
                self.end[a : a + n], self.period[a : a + n] = a + n, p


def found_runs(ids: np.ndarray, sizes: np.ndarray, extensions: Callable[[np.ndarray], Extensions], at_once: int = PAIRS_AT_ONCE) -> tuple[Runs, bool]:
    """The runs of texts laid end to end, by text, start and period, with starts counted from the text's own, and whether
    all that was found is so."""
    starts = np.r_[0, np.cumsum(sizes)]
    found = [np.empty((0, 4), dtype=np.int64)]
    forward, backward = extensions(ids)
    covered = Covered(len(ids))
    for text, i, p in grid(sizes, starts, ids, at_once):
        new = covered.new(i, p)
        text, i, p = text[new], i[new], p[new]
        after = forward(i, i + p, starts[text + 1] - i - p)
        before = backward(i, i + p, i - starts[text])
        length = before + after + p
        some = np.flatnonzero(length >= np.maximum(LEAST, 2 * p))
        rows = np.unique(np.stack([text[some], i[some] - before[some], length[some], p[some]], axis=1), axis=0)
        covered.add(*rows[:, 1:].T)
        found.append(rows)
    rows = np.unique(np.concatenate(found), axis=0)
    text, begin, length, period = rows.T
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])
    # the first of equal stretches has the smallest period; other periods of it are multiples of that
    right = not (period % period[new][np.cumsum(new) - 1]).any()
    text, begin, length, period = text[new], begin[new], length[new], period[new]
    for a, size, p in zip(begin.tolist(), length.tolist(), period.tolist(), strict=True):
        right = right and np.array_equal(ids[a : a + size - p], ids[a + p : a + size])
    order = np.lexsort((period, begin, text))
    return (text[order], begin[order] - starts[text[order]], length[order], period[order]), right


def runs_of(texts: list[np.ndarray], extensions: Callable[[np.ndarray], Extensions] = by_hashes) -> list[list[tuple[int, int, int]]]:
    """For each text (ids of its words), its runs: (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    k = 0
    while k < len(texts):
        last, size = k, 0
        while last < len(texts) and (last == k or size + len(texts[last]) <= WORDS_AT_ONCE):
            size += len(texts[last])
            last += 1
        if size:
            sizes = np.array([len(t) for t in texts[k:last]])
            ids = np.concatenate(texts[k:last]).astype(np.int64)
            runs, right = found_runs(ids, sizes, extensions)
            if not right:
                runs, _ = found_runs(ids, sizes, by_names)
            for t, *run in zip(*(x.tolist() for x in runs), strict=True):
                out[k + t].append(tuple(run))
        k = last
    return out


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run is cut down to its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def with_a_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the contract of ``op13_harmonic_grid`` has them: every tenth text ends in repetitions."""
    h = binascii.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(docs: DataFrame, *, keep: list[str], text_col: str = "text", change: Callable[[list[bytes], int | None], list[bytes]] | None = None, id_col: str | None = None) -> DataFrame:
    """The columns ``keep`` with ``n_words, runs, collapsed``: the runs of each text, by start and period, and its words,
    joined by single blanks, without those that any run holds after its first period. ``change`` is applied to the
    words (and the value of ``id_col``) first.

    Null, empty and blank texts, and those of fewer than 12 words, have no runs; a null text's ``collapsed`` is empty.
    Words are compared as they are. A text of n words takes n ln n steps and memory in proportion to n, whatever it
    repeats. Map-only: repeated rows give equal results, and an empty table gives no rows. ``keep`` may not name a
    column that is made here.
    """
    out = schema_of(docs, *keep, more=f"n_words bigint, runs array<{RUN}>, collapsed string")
    read = docs.select(*keep, F.col(text_col).cast("string").alias("__text"), (F.col(id_col).cast("bigint") if id_col else F.lit(None).cast("bigint")).alias("__id"))

    def make():
        def fn(batch):
            cols: dict[str, list] = {"n_words": [], "runs": [], "collapsed": []}
            ids: dict[bytes, int] = {}
            held: list[list[bytes]] = []

            def flush():
                texts = [np.fromiter((ids.setdefault(w, len(ids)) for w in own), dtype=np.int64, count=len(own)) for own in held]
                for own, found in zip(held, runs_of(texts), strict=True):
                    stays = collapsed(len(own), found).tolist() if found else itertools.repeat(True)
                    cols["n_words"].append(len(own))
                    cols["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    cols["collapsed"].append(b" ".join(itertools.compress(own, stays)).decode())
                ids.clear()
                held.clear()

            size = 0
            for text, doc in zip(values(batch.column("__text"), binary=True), values(batch.column("__id")), strict=True):
                own = (text or b"").split()
                held.append(change(own, doc) if change else own)
                size += len(own)
                if size >= WORDS_AT_ONCE:
                    flush()
                    size = 0
            flush()
            return {k: batch.column(k) for k in keep} | cols

        return fn

    return map_rows(read, make, out)


def longest_run(runs: Column) -> Column:
    """The run with the greatest length, of these the one that starts first, of these the one with the smallest period."""
    rank = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))
    return F.array_min(F.transform(runs, rank))


def op13_harmonic_grid(docs: DataFrame) -> DataFrame:
    """Digest per document; see ``periodic_runs``. A document with a null id is taken as it is."""
    found = periodic_runs(docs, keep=["doc_id"], change=with_a_period, id_col="doc_id").withColumn("__longest", longest_run(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    best = F.col("__longest")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * __longest.length) div __longest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def runs_digest(runs: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
