"""Suffix sorting by induction, with queues that spill to disk.

Sorted suffixes are induced from the sorted LMS suffixes (those that begin where the text starts to rise): the queue
delivers suffixes by first character, and each one delivered hands its predecessor in the text to the queue under
that one's character. Induction runs twice, first to sort and name the LMS substrings, then, with the names sorted
by doubling where they repeat, to sort all suffixes. Items of one character move together as arrays.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of queued items held in memory; further ones go to a temporary file that vanishes with the queue.
MEMORY = 96 << 20


class SpillingQueue:
    """A monotone priority queue of text positions: first in, first out within each character."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.file = memory, 0, None
        self.chunks: dict[int, list] = {}

    def put(self, chars: np.ndarray, at: np.ndarray) -> None:
        if not len(at):
            return
        order = np.argsort(chars, kind="stable")
        chars, at = chars[order], at[order]
        edges = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=True):
            part = at[a:b].copy()
            if self.held + part.nbytes > self.memory:
                self.file = self.file or tempfile.TemporaryFile()
                self.file.seek(0, 2)
                entry = (self.file.tell(), len(part), part.dtype)
                self.file.write(part.tobytes())
                self.chunks.setdefault(int(chars[a]), []).append(entry)
            else:
                self.held += part.nbytes
                self.chunks.setdefault(int(chars[a]), []).append(part)

    def take(self, char: int) -> np.ndarray | None:
        """All items of a character, in order."""
        out = []
        for c in self.chunks.pop(char, ()):
            if isinstance(c, tuple):
                self.file.seek(c[0])
                c = np.frombuffer(self.file.read(c[1] * c[2].itemsize), dtype=c[2])
            else:
                self.held -= c.nbytes
            out.append(c)
        return np.concatenate(out) if out else None


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (S-type); the last one counts as such."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    out = np.ones(n, dtype=bool)
    if len(change):
        out[: change[-1] + 1] = np.repeat(text[change] < text[change + 1], np.diff(np.r_[-1, change]))
    return out


def induce(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, memory: int) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes in an order that sorts them within each first character."""
    present = np.flatnonzero(np.bincount(text)).tolist()

    def sweep(chars: list[int], own: SpillingQueue, extra: dict[int, np.ndarray], kind: bool) -> dict[int, np.ndarray]:
        """Delivers characters in order; ``extra`` of a character follows its queued suffixes. Returns those of ``kind``."""
        done: dict[int, np.ndarray] = {}
        for c in chars:
            parts, now = [], own.take(c)
            while now is not None and len(now):
                parts.append(now)
                before = now[now > 0] - 1
                before = before[s_type[before] == kind]
                of = text[before]
                same = of == c
                own.put(of[~same], before[~same])
                now = before[same]
            if parts:
                done[c] = np.concatenate(parts)
            if (more := extra.get(c)) is not None:
                before = more[more > 0] - 1
                before = before[s_type[before] == kind]
                own.put(text[before], before)
        return done

    def by_char(at: np.ndarray) -> dict[int, np.ndarray]:
        of = text[at]
        order = np.argsort(of, kind="stable")
        at, of = at[order], of[order]
        edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(at) else np.array([], dtype=int)
        return {int(of[a]): at[a:b] for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=False)}

    falling = sweep(present, SpillingQueue(memory), by_char(lms), False)
    rest = sweep(present[::-1], SpillingQueue(memory), {c: v[::-1] for c, v in falling.items()}, True)
    out = []
    for c in present:
        if c in falling:
            out.append(falling[c])
        if c in rest:
            out.append(rest[c][::-1])
    # the last suffix has no successor to induce it; it is the smallest of its character
    last = len(text) - 1
    return np.concatenate([np.array([last], dtype=lms.dtype), *out])


def named(text: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings (equal ones alike), in text order; ``order``: the LMS positions, sorted by substring."""
    length = np.zeros(len(text), dtype=np.int32)
    length[lms] = np.r_[np.diff(lms) + 1, 1]
    a, b = order[:-1], order[1:]
    equal = length[a] == length[b]
    open_ = np.flatnonzero(equal)
    k = 0
    while len(open_):
        x, y = a[open_] + k, b[open_] + k
        same = text[x] == text[y]
        equal[open_[~same]] = False
        open_ = open_[same]
        k += 1
        open_ = open_[length[a[open_]] > k]
    ranks = np.zeros(len(text), dtype=np.int64)
    ranks[order] = np.cumsum(np.r_[0, ~equal])
    return ranks[lms]


def doubled(names: np.ndarray, symbols: int) -> np.ndarray:
    """Indices sorted by the sequences of names that follow them, as far as ``symbols`` names."""
    rank, span = names, 1
    n = len(names)
    while True:
        if int(rank.max(initial=0)) + 1 == n or span >= symbols:
            return np.argsort(rank, kind="stable")
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(n - span, 0)] = rank[span:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        rank, span = new, span * 2


def suffix_order(text: np.ndarray, depth: int, memory: int = MEMORY) -> np.ndarray:
    """Positions of all suffixes of ``text`` (unsigned integers, the last one the only zero) in the order of their first
    ``depth`` symbols at least. Suffixes that agree so far stand together."""
    s_type = rising(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]).astype(np.int32) + 1
    if not len(lms):
        lms = np.array([len(text) - 1], dtype=np.int32)
    first = induce(text, s_type, lms, memory)
    is_lms = np.zeros(len(text), dtype=bool)
    is_lms[lms] = True
    names = named(text, first[is_lms[first]], lms)
    # an LMS substring spans two symbols at least
    order = lms[doubled(names, depth // 2 + 1)]
    return induce(text, s_type, order, memory)
