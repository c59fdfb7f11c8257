"""License scans: fuzzy search for short notices.

A notice of which up to k edits are allowed is cut into k + 1 pieces; an occurrence with at most k edits holds one
of them unchanged (pigeonhole). Exact search for the pieces locates candidate windows, in which the ``regex``
library's bounded-error matching verifies the edits and reports the span.

A piece says where its notice begins, but for the edits before it, so a window is as long as the notice and a few
characters more, whatever the words around it; nothing is matched where no word begins near that place.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, map_rows, schema_of, values


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    base: bool = False

    @property
    def edits(self) -> int:
        """One edit for each eight letters after the first eight, at most three; short phrases must be exact."""
        return max(0, min(3, len(self.phrase) // 8 - 1))


#: The base phrases, then further short notices (lower-case words).
NOTICES = (
    Notice("under the mit license", "mit", True),
    Notice("apache license version 2", "apache-2", True),
    Notice("cc by nc", "cc-by-nc", True),
    Notice("gnu general public license version 2", "gpl-2"),
    Notice("gnu general public license version 3", "gpl-3"),
    Notice("gnu lesser general public license", "lgpl"),
    Notice("gnu affero general public license", "agpl"),
    Notice("mozilla public license version 2", "mpl-2"),
    Notice("eclipse public license", "epl"),
    Notice("redistribution and use in source and binary forms", "bsd"),
    Notice("boost software license", "bsl"),
    Notice("creative commons attribution noncommercial", "cc-by-nc"),
    Notice("creative commons attribution sharealike", "cc-by-sa"),
    Notice("creative commons attribution license", "cc-by"),
    Notice("all rights reserved", "all-rights-reserved"),
)


#: Windows of a notice whose verdicts are kept while a text is searched: repeated passages are verified once.
WINDOWS_KEPT = 4096


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length, with their offsets."""
    n, k = len(phrase), edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        self.seeds: dict[bytes, list[tuple[int, int]]] = {}
        for i, x in enumerate(notices):
            for offset, piece in pieces(x.phrase, x.edits):
                self.seeds.setdefault(piece.encode(), []).append((i, offset))
        self.fuzzy = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(x.phrase, literal_spaces=True)}){{e<={x.edits}}}(?= )") for x in notices]
        self.digits = [[c for c in x.phrase if c.isdigit()] for x in notices]
        self.exact = [b" " + x.phrase.encode() + b" " for x in notices]

    def normal(self, text: bytes | None) -> bytes:
        """The words with single blanks around each."""
        words = text.translate(ALNUM).split() if text else []
        return b" " + b" ".join(words) + b" " if words else b" "

    def scan(self, norm: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, first byte, end byte, edits) of each verified place; bytes of ``norm``, without the blanks around."""
        spots: dict[int, set[int]] = {}
        for seed, owners in self.seeds.items():
            at = norm.find(seed)
            while at >= 0:
                for i, offset in owners:
                    spots.setdefault(i, set()).add(at - offset)
                at = norm.find(seed, at + 1)
        found = []
        for i, starts in spots.items():
            x, seen, tried = self.notices[i], {}, {}
            slack = 4 * x.edits  # bytes of as many characters
            for start in sorted(starts):
                if start > 0 and norm.startswith(self.exact[i], start - 1):  # nothing in the window is better
                    seen[start, start + len(self.exact[i]) - 2] = 0
                    continue
                lo = norm.find(b" ", max(start - slack - 1, 0), start + slack)  # where a word may begin, with its blank
                if lo < 0:
                    continue
                hi = min(start + len(x.phrase) + 2 * slack + 1, len(norm))
                while hi < len(norm) and norm[hi] & 0xC0 == 0x80:
                    hi += 1  # whole characters
                window = norm[lo:hi]
                if window not in tried:
                    if len(tried) >= WINDOWS_KEPT:
                        tried.clear()
                    tried[window] = self.verified(i, window)
                if tried[window]:
                    a, b, edits = tried[window]
                    seen[lo + a, lo + b] = edits
            found += [(i, *span, edits) for span, edits in seen.items()]
        return sorted(found, key=lambda f: (f[1], f[2], f[0]))

    def verified(self, i: int, window: bytes) -> tuple[int, int, int] | None:
        """First byte, end byte and edits of the best place of a notice in a window; another version is another license."""
        text = window.decode()
        m = self.fuzzy[i].search(text)
        if not m or [c for c in m[0] if c.isdigit()] != self.digits[i]:
            return None
        a = len(text[: m.start()].encode())
        return a, a + len(m[0].encode()), sum(m.fuzzy_counts)

    def places(self, norm: bytes, blanks: np.ndarray, found: list) -> list[tuple[int, int]]:
        """(word, notice) of each place where a base phrase's words stand consecutively: an exact check of what the search located."""
        out = []
        for i in {i for i, *_ in found if self.notices[i].base}:
            starts, at = [], norm.find(self.exact[i])
            while at >= 0:
                starts.append(at)
                at = norm.find(self.exact[i], at + 1)
            out += [(word, i) for word in np.searchsorted(blanks, starts).tolist()]
        return sorted(out)

    def blanks(self, norm: bytes) -> np.ndarray:
        """Places of the blanks: the word after blank k is word k."""
        return np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 0x20)


@functools.cache
def scanner() -> Scanner:
    return Scanner()


def license_notices(docs: DataFrame, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``n_words, n_base, first_word, last_word, base_labels, labels, score, notices``.

    ``notices`` lists every verified place: label, words from and to (exclusive), edits. ``score`` is 1 minus the
    share of edited letters of the best place, 0 without one. Null and empty texts have no words, empty labels,
    null first and last words and score 0. Very long texts and words take time in proportion to them. Map-only;
    repeated rows give equal results.
    """
    out = schema_of(docs, *keep, more="n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, notices array<struct<label:string,first:bigint,end:bigint,edits:int>>")

    def make():
        s = scanner()

        def fn(batch):
            cols: dict[str, list] = {f.name: [] for f in out.fields if f.name not in keep}
            for text in values(batch.column("__text"), binary=True):
                norm = s.normal(text)
                found = s.scan(norm)
                blanks = s.blanks(norm) if found else ()
                base = s.places(norm, blanks, found) if found else []
                spans = np.searchsorted(blanks, [f[1:3] for f in found]).tolist()
                base_labels = {s.notices[i].label for _, i in base}
                labels = base_labels | {s.notices[i].label for i, *_ in found}
                cols["n_words"].append(norm.count(b" ") - 1)
                cols["n_base"].append(len(base))
                cols["first_word"].append(base[0][0] if base else None)
                cols["last_word"].append(base[-1][0] if base else None)
                cols["base_labels"].append(",".join(sorted(base_labels)))
                cols["labels"].append(",".join(sorted(labels)))
                cols["score"].append(max((1 - e / len(s.notices[i].phrase) for i, _, _, e in found), default=0.0))
                cols["notices"].append([{"label": s.notices[i].label, "first": first - 1, "end": end, "edits": e} for (i, _, _, e), (first, end) in zip(found, spans, strict=True)])
            return {k: batch.column(k) for k in keep} | cols

        return fn

    return map_rows(docs.select(*keep, F.col(text_col).cast("string").alias("__text")), make, out)


def op3_fuzzy_notices(docs: DataFrame) -> DataFrame:
    """Digest per document; see ``license_notices``."""
    return license_notices(docs, keep=["doc_id"]).drop("notices")
