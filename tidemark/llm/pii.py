r"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs before digits, digits joined by a dot, a blank, a hyphen
or nothing, URL schemes and identifier cues. A deterministic parser for each kind expands from the anchor to both
sides and validates what it has. Positions are code points, ends exclusive.

Base kinds equal leftmost, non-overlapping matches, of which failing ones are dropped without a retry:
email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, ip ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`` (parts at
most 255), card ``[0-9]([\x20-]?[0-9])+`` (12 to 19 digits that pass Luhn), phone ``\+[0-9][\x20().0-9-]+[0-9]``
(9 to 15 digits). Further kinds: ``iban`` (check digits), ``login`` (scheme://user:password@host), ``secret``
(a cue such as token, then = or :, then at least 16 letters and digits mixed).
"""

from __future__ import annotations

import functools
import re
from hashlib import sha256

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, schema_of, values

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
DIALLED = DIGITS | frozenset(" ().-")
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "login", "secret")
CUES = ("token", "api_key", "apikey", "api-key", "secret", "password", "passwd")


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    keys = {"@": "at", "://": "scheme"} | {f"+{d}": "plus" for d in DIGITS}
    keys |= {a + b: "digits" for a in DIGITS for b in DIGITS} | {f"{a}{s}{b}": "digits" for a in DIGITS for b in DIGITS for s in " -"}
    keys |= {f"{a}.{b}": "dotted" for a in DIGITS for b in DIGITS}
    keys |= {form: "cue" for cue in CUES for form in (cue, cue.upper(), cue.capitalize())}
    keys |= {form: "iban" for form in ("IBAN", "iban", "Iban")}
    for key, what in keys.items():
        found.add_word(key, (what, len(key)))
    found.make_automaton()
    return found


def run_left(text: str, at: int, chars: frozenset, floor: int) -> int:
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def run_right(text: str, at: int, chars: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def email_at(text: str, sign: int, floor: int) -> tuple[int, int] | None:
    start = run_left(text, sign, LOCAL, floor)
    end = run_right(text, sign + 1, LABEL)
    if start == sign or end == sign + 1:
        return None
    last = end
    while last < len(text) and text[last] == "." and (more := run_right(text, last + 1, LABEL)) > last + 1:
        last = more
    return (start, last) if last > end else None


def digit_chain(text: str, at: int, between: str) -> tuple[int, int]:
    """The longest run of digits around ``at``, with at most one character of ``between`` between two digits."""
    start = end = at
    while start > 0 and (text[start - 1] in DIGITS or start > 1 and text[start - 1] in between and text[start - 2] in DIGITS):
        start -= 1
    n = len(text)
    while end < n and (text[end] in DIGITS or text[end] in between and end + 1 < n and text[end + 1] in DIGITS):
        end += 1
    return start, end


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def ips_in(text: str, start: int, end: int) -> list[tuple[int, int]]:
    parts, at, out = text[start:end].split("."), start, []
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        size = sum(map(len, four)) + 3
        # leading zeros away and the length first: a very long run of digits is no number to convert
        bare = [p.lstrip("0") or "0" for p in four]
        if all(len(p) <= 3 and int(p) <= 255 for p in bare):
            out.append((at, at + size))
        at += size + 1
    return out


def phone_at(text: str, plus: int) -> tuple[int, int] | None:
    end = run_right(text, plus + 2, DIALLED)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3 or text[end - 1] not in DIGITS:
        return None
    return (plus, end) if 9 <= sum(c in DIGITS for c in text[plus:end]) <= 15 else None


IBAN = re.compile(r"[ :]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
SECRET = re.compile(r"[A-Za-z_]{0,8}[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_/+.-]{16,})")


def iban_after(text: str, at: int) -> tuple[int, int] | None:
    m = IBAN.match(text, at)
    if not m:
        return None
    plain = m[1].replace(" ", "")
    return m.span(1) if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else None


def secret_after(text: str, at: int) -> tuple[int, int] | None:
    m = SECRET.match(text, at)
    return m.span(1) if m and any(c in DIGITS for c in m[1]) and any(c.isalpha() for c in m[1]) else None


def login_at(text: str, colon: int) -> tuple[int, int] | None:
    """From the scheme's start to the at-sign, exclusive."""
    start = run_left(text, colon, ALNUM, 0)
    end = colon + 3
    while end < len(text) and text[end] not in " \t\r\n/?#@<>\"'":
        end += 1
    return (start, end) if start < colon and end < len(text) and text[end] == "@" and ":" in text[colon + 3 : end] else None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of ``KINDS``; null and empty texts have none."""
    if not text:
        return []
    out, email_end, chain_end, dotted_end = [], 0, 0, 0
    for last, (what, size) in automaton().iter(text):
        at = last - size + 1
        if what == "at":
            if found := email_at(text, at, email_end):
                out.append(("email", *found))
                email_end = found[1]
        elif what == "digits":
            if at >= chain_end:
                start, chain_end = digit_chain(text, at, " -")
                digits = text[start:chain_end].replace(" ", "").replace("-", "") if chain_end - start <= 37 else ""
                if 12 <= len(digits) <= 19 and passes_luhn(digits):
                    out.append(("card", start, chain_end))
        elif what == "dotted":
            if at >= dotted_end:
                start, dotted_end = digit_chain(text, at, ".")
                out += [("ip", *x) for x in ips_in(text, start, dotted_end)]
        elif what == "plus":
            if found := phone_at(text, at):
                out.append(("phone", *found))
        elif what == "scheme":
            if found := login_at(text, at):
                out.append(("login", *found))
        elif found := (iban_after if what == "iban" else secret_after)(text, last + 1):
            out.append((what if what == "iban" else "secret", *found))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(out), key=lambda s: (s[1], order[s[0]], s[2]))


def rendered(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, *, keep: list[str], text_col: str = "text", redact: bool = False) -> DataFrame:
    """The columns ``keep`` with a count for each base kind, ``base_spans``, ``spans`` (kind, start, end) and, with
    ``redact``, ``redacted``: the text with each span replaced by its kind in angle brackets.

    Null and empty texts have no spans (and stay as they are in ``redacted``). Each character is looked at a bounded
    number of times, so very long texts and runs take time in proportion. Map-only; repeated rows give equal results.
    """
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    out = schema_of(docs, *keep, more=", ".join(f"n_{k} bigint" for k in BASE_KINDS) + f", base_spans string, spans {spans}" + ", redacted string" * redact)

    def make():
        def fn(batch):
            cols: dict[str, list] = {f.name: [] for f in out.fields if f.name not in keep}
            for text in values(batch.column("__text")):
                found = find_spans(text)
                base = [s for s in found if s[0] in BASE_KINDS]
                for k in BASE_KINDS:
                    cols[f"n_{k}"].append(sum(s[0] == k for s in base))
                cols["base_spans"].append(rendered(base))
                cols["spans"].append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                if redact:
                    at, parts = 0, []
                    for k, a, b in found:
                        if a >= at:
                            parts += [text[at:a], f"<{k}>"]
                        at = max(at, b)
                    cols["redacted"].append("".join(parts) + text[at:] if text else text)
            return {k: batch.column(k) for k in keep} | cols

        return fn

    return map_rows(docs.select(*keep, F.col(text_col).cast("string").alias("__text")), make, out)


def op7_anchor_expansion(docs: DataFrame) -> DataFrame:
    """Digest per document; see ``personal_data``."""
    found = personal_data(docs, keep=["doc_id"])
    one = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return found.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), F.sha2("base_spans", 256).alias("base_sha256"), F.concat_ws(",", one).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return sha256(rendered(spans).encode()).hexdigest()
