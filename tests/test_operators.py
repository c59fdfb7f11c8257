"""Operators against naive models and the cases they must get right."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import timecode as tc
from tidemark.operators import boundaries, camera, clips, corrections, cuts, evaluate, frames, publish, turns as tn, web, words as wd
from tidemark.sources import files, logs

WORDS = "rec_id bigint, idx int, text string, start double, end double"
TURNS = "rec_id bigint, idx int, start double, end double, speaker string"


def one(spark, expr, **cols):
    """The value of a column expression over one row."""
    ddl = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items()) or "x int"
    return spark.createDataFrame([tuple(cols.values()) or (1,)], ddl).select(expr.alias("v")).first().v


def each(spark, values, ddl, fn):
    return [r.v for r in spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {ddl}").orderBy("i").select(fn.alias("v")).collect()]


def random_words(rng, n, rec=1):
    t, out = 0, []
    for i in range(n):
        text = rng.choice(["a", "so", "word", "longer", "sentence", "extraordinary", "—", "and"]) + rng.choice(["", "", "", ".", "?", ","])
        d = rng.choice([80, 200, 400, 900])
        out.append((rec, i, text, t / 1000, (t + d) / 1000))
        t += d + rng.choice([0, 20, 100, 450, 600, 700, 1600, 2600])
    return out


def closes(text):
    return text.endswith((".", "?", "!"))


# --- times


def test_clock_texts(spark):
    texts = ["45", "2:03", "75:00", "1:02:03.5", " 0:05 ", "99", "1:60", "1:60:00", "x", "", "1:2:3:4", "12:", None]
    assert each(spark, texts, "t string", tc.parse_clock(F.col("t"))) == [45.0, 123.0, 4500.0, 3723.5, 5.0, 99.0, None, None, None, None, None, None, None]


def test_stamps(spark):
    s = [0.0, 59.5, 3723.456, -1.0, 2.5]
    assert each(spark, s, "s double", tc.clock(F.col("s"))) == ["0:00", "1:00", "1:02:03", "0:00", "0:03"]
    assert each(spark, s, "s double", tc.precise(F.col("s"))) == ["0:00:00.00", "0:00:59.50", "1:02:03.46", "0:00:00.00", "0:00:02.50"]
    assert each(spark, s, "s double", tc.srt_stamp(F.col("s"))) == ["00:00:00,000", "00:00:59,500", "01:02:03,456", "00:00:00,000", "00:00:02,500"]
    assert one(spark, tc.argument(F.col("s")), s=1481.25) == "1481.250"
    assert one(spark, tc.span_text(F.col("a"), F.col("b")), a=5.0, b=65.0) == "0:05–1:05"
    assert [one(spark, tc.override(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("", ""), ("1:00", "2:00"), ("1:00", ""), ("2:00", "1:00"), ("x", "1:00"))] == [None, None, "start and end must be given together", "the end must be after the start", "not a time"]


# --- words


def test_assembled_words(spark):
    tokens = [(1, 0, 0, "[_BEG_]", -1, 0), (1, 0, 1, " Hel", 100, 990), (1, 0, 2, "lo", -1, 1000), (1, 0, 3, ",", -1, 1100), (1, 0, 4, " —", 150, 0), (1, 0, 5, " world.", -1, 5000), (1, 1, 0, "Next", 620, 0), (1, 1, 1, "  ", 630, 0)]
    out = wd.assemble(spark.createDataFrame(tokens, "rec_id bigint, seg int, pos int, text string, t_dtw int, offset_ms int")).orderBy("idx").collect()
    assert [(r.text, r.start, round(r.end, 3)) for r in out] == [("Hello,", 1.0, 1.47), ("world.", 5.0, 5.47), ("Next", 6.2, 6.54)]


def find_naive(words, phrase, near, window):
    norm = lambda s: "".join(c for c in s.lower() if c.isalpha() or c.isdecimal())
    target, best = norm(phrase), None
    if not target:
        return None
    for i, w in enumerate(words):
        text = ""
        for j in range(i, len(words)):
            text += norm(words[j][2])
            if not target.startswith(text):
                break
            if text == target:
                off = abs(w[3] - near)
                if off <= window and (best is None or off < best[0]):
                    best = (off, i, j)
                break
    return best and best[1:]


def test_find_equals_naive(spark):
    rng = random.Random(1)
    words, phrases, want = [], [], {}
    for rec in range(40):
        ws = random_words(rng, 30, rec)
        words += ws
        for k in range(4):
            i = rng.randrange(28)
            p = " ".join(w[2] for w in ws[i : i + rng.randint(1, 3)]).upper() if k else "never said"
            near, window = rng.uniform(0, 20), rng.choice([2.0, 30.0])
            phrases.append((rec, k, p, near, window))
            want[rec, k] = find_naive(ws, p, near, window)
    found = wd.find(spark.createDataFrame(words, WORDS), spark.createDataFrame(phrases, "rec_id bigint, phrase_id int, phrase string, near double, window double"))
    assert {(r.rec_id, r.phrase_id): (r.first, r.last) for r in found.collect()} == {k: v for k, v in want.items() if v}


def cues_naive(words, lim):
    out, cur, chars = [], [], 0
    for i, w in enumerate(words):
        if cur and (chars + 1 + len(w[2]) > lim.chars or lim.words and len(cur) >= lim.words or w[4] - cur[0][3] > lim.seconds or w[3] - words[i - 1][4] >= lim.pause):
            out.append(cur)
            cur, chars = [], 0
        chars += len(w[2]) + bool(cur)
        cur.append(w)
        if closes(w[2]):
            out.append(cur)
            cur, chars = [], 0
    return out + [cur] * bool(cur)


@pytest.mark.parametrize("limits", [wd.CAPTIONS, wd.CLIP_CAPTIONS])
def test_cues_equal_naive(spark, limits):
    rng = random.Random(2)
    recs = {r: random_words(rng, rng.randint(1, 80), r) for r in range(30)}
    found = wd.cues(spark.createDataFrame([w for ws in recs.values() for w in ws], WORDS), limits).orderBy("rec_id", "cue").collect()
    want = []
    for r, ws in recs.items():
        cs = cues_naive(ws, limits)
        for k, c in enumerate(cs):
            end = min(c[-1][4], cs[k + 1][0][3]) if k + 1 < len(cs) else c[-1][4]
            want.append((r, k, c[0][1], c[-1][1], c[0][3], end, " ".join(w[2] for w in c)))
    assert [tuple(x) for x in found] == want


def test_captions_text(spark):
    words = [(1, 0, "Hi", 1.0, 1.2), (1, 1, "{there}.", 1.3, 1.8), (1, 2, "Bye", 2.6, 3.0)]
    w = spark.createDataFrame(words, WORDS)
    c = wd.cues(w)
    assert [r.block for r in wd.srt_lines(c, F.lit(1.0)).orderBy("cue").collect()] == ["1\n00:00:00,000 --> 00:00:00,800\nHi {there}.\n\n", "2\n00:00:01,600 --> 00:00:02,000\nBye\n\n"]
    assert wd.caption_highlights(w, c, F.lit(0.0)).orderBy("idx").first().line == "Dialogue: 0,0:00:01.00,0:00:01.30,Caption,,0,0,0,,{\\c&H00D7FF&}HI{\\c&HFFFFFF&} (THERE)."


def lines_naive(words, known, unclear):
    out, line, label = [], [], ""

    def flush():
        nonlocal line, label
        if line:
            out.append((line[0][1], line[-1][1], label or unclear))
        line, label = [], ""

    for i, w in enumerate(words):
        who = known[i] or ""
        if not who and (i == 0 or closes(words[i - 1][2])):
            for j in range(i + 1, len(words)):
                if words[j][3] - w[3] >= 5 or who:
                    break
                who = known[j] or ""
        if line and (w[3] - words[i - 1][4] > 1.5 or who and label and who != label):
            flush()
        label = label or who
        line.append(w)
        if len(line) >= 30 or len(line) >= 8 and closes(w[2]):
            flush()
    flush()
    return out


def test_lines_equal_naive(spark):
    rng = random.Random(3)
    rows, want = [], []
    for r in range(40):
        ws = random_words(rng, rng.randint(1, 90), r)
        who, known = "A", []
        for _ in ws:
            who = rng.choice(["A", "B", None]) if rng.random() < 0.15 else who
            known.append(who)
        rows += [(*w, k) for w, k in zip(ws, known, strict=True)]
        want += [(r, *x) for x in lines_naive(ws, known, "(unclear)")]
    found = wd.lines(spark.createDataFrame(rows, WORDS + ", known string")).orderBy("rec_id", "first").collect()
    assert [(x.rec_id, x["first"], x["last"], x.label) for x in found] == want


def test_paragraphs_equal_naive(spark):
    rng = random.Random(4)
    rows, want = [], []
    for r in range(12):
        ws = [(r, i, w[2], w[3], w[4]) for i, w in enumerate(random_words(rng, 400, r))]
        if r % 2:  # without pauses
            ws = [(r, i, w[2], i * 0.3, i * 0.3 + 0.2) for i, w in enumerate(ws)]
        rows += ws
        start = 0
        for i, w in enumerate(ws):
            last = i == len(ws) - 1
            if last or ws[i + 1][3] - w[4] > 2.5 or i - start >= 120 and closes(w[2]):
                want.append((r, start, i))
                start = i + 1
    found = wd.paragraphs(spark.createDataFrame(rows, WORDS)).orderBy("rec_id", "first").collect()
    assert [(x.rec_id, x["first"], x["last"]) for x in found] == want


def test_repeats(spark):
    def at(texts, rec):
        return [(rec, i, t, i * 0.5, i * 0.5 + 0.4) for i, t in enumerate(" ".join(texts).split())]

    loop = ["And we go on."] * 4
    w = at(["One two."] + loop + ["The end of it"], 1) + at(["Yes."] * 6, 2) + at(["No more now."] * 3, 3) + at(["Well."] + ["we say it again."] * 2, 4)
    found = wd.repeats(spark.createDataFrame(w, WORDS)).collect()
    assert [(r.rec_id, r.start, r.end) for r in found] == [(1, 1.0, 8.9)]


def test_chunks(spark):
    r = spark.createDataFrame([(1, 0, 0.1, 4.0), (1, 1, 8.0, 9.0), (1, 2, 14.0, 15.0)], "rec_id bigint, idx int, start double, end double")
    c = wd.chunks(r).orderBy("start")
    assert [(x.start, round(x.end, 3)) for x in c.collect()] == [(0.0, 9.3), (13.7, 15.3)]
    w = spark.createDataFrame([(1, 0, 0, "a", 1.0, 1.2), (1, 0, 1, "b", 9.2, 9.6), (1, 0, 2, "late", 9.4, 9.9)], "rec_id bigint, chunk bigint, idx int, text string, start double, end double")
    assert [(x.text, x.start, x.end) for x in wd.from_chunks(w, c).orderBy("idx").collect()] == [("a", 1.0, 1.2), ("b", 9.2, pytest.approx(9.3))]


def test_presets(spark):
    names = ["m/ggml-large-v3-turbo-q5.bin", "ggml-large-v3.bin", "ggml-medium.en.bin", "ggml-base.bin"]
    assert each(spark, names, "m string", wd.alignment_preset(F.col("m"))) == ["large.v3.turbo", "large.v3", "medium.en", None]


# --- turns


def random_turns(rng, rec, n):
    t, out = 0, []
    for i in range(n):
        t += rng.choice([0, 100, 1400, 1500, 3000, 61000])
        d = rng.choice([300, 1900, 2000, 5000])
        out.append((rec, i, t / 1000, (t + d) / 1000, rng.choice("AB")))
        t += rng.choice([d, d, d // 2])
    return sorted(out, key=lambda x: (x[2], x[3], x[4]))


def clean_naive(turns):
    out = []
    for t in turns:
        if out and out[-1][2] == t[4] and t[2] - out[-1][1] < 1.5:
            out[-1][1] = max(out[-1][1], t[3])
        else:
            out.append([t[2], t[3], t[4]])
    return [tuple(x) for x in out if x[1] - x[0] >= 2.0]


def speaking_naive(turns, t):
    for x in turns:
        if x[2] <= t < x[3]:
            return x[4]
    before = [x for x in turns if x[2] <= t]
    after = [x for x in turns if x[2] > t]
    if before and after and before[-1][4] == after[0][4] and after[0][2] - before[-1][3] <= 60:
        return before[-1][4]
    return None


def test_turns_equal_naive(spark):
    rng = random.Random(5)
    recs = {r: [(r, i, *t[2:]) for i, t in enumerate(random_turns(rng, r, rng.randint(1, 25)))] for r in range(40)}
    df = spark.createDataFrame([t for ts in recs.values() for t in ts], TURNS)
    found = tn.clean(df).orderBy("rec_id", "idx").collect()
    assert [(x.rec_id, x.start, x.end, x.speaker) for x in found] == [(r, *t) for r, ts in recs.items() for t in clean_naive(ts)]
    points = [(r, k, rng.randrange(0, 200000) / 1000) for r in recs for k in range(20)]
    got = tn.speaking(spark.createDataFrame(points, "rec_id bigint, point_id int, t double"), df).collect()
    assert {(x.rec_id, x.point_id): x.speaker for x in got} == {(r, k): speaking_naive(recs[r], t) for r, k, t in points}


def test_speaker_names(spark):
    t = spark.createDataFrame([(1, 0, 0.0, 5.0, "b"), (1, 1, 5.0, 20.0, "a"), (1, 2, 20.0, 25.0, "c"), (2, 0, 0.0, 1.0, "x")], TURNS)
    spans = spark.createDataFrame([(1, 4.0, 24.0), (2, 5.0, 6.0)], "rec_id bigint, span_start double, span_end double")
    main = tn.main_speaker(t, spans)
    assert [tuple(x) for x in main.collect()] == [(1, "a")]
    names = {(x.rec_id, x.speaker): x.name for x in tn.names_with_main(t, main).collect()}
    assert names == {(1, "a"): "Preacher", (1, "b"): "Speaker 2", (1, "c"): "Speaker 3", (2, "x"): "Speaker 1"}
    assert {(x.rec_id, x.speaker): x.name for x in tn.neutral_names(t).collect()} == {(1, "a"): "Speaker 1", (1, "b"): "Speaker 2", (1, "c"): "Speaker 3", (2, "x"): "Speaker 1"}
    assert [(x.rec_id, x.speaker) for x in tn.others(t, spans, main).orderBy("idx").collect()] == [(1, "b"), (1, "c")]


# --- cuts


def cut_naive(words, first, last, pauses):
    t0, t1 = words[first][3], words[last][4]
    floor = min(max([t0 - 0.75] + [words[first - 1][4] + 0.05] * (first > 0)), t0)
    ceiling = max(min([t1 + 0.75] + [w[3] - 0.05 for w in words[last + 1 : last + 2]]), t1)

    def heard(lo, hi):
        cut = [(max(a, lo), min(b, hi)) for a, b in pauses if a < hi and b > lo]
        return [(a, b) for a, b in cut if round(b - a, 6) >= 0.2]

    before, after = heard(floor, t0), heard(t1, ceiling)
    a = max(floor, t0 - 0.3)
    if before:
        p = min(before, key=lambda p: (abs(p[1] - t0), p[0]))
        a = max(floor, p[0], min(t0, p[1]) - 0.3)
    b = min(ceiling, t1 + 0.5)
    if after:
        p = min(after, key=lambda p: (abs(p[0] - t1), p[0]))
        s = max(t1, p[0])
        b = min(ceiling, s + min(0.5, (p[1] - s) / 2))
    return a, b, bool(before and after)


def test_cuts_equal_naive(spark):
    rng = random.Random(6)
    words, ranges, pauses, want = [], [], [], {}
    for r in range(30):
        ws = random_words(rng, 20, r)
        words += ws
        ps = sorted((rng.uniform(0, ws[-1][4]), 0) for _ in range(15))
        ps = [(a, a + rng.choice([0.1, 0.3, 0.8])) for a, _ in ps]
        pauses += [(r, a, b) for a, b in ps]
        for k in range(3):
            i = rng.randrange(20)
            j = rng.randrange(i, 20)
            ranges.append((r, k, i, j))
            want[r, k] = cut_naive(ws, i, j, ps)
    got = cuts.cut_words(spark.createDataFrame(words, WORDS), spark.createDataFrame(ranges, "rec_id bigint, cut_id int, first int, last int"), spark.createDataFrame(pauses, "rec_id bigint, start double, end double")).collect()
    assert len(got) == len(want)
    for x in got:
        a, b, found = want[x.rec_id, x.cut_id]
        assert (x.start, x.end, x.found) == (pytest.approx(a), pytest.approx(b), found)


# --- boundaries


def test_verified_names(spark):
    words = [(1, i, t, i * 0.5, i * 0.5 + 0.3) for i, t in enumerate("I am Odo and this is Jane Doe speaking".split())]
    w = spark.createDataFrame(words, WORDS)
    names = ["Pastor Odo", "Odo Vanterpool", "Dr. Jane Doe", "Jane Roe", "Pastor", "pastor odo vanterpool"]
    for name, want in zip(names, ["Pastor Odo Vanterpool", "Pastor Odo Vanterpool", "Dr. Jane Doe", None, None, "Pastor Odo Vanterpool"], strict=True):
        named = spark.createDataFrame([(1, name, 2.0, 10.0)], "rec_id bigint, name string, middle double, seconds double")
        listed = spark.createDataFrame([(1, 0, "Pastor Odo Vanterpool")], "rec_id bigint, pos int, person string")
        assert boundaries.verified_names(w, named, listed).first().verified == want, name


def test_detected(spark):
    words = [(1, i, f"w{i}" + ("." if i % 9 == 8 else ""), i * 4.0, i * 4.0 + 2.0) for i in range(400)] + [(2, 0, "only", 0.0, 1.0)]
    w = spark.createDataFrame(words, WORDS)
    t = spark.createDataFrame([(1, 0, 0.0, 300.0, "A"), (1, 1, 300.0, 340.0, "B"), (1, 2, 340.0, 1600.0, "A")], TURNS)
    replies = spark.createDataFrame([(1, "w10 w11", "0:40", "w349 w350.", "23:16", "high", []), (2, "never", "0:00", "only", "0:00", "low", ["odd"])], "rec_id bigint, start_quote string, start_time string, end_quote string, end_time string, confidence string, notes array<string>")
    out = {r.rec_id: r for r in boundaries.detected(w, t, cuts.pauses_between(w), replies).collect()}
    assert out[1].error is None and 39 < out[1].start < 40 and 1402 < out[1].end < 1403
    assert out[1].flags == ["Long turns of others inside: 5:00–5:40."]
    assert out[2].error == "not in the transcript: never" and out[2].flags == ["odd", "Stated confidence: low."]


# --- corrections


def test_allowed_corrections(spark):
    terms = ["Hearts of Grace", "Odo Vanterpool", "Eben", "Pastor Jim"]
    cases = [
        ("parts of grace", "Hearts of Grace", True),
        ("odo vanderpol said", "Odo Vanterpool said", True),
        ("Ebon", "Eben", True),
        ("matthew twenty four fourteen", "Matthew 24:14", True),
        ("first peter two four to ten", "1 Peter 2:4-10", True),
        ("song of solomon two", "Song of Solomon 2", True),
        ("the pastor jym,", "the Pastor Jim,", True),
        ("Eben", "Eben", False),
        ("word", " ", False),
        ("party", "Eben", False),
        ("matthew twenty four", "Matthew 24:14", False),
        ("mark seven", "Matthew 7", False),
        ("hezekiah three", "Hezekiah 3", False),
        ("odo vanderpol said", "Odo Vanterpool shouted", False),
        ("a house", "a home", False),
        ("john three sixteen", "1 John 3:16", False),
    ]
    got = each(spark, [(f, r) for f, r, _ in cases], "f string, r string", corrections.refusal(F.col("f"), F.col("r"), terms))
    assert [(c[0], c[1], g is None) for c, g in zip(cases, got, strict=True)] == cases
    assert got[8] == "it changes nothing" and got[12] == "no book has the name Hezekiah" and got[10] == "14 was never said"


def test_spoken_numbers(spark):
    texts = ["twenty four", "first and Twenty, 7", "seventy five hundred", "forty ten", "twenty twenty one", "none"]
    assert [sorted(x) for x in each(spark, texts, "t string", tx.spoken_numbers(F.col("t")))] == [[24], [1, 7, 20], [75], [10, 40], [20, 21], []]


def test_applied_corrections(spark):
    words = [(1, i, t, float(i), i + 0.8) for i, t in enumerate("We read parts of grace. And parts of grace again".split())]
    c = [(1, 0, "parts of grace", "Hearts of Grace", "0:02"), (1, 1, "of grace.", "Eben Grace", "0:03"), (1, 2, "parts of grace", "Hearts of Grace", "soon"), (1, 3, "not here", "Hearts of Grace x", "0:01"), (1, 4, "parts of grace", "Hearts of Grace", "0:06")]
    w = spark.createDataFrame(words, WORDS)
    df = spark.createDataFrame(c, "rec_id bigint, pos int, find string, replace string, time string")
    out = corrections.outcomes(w, df, ["Hearts of Grace", "Eben Grace"])
    got = {r.pos: (r.applied, r.skipped) for r in out.collect()}
    assert got[0] == (True, "") and got[4] == (True, "") and got[2] == (False, "no time: soon")
    assert not got[1][0] and not got[3][0]
    text = corrections.applied(w, out).orderBy("idx").collect()
    assert [r.text for r in text] == "We read Hearts of Grace. And Hearts of Grace again".split()
    assert [r.idx for r in text] == list(range(10)) and (text[2].start, text[4].end) == (2.0, 4.8)
    assert math.isclose(text[3].start - text[2].start, 2.8 * 6 / 14)


# --- clips, frames, camera


def test_chosen_clips(spark):
    c = [(1, 1, "It's A", 0.0, 50.0), (1, 2, "B", 40.0, 90.0), (1, 3, "C", 100.0, 140.0), (1, 4, "D", 200.0, 240.0), (1, 5, "E", 300.0, 340.0), (1, 6, "F", 400.0, 440.0)]
    r = [(1, 0, 2, "keep", "good", 15), (1, 1, 1, "keep", "fine", 8), (1, 2, 3, "reject", "dull", 9), (1, 3, 4, "keep", "meh", 3), (1, 4, 2, "reject", "again", 1), (1, 5, 9, "keep", "?", 9), (1, 6, 6, "keep", "ok", 8)]
    out = clips.chosen(spark.createDataFrame(c, "rec_id bigint, number int, title string, start double, end double"), spark.createDataFrame(r, "rec_id bigint, pos int, number int, verdict string, reason string, score int"), 2, 5)
    got = {x.number: (x.verdict, x.clip_id) for x in out.collect()}
    assert got == {1: ("shares time with a better one", None), 2: ("chosen", "01-b"), 3: ("turned down: dull", None), 4: ("too weak, 3 of 10: meh", None), 5: ("no review", None), 6: ("chosen", "02-f")}


def test_slugs(spark):
    texts = ["Don’t Judge: the Splinter & the Beam!", "  --x--  ", "word " * 12, "abcdefghij" * 5, "", "ñandú"]
    assert each(spark, texts, "t string", tx.slug(F.col("t"), 40)) == ["dont-judge-the-splinter-the-beam", "x", "word-word-word-word-word-word-word-word", "abcdefghij" * 4, "", "and"]


def test_chosen_frames(spark):
    box = lambda h: {"x": 0.4, "y": 0.1, "w": 0.1, "h": h}
    face = lambda q, h=0.2: {"box": box(h), "quality": q}
    rows = [(1, 0.0, [face(0.9), face(0.95, 0.01)], []), (1, 30.0, [face(0.95)], []), (1, 70.0, [face(0.99)], [box(0.5)]), (1, 200.0, [face(0.5)], None), (1, 300.0, [], [])]
    b = "struct<x:double,y:double,w:double,h:double>"
    df = spark.createDataFrame(rows, f"rec_id bigint, t double, faces array<struct<box:{b},quality:double>>, text array<{b}>")
    got = [(x.place, x.t, round(x.score, 3)) for x in frames.choose(df, 3).orderBy("place").collect()]
    assert got == [(0, 30.0, 0.95), (1, 200.0, 0.5)]  # the others are too near or have no usable face
    crop = one(spark, frames.frame_crop(F.struct(F.lit(0.5).alias("x"), F.lit(0.2).alias("y"), F.lit(0.1).alias("w"), F.lit(0.15).alias("h")), F.lit(1920.0), F.lit(1080.0)))
    assert (crop.w % 32, crop.h * 16 // 9, crop.x % 2, crop.y % 2) == (0, crop.w, 0, 0) and crop.x + crop.w <= 1920


def track(fn, n=300):
    return [(1, i / 10, [] if i % 11 == 10 else [fn(i)]) for i in range(n)]


def path_of(spark, rows, seconds=30, **options):
    df = spark.createDataFrame(rows, "rec_id bigint, t double, xs array<double>")
    c = spark.createDataFrame([(1, 0.0, seconds * 30)], "rec_id bigint, clip_start double, frames int")
    return [r.left for r in camera.path(df, c, camera.Camera(1280.0, 576.0, **options)).orderBy("frame").collect()]


def test_camera(spark):
    steady = path_of(spark, track(lambda i: 0.5 + 0.006 * (-1) ** (i // 7)))
    assert len(steady) == 900 and max(steady) - min(steady) < 3 and abs(steady[450] - (640 - 288)) < 6
    walk = path_of(spark, track(lambda i: 0.3 + 0.4 * i / 300))
    assert all(b >= a - 0.01 for a, b in zip(walk, walk[1:], strict=False)) and walk[-1] - walk[0] > 300
    assert max(path_of(spark, track(lambda i: 1.0))) == 1280 - 576
    assert path_of(spark, [(1, i / 10, [0.5] if i % 2 else []) for i in range(100)]) == []
    two = spark.createDataFrame([(1, 0.0, [0.2, 0.8]), (1, 0.1, [0.75, 0.3]), (1, 0.2, [0.7])], "rec_id bigint, t double, xs array<double>")
    assert [r.x for r in camera.anchored(two).orderBy("t").collect()] == [0.8, 0.75, 0.7]
    lines = camera.crop_commands(spark.createDataFrame([(1, 0, 1.2), (1, 1, 1.4), (1, 2, 1.6)], "rec_id bigint, frame bigint, left double"))
    assert [r.line for r in lines.orderBy("frame").collect()] == ["0.0000 crop@cam x 1;\n", "0.0667 crop@cam x 2;\n"]


# --- publishing


def test_chapters(spark):
    rows = [(1, 0, 500.0, "Late"), (1, 1, 5.0, "Start"), (1, 2, 12.0, "Close"), (1, 3, 15.0, "Next"), (1, 4, 595.0, "End")]
    out = publish.valid_chapters(spark.createDataFrame(rows, "rec_id bigint, pos int, at double, title string"), spark.createDataFrame([(1, 600.0)], "rec_id bigint, duration double"))
    got = {x.title: (x.place, x.at, x.dropped) for x in out.collect()}
    assert got == {"Start": (0, 0.0, None), "Close": (None, 12.0, "under 10 s after the one before"), "Next": (1, 15.0, None), "Late": (2, 500.0, None), "End": (None, 595.0, "in the last 10 s")}


def test_tags(spark):
    assert one(spark, publish.valid_tags(F.col("t")), t=["#Grace", " grace ", "<b>", "", "Hope"]) == ["Grace", "b", "Hope"]
    many = [f"tag number {i:03d}" for i in range(60)]
    kept = one(spark, publish.valid_tags(F.col("t")), t=many)
    assert kept == many[: len(kept)] and len(",".join(kept)) <= 500 < len(",".join(many[: len(kept) + 1]))
    assert one(spark, publish.valid_hashtags(F.col("t")), t=["#Good News!", "good news", "a-b", "é", "z"]) == ["#GoodNews", "#ab", "#é"]


def trimmed_by_steps(text, limit):
    """The rule on bytes, a step at a time."""
    b = text.encode()
    while len(b) > limit:
        at = b[:limit].rstrip(b"\n").rfind(b"\n\n")
        if at <= 0:
            return b[:limit].decode("utf-8", "ignore")
        b = b[:at] + b"\n"
    return b.decode()


def test_texts(spark):
    assert one(spark, tx.limit_chars(F.col("t"), 20), t="One two. Three four. Five six.") == "One two. Three four."
    assert one(spark, tx.limit_chars(F.col("t"), 12), t="One two three four") == "One two…"
    assert one(spark, tx.limit_chars(F.col("t"), 4), t="Onetwothree") == "Onet…"
    assert one(spark, publish.trimmed_to(F.col("t"), 12), t="First.\n\nSecond.\n\nThird.") == "First.\n"
    assert one(spark, publish.trimmed_to(F.col("t"), 3), t="Fért") == "Fé"
    for text, limit, want in (("A\n\nBBB\n\nCC", 7, "A\n"), ("A\n\nBBB\n\nCC", 8, "A\n"), ("A\n\nBBB\n\nCC", 9, "A\n\nBBB\n"), ("A\n\nBBB\n\nCC", 10, "A\n\nBBB\n\nCC"), ("A\n\nBBB\n\nCCC", 10, "A\n\nBBB\n"), ("\n\nAAAA", 4, "\n\nAA"), ("A\n\n\nBB", 5, "A\n\n"), ("é" * 9, 5, "éé")):
        assert trimmed_by_steps(text, limit) == one(spark, publish.trimmed_to(F.col("t"), limit), t=text) == want, (text, limit)
    assert one(spark, tx.folder_name(F.col("d"), F.col("t"), F.col("p")), d="2024-01-07", t="A/B: C | D", p="Luke 1:2") == "2024-01-07 · A-B - C (Luke 1.2)"
    assert one(spark, tx.caption_argument(F.col("t")), t="@5%") == "\\@5%%"
    assert one(spark, publish.loudness_text(F.lit(-14.04), F.lit(-1.5), F.lit(6.0))) == "-14.0 LUFS · peak -1.5 dBTP · range 6.0 LU"
    assert one(spark, publish.first_gain(F.lit(-14.0), F.lit(-20.0), F.lit(-1.5))).asDict() == {"gain": 6.0, "ceiling": -2.0}
    step = F.struct(F.lit(6.0).alias("gain"), F.lit(-2.0).alias("ceiling"))
    go = lambda loud, peak, attempt: one(spark, publish.next_gain(F.lit(-14.0), F.lit(-1.5), step, F.lit(loud), F.lit(peak), F.lit(attempt))).asDict()
    assert go(-16.0, -1.0, 1) == {"done": False, "failed": False, "gain": 8.0, "ceiling": -2.7}
    assert go(-14.4, -1.5, 3) == {"done": True, "failed": False, "gain": 6.4, "ceiling": -2.0}
    assert go(-13.0, -1.6, 3) == {"done": False, "failed": True, "gain": 5.0, "ceiling": -2.0}
    chain = one(spark, publish.master_filter(step, 48000, F.lit(60.0), 0.15, 0.3))
    assert chain == publish.SHAPING + ",volume=6.00dB,aresample=192000,alimiter=limit=0.7943:attack=5:release=60:level=false,aresample=48000,afade=t=in:d=0.15,afade=t=out:st=59.700:d=0.30"
    text = one(spark, publish.assembled(F.lit("Body"), F.array(F.lit("A 1"), F.lit("B 2")), F.array(F.struct(F.lit(0.0).alias("at"), F.lit("Go").alias("title"))), F.array(F.lit("#x")), F.lit("N"), F.lit(""), F.lit("w.org")))
    assert text == "Body\n\nScripture: A 1 · B 2\n\nChapters\n0:00 Go\n\nN\nw.org\n\n#x\n"


# --- pages and logs


def test_pages(spark):
    page = '<title> T </title><meta name="description" content="About us."><meta property="og:description" content="About us."><script>no</script><p>One</p><p>One</p><p>Two  <b>three</b></p><div><a href="/about">Our story</a><a href="mailto:x@y.z">m</a><a href="https://other.org/about">o</a><a href="/doc.pdf">about</a><a href="/about#team">team</a><a href="/misc">misc</a><a href="contact.html?x=1">Contact</a>'
    p = web.parsed(spark.createDataFrame([(1, "https://www.site.org/", page), (2, None, None)], "page_id bigint, url string, html string"))
    row = p.where("page_id = 1").select("title", web.tidy(F.col("raw")).alias("text")).first()
    assert row.title == "T" and row.text.split("\n")[:3] == ["About us.", "One", "Two three"]
    links = p.where("page_id = 1").select(F.lit(1).alias("site"), F.col("url").alias("home"), F.posexplode("links").alias("pos", "l")).select("site", "home", "pos", "l.url", "l.text")
    assert [r.url for r in web.picked(links).orderBy("place").collect()] == ["https://www.site.org/about", "https://www.site.org/contact.html"]
    assert each(spark, ["site.org", "http://a.b/c", "https://www.X.org", "https://", ""], "s string", web.homepage(F.col("s"))) == ["https://site.org/", "http://a.b/c", "https://www.X.org/", None, None]
    assert one(spark, web.domain(F.col("u")), u="https://www.X.org/a") == "x.org"
    assert one(spark, web.clean_details(F.col("t")), t=["a \x07 b", "A b", "", "c"]) == ["a b", "c"]


def test_logs(spark):
    lines = ["Started", "0.50 -- 2.50 speaker_01", "3 -- 3 speaker_00", "x -- 4 speaker_00", "4.0 -- 9.0 speaker_00", "1 -- 2 nobody"]
    t = logs.diarization_turns(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "rec_id bigint, line_no int, value string"))
    assert [tuple(r) for r in t.orderBy("idx").collect()] == [(1, 0, 0.5, 2.5, "speaker_01"), (1, 1, 4.0, 9.0, "speaker_00")]
    log = "silence_end: 1\nsilence_start: -0.02\nsilence_end: 0.5 | silence_duration: 0.52\nsilence_start: 3.25\n"
    s = logs.silences(spark.createDataFrame([(1, log, 10.0, 15.0)], "rec_id bigint, log string, offset double, end double"))
    assert [(r.start, r.end) for r in s.orderBy("idx").collect()] == [(10.0, 10.5), (13.25, 15.0)]
    report = 'x {"a":1} { "input_i" : "%s", "input_tp" : "-1.5", "input_lra" : "6" }'
    assert one(spark, logs.loudness(F.col("t")), t=report % "-14.2").integrated == -14.2
    assert one(spark, logs.loudness(F.col("t")), t=report % "-inf").error and one(spark, logs.loudness(F.col("t")), t="nothing").error
    assert each(spark, ["30000/1001", "25", "0/0", "x"], "t string", logs.rate(F.col("t"))) == [30000 / 1001, 25.0, 0.0, 0.0]
    probe = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":1280,"height":720,"avg_frame_rate":"0/0","r_frame_rate":"30/1"}],"format":{"duration":"12.5"}}'
    got = one(spark, logs.probe(F.col("t")), t=probe)
    assert (got.duration, got.width, got.fps, got.error) == (12.5, 1280, 30.0, None) and one(spark, logs.probe(F.col("t")), t="{}").error


def test_sinks(spark, tmp_path):
    c = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.5).alias("end"), F.lit("a=b;#\\").alias("title")))
    assert one(spark, files.chapter_metadata(c)) == ";FFMETADATA1\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=1500\ntitle=a\\=b\\;\\#\\\\\n"
    text = one(spark, files.settings_text(F.lit('A "B"'), F.lit("b.org"), F.lit(""), F.array(F.lit("X")), F.array().cast("array<string>")))
    assert text.startswith('[talk]\nname = "A \\"B\\""\n') and "location = \"\" # TODO" in text
    s = files.settings('[talk]\nname = "N"\n[clips]\ncount = 2')
    assert s.talk.name == "N" and s.clips.count == 2 and s.clips.min_score == 6 and s.problems() == []
    with pytest.raises(ValueError, match="talk.nam"):
        files.settings('[talk]\nnam = "N"')
    assert len(files.settings("[clips]\ncount = -1\nmin_score = 11").problems()) == 3
    every = files.settings('[talk]\nends = "later"\n[asking]\neffort = "some"\n[audio]\ntrue_peak = 0.0\n[clips]\nmin_seconds = 9.0\nmax_seconds = 9.0\nsmoothing_seconds = 0.0\nsteadiness = 0.2\nfont_family = "A, B"\nfont_file = "/no:where/f.ttf"')
    assert len(every.problems()) == 10
    (tmp_path / "l.toml").write_text('[[service]]\nrecording = "r"\nstart = "1:00"\nend = "2:00"\n')
    labels = files.eval_labels(spark, f"{tmp_path}/l.toml").select(F.lit(1).alias("rec_id"), tc.parse_clock(F.col("start")).alias("start"), tc.parse_clock(F.col("end")).alias("end"))
    spans = spark.createDataFrame([(1, 63.5, 119.0), (2, 1.0, 2.0)], "rec_id bigint, start double, end double")
    got = evaluate.summary(evaluate.errors(spans, labels)).first()
    assert (got.n, got.start_mae, got.end_mae) == (1, 3.5, 1.0)
    (tmp_path / "a.json").write_text('{"rec_id": 1, "transcription": [{"text": " a", "tokens": [{"text": " a", "t_dtw": 5, "offsets": {"from": 1, "to": 2}}]}]}')
    tokens = files.asr_tokens(files.read_json(spark, f"{tmp_path}/a.json", f"rec_id bigint, {files.ASR}"))
    assert tuple(tokens.first()) == (1, 0, 0, " a", 5, 1)


def test_entry_queries_have_names_and_oracles():
    import __spark_entry__ as e

    own, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(own) and len(own) >= 60
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in own)


def test_queries_run(spark):
    """Each of the library's own queries gives rows of a fixed schema on the smallest tables."""
    from tidemark.queries import QUERIES

    for name in ("s7_lines", "s11_srt", "d8_labels", "r9_applied", "p1_chosen", "v6_links", "m6_settings_texts", "x12_folder_names", "k1_replies", "s13_repeats"):
        assert (QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0), name


# --- malformed pages


def read(page):
    return web.read_page(page, "https://a.example/")


def test_pages_of_any_markup_are_read():
    assert read("<p>a<![foo[x]]>b")[1].split() == ["ab"]
    assert read("<title>T &amp; <b></title><p>x<!-- never ended <p>y")[0] == "T & <b>"
    assert read("a <! x> b <?php x ?> c </> d <![CDATA[e]]> f")[1].split() == list("abcdf")
    assert read("text <a href='x")[1] == "text <a href='x"
    assert read("<a x='y>t<b>u")[1] == "tu"
    assert read("&#" + "9" * 5000 + ";x")[1].endswith("x") and read("&#" + "0" * 5000 + "65;x")[1] == "Ax"
    assert read("<a href='/&#" + "9" * 5000 + ";'>x</a>")[2][0][1] == "x"
    assert read("<script>if (a<b) x</p></script >y")[1] == "y" and read("<style>x")[1] == ""
    assert read(None) == read("") == ("", "", [])
    for odd in ("<![ x", "<![1", "<!", "</", "<", "<!-->", "<!--->", "<a/b>", "</ p>", "<\0>", "&#xD800;", "<a\0b>"):
        assert isinstance(read(odd)[1], str)


@pytest.mark.parametrize("part", ["<a ", "<a >", "<a 'x>' ", "<a x='", "<!--", "<!-- >", "<", "<title>", "<script", "<div>", "<![CDATA[", "&", "</", "</a ", "<b c=d ", "<p><b>"])
@pytest.mark.parametrize("end", ["", ">"])
def test_long_malformed_pages_take_little_time(part, end):
    page = part * (200_000 // len(part)) + end
    began = time.monotonic()
    read(page)
    assert time.monotonic() - began < 2


def test_description_once():
    page = '<meta name="description" content="A place."><meta property="og:description" content="A place."><p>x'
    assert read(page)[1] == "A place.\n\nx"
