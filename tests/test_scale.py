"""What queries write and shuffle: words go where their recording is, once."""

import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from test_operators import TURNS, WORDS, random_words, speaking_naive
from tidemark import queries, run_queries  # noqa: F401 - adds its queries
from tidemark.operators import corrections, cuts, turns as tn, words as wd
from tidemark.sources import derived, tables


def plan(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_highlights_need_no_join(spark):
    rng = random.Random(3)
    w = spark.createDataFrame([x for rec in range(20) for x in random_words(rng, rng.randrange(1, 80), rec)], WORDS)
    for limits in (wd.CAPTIONS, wd.CLIP_CAPTIONS):
        a = wd.caption_highlights(w, wd.cues(w, limits), F.lit(0.25)).orderBy("rec_id", "idx").collect()
        assert a == wd.highlighted(wd.cues(w, limits, whole=True), F.lit(0.25)).orderBy("rec_id", "idx").collect()
    own = plan(queries.QUERIES["s15_highlights"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in own and own.count("Exchange") == 1


def test_words_are_dealt_out_in_small_parts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert tables.parts_of(docs) > 4  # 15 MB, which become 100 of words
    assert tables.parts_of(spark.createDataFrame([(1, "a")], "doc_id bigint, text string")) == 4


def test_corrections_leave_words_where_they_are(spark):
    w = derived.stored_words(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    edits = tables.written(spark.createDataFrame([(0, 0, 2, 3, "So it goes", True), (0, 1, 5, 5, "Thee", True), (1, 0, 0, 2, "x", True), (1, 1, 4, 4, "no", False)], "rec_id bigint, pos int, first int, last int, replace string, applied boolean"), "edits")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corrections.applied(w, edits)
        assert not re.search(r"Exchange[^\n]*\n[^\n]*Scan parquet spark_catalog", plan(out)) and "Union" not in plan(out)
        got = out.where("rec_id < 2").orderBy("rec_id", "idx").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    old = w.where("rec_id < 2").orderBy("rec_id", "idx").collect()
    for rec, spans in ((0, {2: (2, 3), 5: (1, 1)}), (1, {0: (3, 1)})):  # of each edit: words replaced, words for them
        o, g = [x for x in old if x.rec_id == rec], [x for x in got if x.rec_id == rec]
        assert [x.idx for x in g] == list(range(len(g)))
        i = j = 0
        while i < len(o):
            n, m = spans.get(i, (1, 1))
            assert (g[j].start, round(g[j + m - 1].end, 9)) == (o[i].start, round(o[i + n - 1].end, 9))
            assert i in spans or g[j].text == o[i].text
            i, j = i + n, j + m
        assert j == len(g)


@pytest.mark.parametrize("name", ["h1_page_texts", "h1_malformed_texts", "m6_settings_texts"])
def test_references_without_their_end_are_text_as_in_sql(spark, tmp_path, name):
    import duckdb

    html = '<html><head><title>A &amp; b&amp;&amp</title></head><body><p>c &lt;d&gt; & e&am</p><ul><li><a href="/x?a=1&b=2">One</a></li></ul></body></html>'
    spark.createDataFrame([(1, "https://www.a.example/b", html)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == con.execute(queries.SQL[name]).fetchall()


def test_phrases_are_found_in_other_spellings_and_at_equal_distances(spark, tmp_path):
    import duckdb

    docs = [(1, "So it, GOES on here. " * 3), (2, "so it goes"), (3, "So i t goes, on Here"), (4, "nothing"), (5, "hi there " * 200), (6, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "so it goes on here"), (2, "Hi"), (3, "goes on"), (4, "?")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["s6_find"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert len(got) >= 5 and got == sorted(con.execute(queries.SQL["s6_find"]).fetchall())
    # 99.96 and 100.04 are as near to 100; the earlier one counts
    w = spark.createDataFrame([(1, 0, "a", 69.9, 70.0), (1, 1, "b", 99.96, 99.99), (1, 2, "b", 100.04, 100.1), (1, 3, "c", 130.1, 130.2)], WORDS)
    p = spark.createDataFrame([(1, 1, "b", 100.0, 30.0), (1, 2, "c", 100.1, 30.0)], "rec_id bigint, phrase_id int, phrase string, near double, window double")
    assert sorted((r.phrase_id, r.first) for r in wd.find(w, p).collect()) == [(1, 1), (2, 3)]


@pytest.mark.parametrize("window", [30.0, 45.0])
def test_quotes_are_found_without_shuffling_words(spark, window):
    w = derived.stored_words(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    p = tables.written(spark.createDataFrame([(0, 1, "so it goes", 10.0, window)], "rec_id bigint, phrase_id int, phrase string, near double, window double"), "quotes")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = plan(wd.find(w, p))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert own.count("Exchange") == 1  # the phrases'


def dense_turns(rng, rec, n):
    """Turns that overlap, are inside others or last no time, some equal."""
    own = sorted((a / 10, (a + rng.choice([0, 3, 10, 10, 200])) / 10, rng.choice("AB")) for a in (rng.randrange(300) for _ in range(n)))
    return [(rec, i, *t) for i, t in enumerate(own)]


def at_naive(turns, t):
    return next((x[4] for x in turns if x[2] <= t < x[3]), None)


@pytest.mark.parametrize("name", ["at", "speaking", "labelled"])
def test_points_and_turns_meet_in_one_pass(spark, name):
    rng = random.Random(9)
    recs = {r: dense_turns(rng, r, rng.randrange(1, 60)) for r in range(30)}
    turns = spark.createDataFrame([t for ts in recs.values() for t in ts], TURNS)
    points = [(r, k, rng.randrange(-10, 700) / 10) for r in range(31) for k in range(40)]
    df = spark.createDataFrame([*points, (5, 99, None), (None, 98, 1.0)], "rec_id bigint, point_id int, t double")
    if name == "labelled":
        out = tn.labelled(df, turns, turns.select("rec_id", "speaker").distinct().where("speaker = 'A'").withColumn("name", F.lit("Ann"))).withColumnRenamed("label", "got")
        want = lambda ts, t: {"A": "Ann"}.get(speaking_naive(ts, t), "(unclear)")
    else:
        out = (tn.at(df, turns) if name == "at" else tn.speaking(df, turns)).withColumnRenamed("at" if name == "at" else "speaker", "got")
        want = at_naive if name == "at" else speaking_naive
    got = [(x.rec_id, x.point_id, x.got) for x in out.collect()]
    nobody = "(unclear)" if name == "labelled" else None
    assert sorted(got, key=str) == sorted([*((r, k, want(recs.get(r, []), t)) for r, k, t in points), (5, 99, nobody), (None, 98, nobody)], key=str)


@pytest.mark.parametrize("name, joins, exchanges", [("d2_at", 0, 2), ("d3_speaking", 0, 2), ("d8_labels", 1, 4)])
def test_events_are_dealt_out_once_for_points_and_once_for_turns(spark, name, joins, exchanges):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(re.findall(r"\w*Join\b", own)) == joins and own.count("Exchange") == exchanges


def test_labels_are_joined_without_dealing_out_points_again(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = plan(queries.QUERIES["d8_labels"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "hashpartitioning(rec_id, speaker, 4)" in own  # of the distinct names alone
    assert own.index("SortMergeJoin") < own.index("Window") and not re.search(r"SortMergeJoin[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange[^\n]*\n[^\n]*Window", own)


def test_words_are_assembled_by_segment_in_two_sorts(spark):
    own = plan(queries.QUERIES["s1_assemble"](spark, "/root/testdata/sf0.001"))
    assert own.count("Exchange") == 1 and len(re.findall(r"\bSort \[", own)) == 2  # of words as they are timed, and as they are numbered
    rng = random.Random(4)
    tokens = [(rec, seg, pos, rng.choice([" a", "b", " c ", "d ", "[_X]", " ", " —", "."]), rng.choice([-1, 7]), 10 * pos) for rec in range(9) for seg in range(4) for pos in range(rng.randrange(30))]
    rng.shuffle(tokens)
    got = wd.assemble(spark.createDataFrame(tokens, "rec_id bigint, seg int, pos int, text string, t_dtw int, offset_ms int")).orderBy("rec_id", "idx").collect()
    want, last = [], None
    for rec, seg, _, text, dtw, ms in sorted(t for t in tokens if not t[3].startswith("[_") and t[3].strip(" ")):
        if text[0] == " " or (rec, seg) != last:
            want.append([rec, text.strip(" "), dtw / 100 if dtw >= 0 else ms / 1000])
        else:
            want[-1][1] += text
        last = rec, seg
    assert [[r.rec_id, r.text, r.start] for r in got] == [w for w in want if any(c.isalnum() for c in w[1])]


@pytest.mark.parametrize("name", ["c1_cut_words", "b1_detected", "b4_names", "r2_outcomes", "p1_chosen", "p2_checked", "p3_lead_ins", "d2_at", "d8_labels"])
def test_slices_hold_every_recording_and_go_one_after_another(spark, monkeypatch, name):
    d = "/root/testdata/sf0.001"
    table = "events" if name in ("d2_at", "d8_labels") else "documents"
    want = sorted(map(tuple, queries.QUERIES[name](spark, d).collect()), key=str)
    monkeypatch.setattr(tables, "SLICE_BYTES", -(-tables._stored_bytes(spark.read.parquet(f"{d}/{table}.parquet")) * (1 + (table == "documents")) // 3))
    root, of, kept = tables.shared_dir(spark).removeprefix("file:"), derived.word_times, []
    before = {x.name for x in pathlib.Path(root).iterdir()}
    monkeypatch.setattr(derived, "word_times", lambda *a: (kept.append({x.name for x in pathlib.Path(root).iterdir()} - before), of(*a))[1])
    out = queries.QUERIES[name](spark, d)
    assert sorted(map(tuple, out.collect()), key=str) == want
    left = {x.name for x in pathlib.Path(root).iterdir()} - before
    assert len(left) == 1 and len(kept) == (3 if table == "documents" else 0) and all(x <= left for x in kept)  # but for results, nothing stays
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_part_is_a_megabyte_of_stored_documents_and_slices_share_them(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    whole = tables.parts_of(docs)
    assert whole >= tables._stored_bytes(docs) / 1e6 - 1 and tables.parts_of(docs, 3) == -(-tables._stored_bytes(docs) // (3 * tables.PART_BYTES))


@pytest.mark.parametrize("name", ["s17_loops", "s17_transcribed"])
def test_loops_of_short_chunks_are_heard_to_their_end_as_in_sql(spark, tmp_path, name):
    import duckdb

    docs = [(4, "a"), (12, "I —"), (3, "word " * 80 + "a"), (11, "so. " * 160 + "b c"), (20, "longer " * 30), (5, "a"), (28, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(queries.SQL[name]).fetchall())


def test_quotes_and_cuts_read_stored_words_once_each_without_sorting_them(spark):
    w = derived.stored_words(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    quotes = tables.written(spark.createDataFrame([(0, 1, "so it goes", 10.0, 45.0)], "rec_id bigint, phrase_id int, phrase string, near double, window double"), "quotes")
    ranges = tables.written(spark.createDataFrame([(0, 0, 3, 9)], "rec_id bigint, cut_id int, first int, last int"), "ranges")
    threshold, kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(wd.find(w, quotes))
        cut = plan(cuts.cut_words(w, ranges, cuts.pauses_between(w), lambda df, name: (kept.append(plan(df)), tables.written(df, name))[1]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # times of the whole, beginnings and what follows; the ends of ranges; pauses of both sides
    assert [p.count("FileScan parquet spark_catalog") for p in (found, *kept, cut)] == [3, 1, 1]
    assert not any(re.search(r"Sort \[rec_id ASC NULLS FIRST, (idx|bin|e|k)\b", p) for p in (found, *kept, cut))
