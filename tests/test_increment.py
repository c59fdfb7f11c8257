"""Tables in which only changed recordings are written again."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.plans import increment
from tidemark.sources import tables

DDL = "rec_id bigint, idx int, text string"


def rows_of(words):
    return [(rec, i, w) for rec, text in words.items() for i, w in enumerate(text.split())]


class Run:
    """Two stages: upper-cased words of a source, and how many there are; and what they worked on."""

    def __init__(self, spark, folder, words, parts=16):
        self.store = increment.Store(spark, folder, parts)
        self.source = spark.createDataFrame(rows_of(words), DDL)
        self.worked, self.fail = {}, None

    def upper(self):
        work = self.store.work()
        own = work.of(self.source)
        self.worked["upper"] = {r[0] for r in own.select("rec_id").collect()}
        self.store.write(own.withColumn("text", F.upper("text")), "upper")
        if self.fail == "upper":
            raise RuntimeError("broke")
        self.store.write(own.where("text = 'odd'"), "odd")

    def count(self):
        own = self.store.read("upper")
        self.worked["count"] = {r[0] for r in own.select("rec_id").collect()}
        self.store.write(own.groupBy("rec_id").agg(F.count("*").alias("n")), "count")

    def go(self, settings="", force=False):
        self.worked = {}
        a = self.store.step("upper", settings, [], {"words": self.source}, ["upper", "odd"], self.upper, force)
        b = self.store.step("count", "", ["upper"], {}, ["count"], self.count)
        self.store.forget()
        return a, b

    def table(self, name, *cols):
        return {tuple(r) for r in self.store.whole(name).select(*cols).collect()}


def files(folder, name):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in (Path(folder) / name).rglob("part-*.parquet")}


WORDS = {1: "a b", 2: "c odd d", 3: "e", 4: "f g h", -5: "i"}


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "run")


def right(run, words):
    assert run.table("upper", "rec_id", "idx", "text") == {(r, i, t.upper()) for r, i, t in rows_of(words)}
    assert run.table("odd", "rec_id", "idx") == {(r, i) for r, i, t in rows_of(words) if t == "odd"}
    assert run.table("count", "rec_id", "n") == {(r, len(t.split())) for r, t in words.items()}


def test_only_what_changed_is_worked_on(spark, folder):
    run = Run(spark, folder, WORDS)
    assert run.go() == (5, 5)
    right(run, WORDS)
    assert run.go() == (0, 0) and run.worked == {}
    before = files(folder, "upper")
    words = WORDS | {2: "c odd x"}
    run = Run(spark, folder, words)
    assert run.go() == (1, 1) and run.worked == {"upper": {2}, "count": {2}}
    right(run, words)
    after = files(folder, "upper")
    part = spark.createDataFrame([(2,)], "rec_id bigint").select(increment.part_of(16)).first()[0]
    assert before.keys() - after.keys() and all(f"/part={part}/" in f for f in before.keys() ^ after.keys())
    assert all(before[f] == after[f] for f in before.keys() & after.keys())
    # rows in another order are no change; a count that stays goes no further
    run = Run(spark, folder, words)
    run.source = run.source.orderBy(F.rand(3)).repartition(3)
    assert run.go() == (0, 0)
    run = Run(spark, folder, words | {4: "f g y"})
    assert run.go() == (1, 1)
    assert run.go("other settings") == (5, 0)
    assert run.go("other settings", force=True) == (5, 0)


def test_recordings_come_and_go(spark, folder):
    Run(spark, folder, WORDS).go()
    words = {k: v for k, v in WORDS.items() if k != 2} | {6: "odd odd", 7: "j"}
    run = Run(spark, folder, words)
    assert run.go() == (3, 3) and run.worked == {"upper": {6, 7}, "count": {6, 7}}
    right(run, words)
    words = {6: "j"}
    run = Run(spark, folder, words)
    run.go()
    right(run, words)
    run = Run(spark, folder, {})
    run.go()
    right(run, {})
    run = Run(spark, folder, WORDS)
    assert run.go() == (5, 5)
    right(run, WORDS)


def test_a_run_that_breaks_is_taken_up(spark, folder):
    Run(spark, folder, WORDS).go()
    changed = WORDS | {2: "k odd", 4: "odd"}
    run = Run(spark, folder, changed)
    run.fail = "upper"
    with pytest.raises(RuntimeError):
        run.go()
    run = Run(spark, folder, WORDS)  # the old rows again: what was left half done isn't trusted
    assert run.go() == (2, 0)
    right(run, WORDS)
    run = Run(spark, folder, changed)
    assert run.go() == (2, 2)
    right(run, changed)


def test_changed_files_are_noticed(spark, folder):
    run = Run(spark, folder, WORDS)
    run.go()
    path = next(Path(folder, "upper").rglob("part-*.parquet"))
    own = {r.rec_id for r in spark.read.parquet(str(path)).collect()}
    path.unlink()
    assert run.store.table_digest("upper") not in ("", run.store._known("table", "upper")["total"])
    assert run.go() == (len(own), 0) and run.worked == {"upper": own}
    right(run, WORDS)
    # the same rows in other files: read once more, and known from then on
    for f in Path(folder, "count").rglob("part-*.parquet"):
        f.rename(f.with_name("part-renamed.parquet"))
    assert run.go() == (0, 0)
    assert run.store._known("table", "count")["listing"] == tables.listing(spark, run.store.path("count"))
    tables.delete(spark, run.store.path("count"))
    assert run.go() == (0, 5)
    right(run, WORDS)


def test_another_division_writes_all_anew(spark, folder):
    Run(spark, folder, WORDS).go()
    run = Run(spark, folder, WORDS, parts=3)
    assert run.go() == (5, 5)
    right(run, WORDS)
    assert {p.name for p in Path(folder, "upper").iterdir() if p.is_dir()} <= {f"part={k}" for k in range(3)}


def test_small_files_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/a/b.txt"
    assert tables.get_text(spark, path) is None
    for text in ("one", "two é\n", ""):
        tables.put_text(spark, path, text)
        assert tables.get_text(spark, path) == text
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["b.txt"]


def test_tables_of_a_scope_are_deleted(spark):
    df = spark.range(3).withColumnRenamed("id", "rec_id")
    path = lambda t: t.inputFiles()[0].rsplit("/", 1)[0]
    outer = tables.Scope()
    with tables.scope():
        inner = tables.written(df, "inner")
        with outer:
            kept = tables.written(df, "kept")
            named = tables.by_recording(df, "named")
        paths = [path(t) for t in (inner, kept, named)]
        assert all(tables.exists(spark, p) for p in paths)
    assert [tables.exists(spark, p) for p in paths] == [False, True, True]
    outer.close()
    assert not any(tables.exists(spark, p) for p in paths)
