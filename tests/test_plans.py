import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import ask
from tidemark.plans import dag, review


class Box:
    """Stages that write files, and what ran."""

    def __init__(self, path):
        self.path, self.ran, self.fail = path, [], set()

    def stage(self, name, needs=(), text=None, **more):
        def work():
            self.ran.append(name)
            if name in self.fail:
                raise RuntimeError("broke")
            (self.path / name).write_text(text or name)

        return dag.Stage(name, work, tuple(needs), outputs=(str(self.path / name),), **more)

    def run(self, stages, **more):
        self.ran = []
        return {n: r.status for n, r in dag.run(stages, str(self.path / "state.json"), **more).items()}


@pytest.fixture
def box(tmp_path):
    return Box(tmp_path)


def test_reuse(box):
    s = [box.stage("a"), box.stage("b", ["a"]), box.stage("c", ["b"])]
    assert set(box.run(s).values()) == {"done"}
    assert set(box.run(s).values()) == {"reused"} and box.ran == []
    (box.path / "b").write_text("changed by hand")
    assert box.run(s) == {"a": "reused", "b": "done", "c": "reused"}  # the same output again
    s[0] = box.stage("a", text="other", version=2)
    assert box.run(s) == {"a": "done", "b": "done", "c": "reused"}
    s[1] = box.stage("b", ["a"], inputs=("x",), force=True)
    assert box.run(s, targets=["b"]) == {"a": "reused", "b": "done"}


def test_failures(box):
    box.fail = {"a"}
    s = [box.stage("a"), box.stage("b", ["a"]), box.stage("c"), box.stage("r", ["b", "c"], finally_=True)]
    got = box.run(s)
    assert got == {"a": "failed", "b": "skipped", "c": "done", "r": "skipped"}  # its own need wasn't met
    box.fail = set()
    assert box.run(s) == {"a": "done", "b": "done", "c": "reused", "r": "done"}
    none = dag.Stage("n", lambda: None, outputs=(str(box.path / "missing"),))
    [r] = dag.run([none], str(box.path / "s2.json")).values()
    assert r.status == "failed" and "missing" in r.error


def test_final_stages_read_all_others(box):
    """A final stage runs after all others, whatever failed, and again when any of them left something else."""
    s = [box.stage("a"), box.stage("b"), box.stage("r", finally_=True)]
    assert set(box.run(s).values()) == {"done"} and box.ran[-1] == "r"
    assert set(box.run(s).values()) == {"reused"}
    s[0] = box.stage("a", text="new", version=2)
    assert box.run(s) == {"a": "done", "b": "reused", "r": "done"}
    box.fail = {"b"}
    s[1] = box.stage("b", version=2)
    assert box.run(s) == {"a": "reused", "b": "failed", "r": "done"}  # no need of its own failed
    box.fail = set()
    assert box.run(s) == {"a": "reused", "b": "done", "r": "done"}
    assert box.run(s, targets=["r"]) == {"r": "done"}  # of a run without others, their outputs aren't read
    box.fail = {"a"}
    s[0] = box.stage("a", version=3)
    s[2] = box.stage("r", ["a"], finally_=True)
    assert box.run(s) == {"a": "failed", "b": "reused", "r": "skipped"}


def test_a_failed_stage_forgets(box):
    s = [box.stage("a"), box.stage("b", ["a"])]
    box.run(s)
    box.fail = {"a"}
    assert box.run([box.stage("a", force=True), s[1]]) == {"a": "failed", "b": "skipped"}
    box.fail = set()
    assert box.run(s) == {"a": "done", "b": "reused"}  # the file is there still, but not trusted


def test_final_stages_wait_for_each_other(box):
    s = [box.stage("z", ["r"], finally_=True), box.stage("a"), box.stage("r", finally_=True)]
    box.run(s)
    assert box.ran == ["a", "r", "z"]


def test_graph_checks(box):
    with pytest.raises(ValueError, match="twice"):
        dag.checked([box.stage("a"), box.stage("a")])
    with pytest.raises(ValueError, match="isn't a stage"):
        dag.checked([box.stage("a", ["z"])])
    with pytest.raises(ValueError, match="need each other"):
        dag.checked([box.stage("a", ["b"]), box.stage("b", ["a"])])
    with pytest.raises(ValueError, match="no such stage"):
        dag.selected([box.stage("a")], ["q"])
    assert [s.name for s in dag.selected([box.stage("a"), box.stage("b", ["a"]), box.stage("c")], ["b"])] == ["a", "b"]


def test_stages_run_side_by_side(box):
    meet = threading.Barrier(2, timeout=20)

    def work(name):
        meet.wait()
        (box.path / name).write_text("x")

    s = [dag.Stage(n, lambda n=n: work(n), outputs=(str(box.path / n),)) for n in ("a", "b")]
    assert set(box.run(s).values()) == {"done"}


def test_small_things(box):
    (box.path / "state.json").write_text("{broken")
    assert dag.load_state(str(box.path / "state.json")) == {} and dag.digest([str(box.path / "nothing")]) == ""
    assert dag.stale(["Video/a", "Video/b", "notes"], ["Video/a"], ["Video"]) == ["Video/b"]
    results = {"a": dag.Result("done", 1.25)}
    assert '"status": "done"' in dag.record(results, {}, {}) and "1.2 s" in dag.summary(results)


def test_replies(spark):
    schema = T.StructType([T.StructField("n", T.IntegerType(), False), T.StructField("who", T.StringType())])
    replies = spark.createDataFrame([(1, "p", '{"n": 3, "who": "x"}'), (2, "p", "{broken"), (3, "p", '{"who": "x"}')], "rec_id bigint, prompt string, reply string")
    asked = spark.createDataFrame([(i, "p", "?") for i in range(1, 5)], "rec_id bigint, prompt string, request string")
    out = {r.rec_id: r for r in ask.Replies(replies).ask(asked, schema).collect()}
    assert out[1].answer.n == 3 and out[1].error is None
    assert out[2].answer is None and out[3].error == "the reply lacks n" and out[4].error == "no reply"
    assert ask.json_schema(schema) == {"type": "object", "properties": {"n": {"type": "integer"}, "who": {"type": "string"}}, "required": ["n", "who"], "additionalProperties": False}


def test_review(spark):
    rec = spark.createDataFrame([(1,), (2,)], "rec_id bigint")
    part = spark.createDataFrame([(1, "x")], "rec_id bigint, title string")
    out = {r.rec_id: r.text for r in review.assembled(rec, {"text": part}).collect()}
    assert out[1].title == "x" and out[2] is None
    none = F.lit(None)
    flags = review.flags(F.array(F.lit("video")), F.array(F.lit("odd")), F.array(F.lit("fixed")), 3, F.lit(2), F.array(F.lit("b"), F.lit("a")), F.lit(4), F.lit(0))
    quiet = review.flags(none.cast("array<string>"), none.cast("array<string>"), none.cast("array<string>"), 3, none.cast("int"), none.cast("array<string>"), none.cast("int"), none.cast("int"))
    got = rec.limit(1).select(flags.alias("f"), quiet.alias("q")).first()
    assert got.q == [] and len(got.f) == 6 and got.f[0] == "Missing: video." and got.f[4].endswith("a, b")
    assert "&lt;b&gt;" in review.page("<b>", ["x"], {"S": ["<b>"]}) and "<li>x</li>" in review.page("t", ["x"], {})
