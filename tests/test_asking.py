"""Strict replies, and asking an adapter that counts what it is asked."""

import json
import os
import sys
import time
from collections import Counter
from dataclasses import dataclass, replace
from pathlib import Path

import pytest
from pyspark import cloudpickle

from tidemark.functions import ask

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests

SCHEMA = ask.answer(items=[{"name": "string", "at": {"seconds": "double"}, "tags": ["string"]}], ok="boolean")
ITEM = {"name": "a", "at": {"seconds": 1.5}, "tags": ["x"]}


def changed(**more):
    return {"items": [ITEM, {**ITEM, **more}], "ok": True}


def without(key):
    return {"items": [ITEM, {k: v for k, v in ITEM.items() if k != key}], "ok": True}


NOT_IT = "the reply isn't what was asked for"
CASES = [
    ({"items": [], "ok": True}, None),
    ({"items": [ITEM], "ok": False}, None),
    (changed(tags=[]), None),
    (changed(at={"seconds": 3}), None),
    (changed(at={"seconds": 1e300}), None),
    (without("name"), "the reply lacks items[].name"),
    (without("at"), "the reply lacks items[].at"),
    (without("tags"), "the reply lacks items[].tags"),
    (changed(at={}), "the reply lacks items[].at.seconds"),
    (changed(at=None), "the reply lacks items[].at"),
    (changed(tags=[None]), "the reply lacks items[].tags[]"),
    ({"items": [None], "ok": True}, "the reply lacks items[]"),
    ({"items": None, "ok": True}, "the reply lacks items"),
    ({"ok": True}, "the reply lacks items"),
    ({}, "the reply lacks items, ok"),
    (changed(more=1), NOT_IT),
    (changed(at={"seconds": 1, "minutes": 2}), NOT_IT),
    ({"items": [], "ok": True, "z": 1}, NOT_IT),
    (changed(name=5), NOT_IT),
    (changed(name=["a"]), NOT_IT),
    (changed(tags=["a", 1]), NOT_IT),
    ([], "the reply lacks items, ok"),
    ("text", NOT_IT),
    (None, "the reply lacks items, ok"),
]
TEXTS = [("{broken", NOT_IT), ('{"items":[],"ok":true} {}', NOT_IT), ('{"items":[],"ok":true},{"items":[],"ok":true}', NOT_IT), ('{"items":[],"ok":true,"ok":false}', NOT_IT), ("", NOT_IT), (None, "no reply"), (' {"items": [],\n"ok": true} ', None)]


def test_replies_are_decoded_strictly(spark):
    every = [(json.dumps(v), e) for v, e in CASES] + TEXTS
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(every)], "rec_id int, reply string")
    got = {r.rec_id: r for r in ask.decoded(df, SCHEMA).collect()}
    for i, (text, error) in enumerate(every):
        if text == '"text"':
            assert got[i].error and got[i].answer is None
        else:
            assert (got[i].error, got[i].answer is None) == (error, error is not None), text
    assert got[1].answer["items"][0]["at"]["seconds"] == 1.5


@dataclass(frozen=True)
class Counting:
    """Writes down what it is asked; replies to "bad" with an error, to "odd" not as asked, and dies once on "die"."""

    log: str

    def reply(self, instructions, request, schema):
        with open(self.log, "a") as f:
            f.write(request + "\n")
        if "die" in request and not os.path.exists(self.log + ".died"):
            Path(self.log + ".died").touch()
            time.sleep(0.5)
            os._exit(1)
        if "bad" in request:
            raise RuntimeError("it is bad")
        assert json.loads(schema)["additionalProperties"] is False and instructions
        return "{}" if "odd" in request else json.dumps({"items": [{**ITEM, "name": request}], "ok": True})

    def asked(self):
        return Counter(Path(self.log).read_text().split("\n")[:-1]) if os.path.exists(self.log) else Counter()


def requests(spark, texts, prompt="texts"):
    return spark.createDataFrame([(i, prompt, t) for i, t in enumerate(texts)], "rec_id bigint, prompt string, request string")


def outcome(df):
    return {r.rec_id: r.answer["items"][0]["name"] if r.error is None else r.error for r in df.collect()}


@pytest.fixture
def asker(tmp_path):
    return ask.DurableAsker(str(tmp_path / "asked"), Counting(str(tmp_path / "log")), batch=3, per_task=2, wait=0.01, journal=f"file://{tmp_path}/journal")


def test_each_question_is_asked_once(spark, asker):
    texts = ["one", "two", "one", "three", "four", "one", "five", "two"]
    assert outcome(asker.ask(requests(spark, texts), SCHEMA)) == dict(enumerate(texts))
    assert asker.adapter.asked() == Counter(set(texts))
    # other recordings, another session's asker
    again = replace(asker, batch=50, journal=None)
    assert outcome(again.ask(requests(spark, ["six", *texts]), SCHEMA)) == dict(enumerate(["six", *texts]))
    assert asker.adapter.asked() == Counter({*texts, "six"})
    # another prompt, schema or model is another question
    again.ask(requests(spark, ["one"], "texts/2"), SCHEMA).collect()
    replace(again, model="m").ask(requests(spark, ["one"]), SCHEMA).collect()
    other = ask.answer(items=[{"name": "string", "at": {"seconds": "double"}, "tags": ["string"]}], ok="boolean", more="string")
    assert again.ask(requests(spark, ["one"]), other).first().error == "the reply lacks more"
    assert asker.adapter.asked()["one"] == 4
    assert again.ask(requests(spark, []), SCHEMA).count() == 0


def test_failures_are_errors_of_their_recordings(spark, asker):
    texts = ["one", "bad", "odd", "two", "bad"]
    want = {0: "one", 1: "RuntimeError: it is bad", 2: "the reply lacks items, ok", 3: "two", 4: "RuntimeError: it is bad"}
    assert outcome(asker.ask(requests(spark, texts), SCHEMA)) == want
    assert asker.adapter.asked() == Counter({"one": 1, "two": 1, "bad": 2, "odd": 1})  # two attempts
    assert outcome(asker.ask(requests(spark, texts), SCHEMA)) == want  # and again in the next run
    assert asker.adapter.asked() == Counter({"one": 1, "two": 1, "bad": 4, "odd": 2})
    unknown = asker.ask(requests(spark, ["one"], "no-such"), SCHEMA).first()
    assert unknown.error == "no prompt has the name no-such" and asker.adapter.asked()["one"] == 1


def test_a_lost_worker_asks_nothing_twice(spark, asker):
    texts = [f"q{i}" for i in range(9)] + ["die"]
    asker = replace(asker, batch=100, per_task=100)  # one task, that dies with nothing committed
    with pytest.raises(Exception):  # noqa: B017, PT011 - tasks of this session have one attempt
        asker.ask(requests(spark, texts), SCHEMA)
    before = asker.adapter.asked()
    assert before["die"] == 1 and set(before.values()) == {1}
    assert outcome(asker.ask(requests(spark, texts), SCHEMA)) == dict(enumerate(texts))
    after = asker.adapter.asked()
    assert after == Counter({**{f"q{i}": 1 for i in range(9)}, "die": 2})  # only what was being asked
    assert not list(Path(asker.journal.removeprefix("file://")).rglob("*.json"))  # all is in the table


def test_commands(spark, tmp_path):
    code = "import json,os,sys; a = json.load(sys.stdin); assert not os.listdir('.'); sys.exit('no') if 'bad' in a['request'] else print(json.dumps({'items': [], 'ok': a['schema']['type'] == 'object'}))"
    asker = ask.DurableAsker(str(tmp_path / "asked"), ask.CommandAdapter((sys.executable, "-c", code)), attempts=1)
    got = {r.rec_id: r for r in asker.ask(requests(spark, ["one", "bad"]), SCHEMA).collect()}
    assert got[0].error is None and got[0].answer.ok
    assert got[1].error.startswith("RuntimeError: ") and got[1].error.endswith("no")
