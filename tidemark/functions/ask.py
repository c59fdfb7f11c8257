"""Structured questions to a language model, behind a protocol; answers are data that the operators check.

``Replies`` takes recorded replies from a table. ``DurableAsker`` asks an adapter and keeps every good reply in a table:
a question that was answered once is never asked again, by whichever recording, stage or run.
"""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


from tidemark.functions import prompts
from tidemark.sources import tables


def answer(**fields: object) -> T.StructType:
    """A schema of which every field, nested ones too, must be there. A field is a type's name, a dict of fields, or a
    list of either for an array."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}

    def kind(x: object) -> T.DataType:
        if isinstance(x, list):
            return T.ArrayType(kind(x[0]), False)
        return answer(**x) if isinstance(x, dict) else kinds[x]

    return T.StructType([T.StructField(name, kind(x), False) for name, x in fields.items()])


class Asker(Protocol):
    def ask(self, requests: DataFrame, schema: T.StructType) -> DataFrame:
        """Requests ``(rec_id, prompt, request)`` with ``answer``, a struct of ``schema``, and ``error``, null if it has one."""


class Replies:
    """Answers from a table ``(rec_id, prompt, reply)`` of JSON texts: recorded or scripted ones."""

    def __init__(self, replies: DataFrame):
        self.replies = replies

    def ask(self, requests: DataFrame, schema: T.StructType) -> DataFrame:
        out = requests.join(self.replies.select("rec_id", "prompt", "reply"), ["rec_id", "prompt"], "left")
        return decoded(out, schema)


class Adapter(Protocol):
    """What answers one question; it is sent to the tasks, so it must be picklable."""

    def reply(self, instructions: str, request: str, schema: str) -> str:
        """JSON text of the JSON schema ``schema``. What it raises is the request's error."""


@dataclass(frozen=True)
class CommandAdapter:
    """Asks a command: it gets ``instructions``, ``request`` and ``schema`` as a JSON object on its standard input, has an
    empty folder of its own to work in, and prints the reply."""

    command: tuple[str, ...]
    seconds: float = 600.0

    def reply(self, instructions: str, request: str, schema: str) -> str:
        asked = json.dumps({"instructions": instructions, "request": request, "schema": json.loads(schema)})
        with tempfile.TemporaryDirectory(prefix="ask-") as folder:
            out = subprocess.run(self.command, input=asked, capture_output=True, text=True, timeout=self.seconds, cwd=folder, check=False)
        if out.returncode:
            raise RuntimeError(f"{self.command[0]} ended with {out.returncode}: {out.stderr.strip()[-300:]}")
        return out.stdout.strip()


class Journal:
    """Replies of a batch that isn't in the table yet, a file for each: what a task has been told stays known when its
    executor goes. ``folder`` is an address that pyarrow can open on every executor."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)

    def get(self, key: str) -> str | None:
        try:
            with self.fs.open_input_stream(f"{self.path}/{key}.json") as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def put(self, key: str, reply: str) -> None:
        own = f"{self.path}/{key}.{time.time_ns()}.new"
        with self.fs.open_output_stream(own) as f:
            f.write(reply.encode())
        self.fs.move(own, f"{self.path}/{key}.json")


def answered(adapter: Adapter, schema: str, instructions: dict[str, str], journal: str | None, attempts: int, wait: float):
    """A function for ``mapInArrow`` from ``key, prompt, request`` to ``key, reply, failure``, a row at a time."""
    import pyarrow as pa

    out = pa.schema([("key", pa.string()), ("reply", pa.string()), ("failure", pa.string())])

    def one(known: Journal | None, key: str, prompt: str, request: str | None) -> tuple[str | None, str | None]:
        if known and (reply := known.get(key)) is not None:
            return reply, None
        if (text := instructions.get(prompt.split("/")[0])) is None:
            return None, f"no prompt has the name {prompt}"
        for attempt in range(attempts):
            if attempt:
                time.sleep(wait * 2 ** (attempt - 1))
            try:
                reply = adapter.reply(text, request or "", schema)
                if known:
                    known.put(key, reply)
                return reply, None
            except Exception as e:  # noqa: BLE001 - any failure is the request's
                why = f"{type(e).__name__}: {e}"[:500]
        return None, why

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Journal(journal) if journal else None
        for batch in batches:
            for row in batch.to_pylist():
                reply, failure = one(known, row["key"], row["prompt"], row["request"])
                yield pa.RecordBatch.from_pylist([{"key": row["key"], "reply": reply, "failure": failure}], schema=out)

    return run


@dataclass(frozen=True)
class DurableAsker:
    """Asks an adapter on the executors and keeps replies in tables in ``folder``.

    A request's key is made of the prompt's name and version, the schema, ``model`` (what else decides about replies)
    and the request, so equal ones are asked once. Keys without a good reply are asked in batches of about ``batch``,
    a task for each ``per_task`` of them; each batch is added to the table by a commit of its own, and what its tasks
    are told before is kept in ``journal``, if given. A lost executor or a stopped run therefore repeats at most the
    question that was being asked. A request that fails ``attempts`` times, or gets a reply that isn't of the schema,
    is an error of its recordings, and is asked again by the next run.
    """

    folder: str
    adapter: Adapter
    model: str = ""
    batch: int = 1000
    per_task: int = 4
    attempts: int = 2
    wait: float = 1.0
    journal: str | None = None

    def ask(self, requests: DataFrame, schema: T.StructType) -> DataFrame:
        spark = requests.sparkSession
        shape = json.dumps(json_schema(schema), sort_keys=True)
        kind = hashlib.sha256(shape.encode()).hexdigest()[:16]
        path = f"{self.folder.rstrip('/')}/replies-{kind}"
        journal = f"{self.journal.rstrip('/')}/{kind}" if self.journal else None
        versions = F.create_map(*[F.lit(x) for name in prompts.PROMPTS for x in (name, prompts.version(name))])
        version = F.coalesce(F.try_element_at(versions, F.substring_index("prompt", "/", 1)), F.lit(""))
        key = F.sha2(F.concat_ws("\0", F.lit(kind), F.lit(self.model), "prompt", version, F.coalesce("request", F.lit(""))), 256)
        keyed = tables.written(requests.withColumn("__key", key), "asked")
        todo = tables.written(keyed.select(F.col("__key").alias("key"), "prompt", "request").dropDuplicates(["key"]).join(self._good(spark, path), "key", "left_anti"), "to-ask")
        count = todo.count()
        batches = -(-count // self.batch)
        failed = []
        for k in range(batches):
            own = todo.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == k)
            tasks = max(1, -(-min(count, self.batch) // self.per_task))
            run = answered(self.adapter, shape, prompts.PROMPTS, journal, self.attempts, self.wait)
            told = own.repartition(tasks).mapInArrow(run, "key string, reply string, failure string")
            told = tables.written(decoded(told.withColumn("__reply", F.col("reply")), schema).select("key", F.col("__reply").alias("reply"), F.coalesce("failure", "error").alias("failure")), "told")
            told.where("failure IS NULL").select("key", "reply").write.mode("append").parquet(path)
            failed.append(told.where("failure IS NOT NULL").select("key", "failure"))
        if journal and count:
            tables.delete(spark, journal)  # all that it has is in the table, or was no good reply
        good = self._good(spark, path)
        failures = spark.createDataFrame([], "key string, failure string")
        for f in failed:
            failures = failures.unionByName(f)
        out = keyed.join(good.withColumnRenamed("key", "__key"), "__key", "left").join(failures.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
        out = decoded(out, schema)
        return out.withColumn("error", F.when(F.col("error").isNotNull(), F.coalesce("failure", "error"))).drop("failure")

    def _good(self, spark: SparkSession, path: str) -> DataFrame:
        """``key, reply`` of the table; a key that two runs answered at once has one of their replies."""
        if not tables.exists(spark, path):
            return spark.createDataFrame([], "key string, reply string")
        return spark.read.schema("key string, reply string").parquet(path).dropDuplicates(["key"])


#: Spark's names for the types of JSON values, as regular expressions; a list without values has no type.
JSON_TYPES = {T.StringType: "STRING", T.BooleanType: "BOOLEAN", T.IntegerType: "BIGINT", T.LongType: "BIGINT", T.DoubleType: r"(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"}


def type_pattern(kind: T.DataType) -> str:
    """What ``schema_of_variant`` says of a JSON value that has all fields of ``kind``, no others, and values of their types."""
    if isinstance(kind, T.StructType):
        return "OBJECT<" + ", ".join(f"`?{re.escape(f.name)}`?: {type_pattern(f.dataType)}" for f in sorted(kind.fields, key=lambda f: f.name)) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<(VOID|{type_pattern(kind.elementType)})>"
    return JSON_TYPES[type(kind)]


def lacking(value: Column, kind: T.DataType, path: str = "") -> list[Column]:
    """The paths of required values, nested ones too, that are null or not there; null where all are."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields if not f.nullable for x in _lacking_field(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        # one of an array's values is enough to say what is missing
        inside = lambda x: F.coalesce(F.when(x.isNull(), F.lit(f"{path}[]")), *lacking(x, kind.elementType, f"{path}[]"), F.lit(""))
        return [F.get(F.filter(F.transform(value, inside), lambda p: p != ""), F.lit(0))]
    return []


def _lacking_field(value: Column, kind: T.DataType, path: str) -> list[Column]:
    return [F.when(value.isNull(), F.lit(path)), *(F.when(value.isNotNull(), x) for x in lacking(value, kind, path))]


def decoded(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``reply`` decoded strictly as ``answer``: a text that isn't JSON of the schema gives an ``error``, not nulls. Every
    required field must be there, in nested values and in all of a list's too, no others may be, and values have their
    types (a whole number is a number, too)."""
    df = df.withColumn("__a", F.from_json("reply", _nullable(schema)))
    missing = F.array_join(F.array_compact(F.array(*lacking(F.col("__a"), schema))), ", ")
    # of a type with fields that need not be there, only known ones are looked at
    shape = F.schema_of_variant(F.try_parse_json("reply")).rlike(f"^{type_pattern(schema)}$") if _strict(schema) else F.lit(True)
    # parsers stop at a value's end: in brackets, nothing may come after it
    listed = F.concat(F.lit("["), "reply", F.lit("]"))
    whole = F.try_parse_json(listed).isNotNull() & (F.size(F.from_json(listed, "array<string>")) == 1)
    error = (
        F.when(F.col("reply").isNull(), F.lit("no reply"))
        .when(~F.coalesce(whole, F.lit(False)) | F.try_parse_json("reply").isNull() | F.col("__a").isNull(), F.lit("the reply isn't what was asked for"))
        .when(missing != "", F.concat(F.lit("the reply lacks "), missing))
        .when(~F.coalesce(shape, F.lit(False)), F.lit("the reply isn't what was asked for"))
    )
    return df.withColumn("error", error).withColumn("answer", F.when(error.isNull(), F.struct(*[F.col(f"__a.{f.name}").alias(f.name) for f in schema.fields]))).drop("__a", "reply")


def _nullable(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind.fields])
    return T.ArrayType(_nullable(kind.elementType), True) if isinstance(kind, T.ArrayType) else kind


def _strict(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(not f.nullable and _strict(f.dataType) for f in kind.fields)
    return _strict(kind.elementType) if isinstance(kind, T.ArrayType) else True


def json_schema(kind: T.DataType) -> dict:
    """The strict JSON schema of a Spark type: every field required, nothing more allowed."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "required": [f.name for f in kind.fields], "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    names = {T.StringType: "string", T.BooleanType: "boolean", T.DoubleType: "number", T.FloatType: "number", T.IntegerType: "integer", T.LongType: "integer"}
    return {"type": names[type(kind)]}


def versioned(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt, 256), 1, 8)
