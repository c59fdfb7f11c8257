"""Tables of a run in which only recordings that changed are written again.

Every table is divided into parts by a hash of ``rec_id``. With it goes a small table of digests, one for each recording
that it has rows of, and with each stage a table of marks: what a recording's rows in all that the stage reads were when
it last worked on it, and with which settings. An anti-join of the marks of now with the old ones gives the recordings
to work on; the stage sees only these, and only their parts are overwritten.

What is known about a table or stage is in small files that are replaced in one step, after the rows: a run that is
stopped leaves recordings without a mark, which the next run works on. A table whose files somebody changed is read again,
and recordings whose rows differ from what the stage left are done again.
"""

from __future__ import annotations

import contextlib
import json
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import tables

PART = "part"
#: Columns of the tables about tables.
DIGESTS, MARKS = "rec_id bigint, digest string", "rec_id bigint, mark string"
#: The mark of recordings that are being worked on.
OPEN = ""


def digests(df: DataFrame) -> DataFrame:
    """``rec_id, digest`` of each recording's rows, in any order. Columns must not be maps."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    kinds = ",".join(sorted(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))
    own = df.select("rec_id", h.alias("h")).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s"), F.bit_xor("h").alias("x"))
    return own.select(F.col("rec_id").cast("bigint").alias("rec_id"), F.concat_ws("|", F.xxhash64(F.lit(kinds)).cast("string"), *[F.col(c).cast("string") for c in ("n", "s", "x")]).alias("digest"))


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("rec_id"), F.lit(parts)).cast("int")


@dataclass
class Work:
    """The recordings that a stage works on: ``touched (rec_id)`` with their parts, or all."""

    touched: DataFrame | None = None
    parts: tuple[int, ...] = ()
    most: bool = True  # of all recordings

    def of(self, df: DataFrame) -> DataFrame:
        return df if self.touched is None else df.join(self.touched, "rec_id", "left_semi")


class Store:
    """A folder's tables and what is known about them. ``parts``: into how many each is divided; so many that a part of the
    largest is a file of some hundred megabytes."""

    def __init__(self, spark: SparkSession, folder: str, parts: int):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts
        self._now = threading.local()
        self._lock = threading.Lock()
        self._sources: dict[str, DataFrame] = {}
        self.scope = tables.Scope()  # of what a run keeps to itself

    # --- what is known

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _known(self, kind: str, name: str) -> dict:
        text = tables.get_text(self.spark, f"{self.folder}/_known/{kind}-{name}.json")
        return json.loads(text) if text else {}

    def _learn(self, kind: str, name: str, df: DataFrame, **more) -> None:
        """Replaces the table about a table or stage, and what else is known."""
        old = self._known(kind, name)
        path = f"{self.folder}/_known/{kind}-{name}-{uuid.uuid4().hex}"
        df.coalesce(1 + self.parts // 64).write.parquet(path)
        if kind == "table":
            more["total"] = self.total(self.spark.read.schema(DIGESTS).parquet(path))
        tables.put_text(self.spark, f"{self.folder}/_known/{kind}-{name}.json", json.dumps({"path": path, **more}))
        if old:
            tables.delete(self.spark, old["path"])

    def _unlearn(self, kind: str, name: str) -> None:
        tables.delete(self.spark, f"{self.folder}/_known/{kind}-{name}.json")

    def _about(self, kind: str, name: str, schema: str) -> DataFrame:
        known = self._known(kind, name)
        return self.spark.read.schema(schema).parquet(known["path"]) if known else self.spark.createDataFrame([], schema)

    def marks(self, stage: str) -> DataFrame:
        """``rec_id, mark`` of the recordings that a stage has worked on."""
        return self._about("marks", stage, MARKS)

    def digests(self, name: str) -> DataFrame:
        """``rec_id, digest`` of a table: those known, or of its rows where somebody else wrote them."""
        known = self._known("table", name)
        if known and known["listing"] == tables.listing(self.spark, self.path(name)):
            return self._about("table", name, DIGESTS)
        return digests(self.whole(name)) if self.exists(name) else self.spark.createDataFrame([], DIGESTS)

    def source(self, name: str, df: DataFrame) -> DataFrame:
        """The digests of a source, which is read for them once."""
        with self._lock:
            if name not in self._sources:
                with self.scope:
                    self._sources[name] = tables.written(digests(df), "source")
        return self._sources[name]

    def forget(self) -> None:
        """Lets go of what a run keeps to itself: sources are read for their digests anew."""
        self._sources.clear()
        self.scope.close()

    def total(self, found: DataFrame) -> str:
        """One digest of all recordings'."""
        n, mixed, total = found.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("rec_id", "digest")), F.sum(F.pmod(F.xxhash64("digest", "rec_id"), F.lit(1 << 31)))).first()
        return f"{n}|{mixed}|{total}"

    def table_digest(self, name: str) -> str:
        """Of a table's rows; empty if there is no such table. Files that nobody changed are not read."""
        known = self._known("table", name)
        if known and known["listing"] == tables.listing(self.spark, self.path(name)):
            return known["total"]
        return self.total(self.digests(name)) if self.exists(name) else ""

    def exists(self, name: str) -> bool:
        return bool(self._known("table", name)) and tables.exists(self.spark, self.path(name))

    # --- rows

    def schema(self, name: str) -> T.StructType:
        known = self._known("table", name)
        if not known:
            raise FileNotFoundError(f"there is no table {name} in {self.folder}")
        return T.StructType.fromJson(known["schema"])

    def _parted(self, name: str) -> DataFrame:
        """Rows with their ``part``; a table without rows has its columns, too."""
        schema = T.StructType([*self.schema(name).fields, T.StructField(PART, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path(name))

    def whole(self, name: str) -> DataFrame:
        return self._parted(name).drop(PART)

    def work(self) -> Work:
        return getattr(self._now, "work", None) or Work()

    @contextlib.contextmanager
    def working_on(self, work: Work) -> Iterator[None]:
        outer = self.work()
        self._now.work = work
        try:
            yield
        finally:
            self._now.work = outer

    def read(self, name: str) -> DataFrame:
        """A table's rows of the recordings that are worked on."""
        work = self.work()
        if work.touched is None:
            return self.whole(name)
        return work.of(self._parted(name).where(F.col(PART).isin(*work.parts)).drop(PART))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Puts the rows of the recordings that are worked on in place of their old ones. Parts without them stay."""
        work, path = self.work(), self.path(name)
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
        known = self._known("table", name)
        if work.touched is None or not known:
            df.withColumn(PART, part_of(self.parts)).repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(path)
            if not tables.exists(self.spark, path):
                raise FileNotFoundError(path)
        else:
            own = tables.written(df.withColumn(PART, part_of(self.parts)), "own-rows")
            others = self._parted(name).where(F.col(PART).isin(*work.parts)).join(work.touched, "rec_id", "left_anti")
            out = others.unionByName(own)
            left = {r[0] for r in own.select(PART).union(others.select(PART)).distinct().collect()}  # parts at most
            out.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
            for part in set(work.parts) - left:  # no row left: nothing was written over the old ones
                tables.delete(self.spark, f"{path}/{PART}={part}")
        if work.touched is None or not known:
            about = digests(self.spark.read.schema(T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())])).parquet(path).drop(PART))
        else:
            rows = work.of(self._parted(name).where(F.col(PART).isin(*work.parts)).drop(PART))
            about = self._about("table", name, DIGESTS).join(work.touched, "rec_id", "left_anti").unionByName(digests(rows))
        self._learn("table", name, about, schema=schema.jsonValue(), listing=tables.listing(self.spark, path))
        return self.read(name)

    # --- stages

    def marks_now(self, settings: str, reads: list[str], sources: dict[str, DataFrame]) -> DataFrame:
        """``rec_id, mark``: of each recording that any of the tables and sources has, all that a stage reads of it."""
        every = [self.digests(name).withColumn("of", F.lit(name)) for name in reads if self.exists(name)]
        every += [self.source(name, df).withColumn("of", F.lit("source " + name)) for name, df in sources.items()]
        if not every:
            return self.spark.createDataFrame([], MARKS)
        union = reduce(DataFrame.unionByName, every)
        seen = F.array_sort(F.collect_list(F.concat_ws("=", "of", "digest")))  # one for each table
        return union.groupBy("rec_id").agg(F.sha2(F.concat_ws("\n", F.lit(f"{settings}|{self.parts}"), seen), 256).alias("mark"))

    def step(self, stage: str, settings: str, reads: list[str], sources: dict[str, DataFrame], outputs: list[str], run: Callable[[], None], force: bool = False) -> int:
        """Runs a stage for the recordings that changed, or for all with ``force``; how many these were. ``settings`` is
        all that it depends on besides rows. A recording that is gone from all that the stage reads goes from what it
        leaves."""
        with tables.scope():
            now = tables.written(self.marks_now(settings, reads, sources), "marks")
            total = now.count()
            whole = bool(self._known("marks", stage)) and all(self.exists(name) for name in outputs)
            if force or not whole:
                self._unlearn("marks", stage)
                run()
                self._learn("marks", stage, now)
                return total
            old = self.marks(stage)
            new = now.select("rec_id", F.col("mark").alias("new")).join(old, "rec_id", "full").where(~F.col("new").eqNullSafe(F.col("mark"))).select("rec_id")
            spoiled = [s for name in outputs if (s := self._spoiled(name)) is not None]
            touched = tables.written(reduce(DataFrame.unionByName, [new, *spoiled]).distinct(), "touched")
            found = touched.groupBy(part_of(self.parts).alias(PART)).count().collect()  # parts at most
            if not found:
                for name in outputs:
                    self._same_rows(name)
                return 0
            count, parts = sum(r["count"] for r in found), tuple(sorted(r[PART] for r in found))
            rest = old.join(touched, "rec_id", "left_anti")
            self._learn("marks", stage, rest.unionByName(touched.withColumn("mark", F.lit(OPEN))))
            rest = self.marks(stage).where(F.col("mark") != OPEN)
            every = count >= total and not now.join(touched, "rec_id", "left_anti").limit(1).count()
            with self.working_on(Work() if every else Work(touched, parts, 2 * count > total)):
                run()
            self._learn("marks", stage, now if every else rest.unionByName(now.join(touched, "rec_id", "left_semi")))
            return count

    def _same_rows(self, name: str) -> None:
        """Files that somebody wrote again with the same rows are known from now on."""
        known = self._known("table", name)
        if known["listing"] != (now := tables.listing(self.spark, self.path(name))):
            tables.put_text(self.spark, f"{self.folder}/_known/table-{name}.json", json.dumps(known | {"listing": now}))

    def _spoiled(self, name: str) -> DataFrame | None:
        """Recordings whose rows aren't what the stage left; null if nobody touched the files."""
        known = self._known("table", name)
        if known["listing"] == tables.listing(self.spark, self.path(name)):
            return None
        left = self._about("table", name, DIGESTS).withColumnRenamed("digest", "left")
        return left.join(digests(self.whole(name)), "rec_id", "full").where(~F.col("left").eqNullSafe(F.col("digest"))).select("rec_id")
