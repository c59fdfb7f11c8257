"""Pieces that several corpus operators share: word splitting, Arrow plumbing, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.sources.tables import written  # noqa: F401 - the operators take it from here

#: Rows of a batch turned into Python objects at once.
ROWS_AT_ONCE = 256
#: Rows that a mapping function gets and returns at once.
ROWS_OUT = 1024


def _alnum_table() -> bytes:
    """Maps A-Z to a-z, keeps a-z, 0-9 and all bytes of non-ASCII characters, and turns the rest into blanks."""
    keep = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 0x20 for b in range(256))


ALNUM = _alnum_table()


def alnum_words(text: bytes | None) -> list[bytes]:
    r"""Lower-cased words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a UTF-8 text; null has none."""
    return text.translate(ALNUM).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    r"""A-Z lower-cased words ``[^\x20\x09-\x0D]+`` of a UTF-8 text; null has none."""
    return text.lower().split() if text else []


def values(column: pa.Array, binary: bool = False) -> Iterator:
    """Values of a column one by one, a few hundred Python objects at a time; ``binary``: strings as UTF-8 bytes."""
    for at in range(0, len(column), ROWS_AT_ONCE):
        part = column.slice(at, ROWS_AT_ONCE)
        yield from (part.cast(pa.large_binary()) if binary else part).to_pylist()


def arrow_schema(ddl: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl) if isinstance(ddl, str) else ddl)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with a function made once per task; it returns columns (name to values) for some rows at a time."""
    arrow = arrow_schema(schema)

    def run(batches):
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                out = fn(whole.slice(at, ROWS_OUT))
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def schema_of(df: DataFrame, *names: str, more: str = "") -> T.StructType:
    """The named columns of ``df`` (nullable), then those of the DDL ``more``, which must have other names."""
    kept = [T.StructField(n, df.schema[n].dataType, True) for n in names]
    made = T._parse_datatype_string(more).fields if more else []
    if clash := sorted({*names} & {f.name for f in made}):
        raise ValueError(f"columns {clash} are made here; rename them first")
    return T.StructType(kept + made)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
