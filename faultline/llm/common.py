"""Helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space. bytes.split() splits UTF-8 at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)


def prepare(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of texts holds, whatever the length of the documents."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(name: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def map_batches(df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str, binary: Iterable[str] = ()) -> DataFrame:
    """mapInArrow over columns as Python lists; `binary` names string columns that arrive as UTF-8 bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out, binary = to_arrow_schema(StructType.fromDDL(schema)), frozenset(binary)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            yield {name: (column.cast(pa.binary()) if name in binary else column).to_pylist() for name, column in zip(batch.schema.names, batch.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in rows(columns(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


