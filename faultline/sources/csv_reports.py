"""CSV export of reports -> DataFrame -> Parquet.

Records may span lines, so where a record ends depends on all quotes before it in the file. Files are split all the same:

1. Each byte range of the scan says in which state (outside or inside a quoted field) it ends, for either state it may begin in:
   it leaves the state as it is, swaps it, or ends in one state whatever came before.
2. The state at the start of a range is that of the last range before it that ends in a fixed state, swapped as often as a range in
   between swaps: running sums over one row per range.
3. Each range then cuts its lines into records. Pieces of records that cross a border are put together, two at most per range."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RAW_COLUMNS, RunConfig
from ..session import checkpoint

# Texts that stand for a missing value.
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
_RECORD = "_record"
#: Records of a range that are numbered before the next range's numbers begin.
NUMBER_BITS = 33
WHOLE, HEAD, TAIL, MIDDLE = range(4)


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open after the line. A quote opens a field only as its first character, and two are one inside."""
    at = 0
    while True:
        if not inside and line[at:at + 1] == b'"':
            inside, at = True, at + 1
        while inside:
            end = line.find(b'"', at)
            if end < 0:
                return True
            inside = line[end + 1:end + 2] == b'"'
            at = end + 2 if inside else end + 1
        at = line.find(b",", at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, start): raw lines and the byte range of the scan they begin in, in the order of the file."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, list[bytes]]]:
    """The ranges in a batch: (file, start), place of the first line, lines."""
    files, starts, lines = (batch.column(c).to_pylist() for c in ("file", "start", "line"))
    at = 0
    while at < len(lines):
        first = at
        while at < len(lines) and starts[at] == starts[first] and files[at] == files[first]:
            at += 1
        yield (files[first], starts[first]), first, lines[first:at]


def range_states(lines: DataFrame) -> DataFrame:
    """(file, start, number, inside): the state at the start of each range, and its number in the order of files and ranges."""
    def ends(batches):
        own, states = None, (False, True)
        row = lambda: pa.RecordBatch.from_pylist([{"file": own[0], "start": own[1], "outside_to": states[0], "inside_to": states[1]}])
        for batch in batches:
            for key, _, part in _ranges(batch):
                if key != own:
                    if own:
                        yield row()
                    own, states = key, (False, True)
                for line in part:
                    if b'"' in line:                                           # without a quote nothing opens or closes
                        states = tuple(inside_after(line, s) for s in states)
        if own:
            yield row()

    found = lines.mapInArrow(ends, "file string, start long, outside_to boolean, inside_to boolean")
    up_to, before = Window.partitionBy("file").orderBy("start"), Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.withColumn("swaps", F.sum((F.col("outside_to") & ~F.col("inside_to")).cast("long")).over(up_to))
    fixed = F.when(F.col("outside_to") == F.col("inside_to"), F.struct(F.col("outside_to").alias("to"), F.col("swaps").alias("at")))
    known = F.coalesce(F.last(fixed, ignorenulls=True).over(before), F.struct(F.lit(False).alias("to"), F.lit(0).cast("long").alias("at")))
    states = sums.withColumns({"known": known, "swapped": F.coalesce(F.last("swaps").over(before), F.lit(0))})
    inside = F.col("known.to") != ((F.col("swapped") - F.col("known.at")) % 2 == 1)
    # One row per range of the scan, by default 128 MB of input.
    return states.select("file", "start", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("file", "start")) - 1).cast("long").alias("number"), inside.alias("inside"))


def records(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(pos, first, record): the text of each record with its place in the order of the files; `first` tells a file's first record."""
    lines = _lines(spark, path)
    ddl = "file string, start long, number long, i long, kind int, record string"
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("i", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])

    def cut(batches):
        own, held, begun, inside, i, out = None, [], True, False, 0, []

        def add(kind: int) -> None:
            out.append((*own, i, kind, b"\n".join(held).decode(encoding)))
            held.clear()

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            numbers, states = batch.column("number").to_pylist(), batch.column("inside").to_pylist()
            for key, first, part in _ranges(batch):
                if own is None or key != own[:2]:
                    if held:
                        add(TAIL if begun else MIDDLE)
                    own, inside, begun, i = (*key, numbers[first]), states[first], not states[first], 0
                for line in part:
                    held.append(line)
                    if b'"' in line:
                        inside = inside_after(line, inside)
                    if not inside:
                        add(WHOLE if begun else HEAD)
                        begun, i = True, i + 1
            if out:
                yield full()
        if held:
            add(TAIL if begun else MIDDLE)
            yield full()

    placed = lines.join(F.broadcast(range_states(lines)), ["file", "start"])       # one row per range
    pieces = checkpoint(placed.select("line", "file", "start", "number", "inside").mapInArrow(cut, ddl))
    order = Window.partitionBy("file").orderBy("start", "kind")
    owner = F.last(F.when(F.col("kind") == TAIL, F.struct("start", "number", "i")), ignorenulls=True).over(order)
    crossing = pieces.filter(F.col("kind") != WHOLE).withColumn("owner", owner)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"]), "\n")
    joined = crossing.groupBy("file", "owner").agg(text.alias("record")).select("owner.*", "record")
    every = pieces.filter(F.col("kind") == WHOLE).select("start", "number", "i", "record").unionByName(joined)
    return every.select((F.shiftleft("number", NUMBER_BITS) + F.col("i")).alias("pos"), ((F.col("start") == 0) & (F.col("i") == 0)).alias("first"), "record")


def _header(spark: SparkSession, path: str, config: RunConfig) -> list[str]:
    """Column names: the first line only, so no data row reaches the driver."""
    line = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary")).limit(1).first()
    if line is None:
        raise ValueError(f"no header in {path}")
    return next(csv.reader([bytes(line[0]).removeprefix("﻿".encode()).decode(config.csv_encoding).lstrip("﻿").rstrip("\r")]))


def read_reports_csv(spark: SparkSession, path: str, config: RunConfig = RunConfig()) -> DataFrame:
    """All columns as text under their short names, with `ingest_pos` (file order).

    Rows with too many fields are dropped, short rows are padded with nulls, blank lines skipped; quoted newlines and doubled
    quotes stay inside a field. Every file begins with the header. Large files are read by many tasks."""
    names = [RAW_COLUMNS.get(n, n) for n in _header(spark, path, config)]
    found = records(spark, path, config.csv_encoding).withColumn("record", F.regexp_replace("record", "\r$", "")).filter("NOT first AND record <> ''")
    options = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RECORD, "maxCharsPerColumn": "-1"}
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, _RECORD])
    parsed = found.select(F.col("pos").alias("ingest_pos"), F.from_csv("record", ddl, options).alias("row"))

    @F.pandas_udf("int")
    def fields(rows: pd.Series) -> pd.Series:
        """Fields of a record that does not have the header's number of them, empty ones counted."""
        return rows.map(lambda r: len(next(csv.reader(io.StringIO(r, newline="")), [])))

    odd = F.col(f"row.{_RECORD}").isNotNull()
    cells = [F.when(~F.col("row")[n].isin(NA_TEXTS), F.col("row")[n]).alias(n) for n in names]
    return parsed.filter(~odd | F.coalesce(F.when(odd, fields(f"row.{_RECORD}")) <= len(names), F.lit(True))).select("ingest_pos", *cells)


def write_reports(df: DataFrame, path: str) -> DataFrame:
    """Store as Parquet once; later reads prune columns and split files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
