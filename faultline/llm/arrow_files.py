"""Token files in the Arrow file format with fixed-size-list batches.

A data file holds sequences of `size` ids and their masks as two fixed-size-list columns; the last sequence of a file is
filled up with zeros whose mask is false. As every row has the same width and batches have the same number of rows, sequence
i is in batch i // rows, and a memory map gives it without copying. Beside each data file stands an index file with one row
per document: doc_id, first id and number of ids in that data file.

Documents are dealt by ranges of doc_id and sorted, so files in order hold the ids in ascending doc_id order. Every task
writes names of its own and reports them; only files of the written manifest count, so files of lost or repeated attempts
are never read. All files are in a folder that all executors share.

Defined cases: null text is the end id alone; documents without doc_id come first; repeated doc_ids stand side by side,
ordered by text; an empty table writes an empty manifest; extra columns are ignored."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import _shared_folder, checkpoint
from .common import map_batches, prepare, whole_text
from .tokens import DEFAULT_FILE, END_ID, encode_texts, load, portions, tokenizer_path, worker_encoder

SEQUENCE, BATCH_ROWS = 2048, 256
#: Bytes of text that are encoded together.
AT_ONCE = 8 << 20
MANIFEST = "part long, n_docs long, n_tokens long, data_file string, index_file string"


def _open(folder: str):
    """File system and path of a shared folder, for tasks: local, HDFS or object stores as Arrow knows them."""
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)


def id_type(vocabulary: int) -> pa.DataType:
    """The narrowest unsigned type that holds every id."""
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


def data_schema(size: int, ids: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(ids, size)), pa.field("mask", pa.list_(pa.bool_(), size))], {"sequence": str(size)})


def _batch(ids: np.ndarray, valid: int, schema: pa.Schema, size: int) -> pa.RecordBatch:
    mask = np.zeros(len(ids), bool)
    mask[:valid] = True
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids), size), pa.FixedSizeListArray.from_arrays(pa.array(mask), size)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class SequenceWriter:
    """Fills sequences with the ids it is given and writes a batch whenever `rows` sequences are full."""

    def __init__(self, sink, size: int, rows: int, ids: pa.DataType):
        self.schema, self.size, self.block = data_schema(size, ids), size, size * rows
        self.dtype = ids.to_pandas_dtype()
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts, self.held, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            ids = np.concatenate(self.parts)
            whole = len(ids) - len(ids) % self.block
            for at in range(0, whole, self.block):
                self.writer.write_batch(_batch(ids[at:at + self.block], self.block, self.schema, self.size))
            self.parts, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.held:
            ids = np.zeros(-(-self.held // self.size) * self.size, self.dtype)
            ids[:self.held] = np.concatenate(self.parts)
            self.writer.write_batch(_batch(ids, self.held, self.schema, self.size))
        self.writer.close()


class SequenceReader:
    """Random access to a data file: by sequence, or to any range of its id stream."""

    def __init__(self, source: pa.NativeFile):
        self.file = pa.ipc.open_file(source)
        self.size = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self.at, self.held = -1, None

    def _values(self, batch: int, column: str) -> pa.Array:
        array = self.file.get_batch(batch).column(column)
        return array.values.slice(array.offset * self.size, len(array) * self.size)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence i."""
        batch, row = divmod(i, self.rows)
        ids = self._values(batch, "ids").slice(row * self.size, self.size).to_numpy()
        return ids, self._values(batch, "mask").slice(row * self.size, self.size).to_numpy(zero_copy_only=False)

    def _block(self, batch: int) -> np.ndarray:
        """All ids of a batch; that of the last call stays at hand."""
        if self.at != batch:
            self.at, self.held = batch, self._values(batch, "ids").to_numpy()
        return self.held

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the stream; a view if they lie in one batch."""
        block, parts = self.rows * self.size, []
        while n > 0:
            batch, at = divmod(start, block)
            part = self._block(batch)[at:at + min(n, block - at)]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write(docs: DataFrame, folder: str | None = None, size: int = SEQUENCE, tokenizer: str = DEFAULT_FILE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all documents and returns the manifest, one row per data file in stream order, with `base`: the ids before it."""
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or f"{_shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    path = tokenizer_path(tokenizer)
    narrow = id_type(load(path).get_vocab_size())
    kind = pa.from_numpy_dtype(np.int64) if docs.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()

    def save(batches):
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        cache, writer, n_docs = worker_encoder(path), None, 0
        index_schema = pa.schema([("doc_id", kind), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            if writer is None:
                sink = fs.open_output_stream(f"{root}/{name}.ids.arrow")
                writer = SequenceWriter(sink, size, BATCH_ROWS, narrow)
                index_sink = fs.open_output_stream(f"{root}/{name}.docs.arrow")
                index = pa.ipc.new_file(index_sink, index_schema)
            first, lengths = writer.total, []
            for texts in portions(batch["text"], AT_ONCE):
                ids, counts = encode_texts(cache, texts, END_ID)
                writer.add(ids.astype(writer.dtype))
                lengths.append(counts)
            lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
            starts = first + np.cumsum(lengths) - lengths
            index.write_batch(pa.RecordBatch.from_arrays([pa.array(batch["doc_id"], kind), pa.array(starts), pa.array(lengths)], schema=index_schema))
            n_docs += len(lengths)
        if writer is not None:
            for part, target in ((writer, sink), (index, index_sink)):
                part.close()
                target.close()
            yield {"part": [context.partitionId()], "n_docs": [n_docs], "n_tokens": [writer.total], "data_file": [f"{name}.ids.arrow"], "index_file": [f"{name}.docs.arrow"]}

    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = checkpoint(map_batches(ordered, save, MANIFEST, binary=["text"]))
    before = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")
    return manifest.withColumn("base", before).withColumn("folder", F.lit(folder))


def read_back(spark: SparkSession, manifest: DataFrame, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; a file is read batch by batch."""

    def digest(batches):
        for batch in batches:
            for base, folder, data_file, index_file in zip(batch["base"], batch["folder"], batch["data_file"], batch["index_file"]):
                fs, root = _open(folder)
                local = isinstance(fs, pa.fs.LocalFileSystem)
                opened = (lambda name: pa.memory_map(f"{root}/{name}")) if local else (lambda name: fs.open_input_file(f"{root}/{name}"))
                with opened(data_file) as data, opened(index_file) as documents:
                    reader, index = SequenceReader(data), pa.ipc.open_file(documents)
                    for i in range(index.num_record_batches):
                        part = index.get_batch(i).to_pydict()
                        crcs = [zlib.crc32(reader.ids(s, n).astype("<u4")) for s, n in zip(part["start"], part["n_tokens"])]
                        yield {"doc_id": part["doc_id"], "start": [base + s for s in part["start"]], "n_tokens": part["n_tokens"], "ids_crc32": crcs}

    spread = manifest.repartition(max(1, manifest.count()), "data_file")  # a given number, as these few rows stand for much work
    return map_batches(spread, digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("doc_id", key)


def round_trip(docs: DataFrame, size: int = SEQUENCE, tokenizer: str = DEFAULT_FILE, key: str = "doc_id", text: str = "text") -> DataFrame:
    manifest = write(docs, None, size, tokenizer, key, text)
    return read_back(docs.sparkSession, manifest, key, docs.schema[key].dataType.simpleString())
