"""Repeated substrings across documents by a run-length index.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier, in the order of (doc_id, start), judged on the
input. Strings never cross documents.

1. Texts are written once as blocks of a few megabytes, bucketed by block, so that later joins by block move no text.
2. Every string of 100 bytes has one anchor: its least 37-byte gram by hash, the leftmost of equals. Neighbouring strings with
   the same anchor form a stretch (at most 64 starts). Equal strings have equal anchors, so only stretches with the same
   anchor can share one; blocks send the distinct (anchor, hash of the stretch) pairs, and each gets back a code: alone,
   copied as a whole only, or beside other stretches of that anchor, of which one block sends the bytes.
3. Stretches meet by anchor in buckets of bounded size: equal ones are copies, all but the earliest go. The distinct ones are
   made into a run-length index (`run_index`), in their order; every start is matched against it, and starts whose strings
   are equal keep the earliest.
4. The marks go back to the blocks, whose documents unite them to spans.

An anchor with over `HOT` distinct stretches (the edge of a passage that very many documents share) does not gather in one
bucket: its strings are dealt one by one, by their own hash. A stretch that very many blocks have sends one short record
per block, so `BLOCK_BYTES` bounds what a bucket may hold of it: at 64 MB a block, 100 TB make 40 MB.

Defined cases: null text counts as empty; texts under 100 bytes keep all; any bytes may occur; a very long text makes a block
of its own and is read in pieces; doc_id is an integer, null sorts first (with the least long); rows that share doc_id and
text are one document and get the same result; rows that share only doc_id are ordered by a hash of the text; an empty
table gives an empty result; other columns are ignored."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import _shared_folder, checkpoint
from .common import prepare, whole_text
from .run_index import RunIndex

LENGTH, GRAM = 100, 37
#: Grams of one string; also the most starts of one stretch, so that a mark per start fits a long.
SPAN = LENGTH - GRAM + 1
BLOCK_BYTES = 4 << 20
#: Distinct stretches of one anchor that meet in one bucket.
HOT = 1 << 14
#: Pairs and bytes that one bucket is planned for.
BUCKET_PAIRS, BUCKET_BYTES = 1_000_000, 6 << 20
#: Starts that are looked at together.
PIECE = 1 << 21
#: Codes of pairs.
ALONE, COPIED, SEND, DEAL = 0, 1, 2, 3
RECORD = np.dtype([("fp", "<u8"), ("id", "<i8"), ("th", "<i8"), ("start", "<i8"), ("source", "<u8"), ("runs", "u1"), ("bit", "u1"), ("size", "<u2")])
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the GRAM bytes at each of the first n places."""
    words = np.ndarray((n + GRAM - 8,), "<u8", data.tobytes() + bytes(8), 0, (1,)).copy()
    found = words[:n] * MULTIPLIERS[0]
    for at in (8, 16, 24, GRAM - 8):
        found ^= found >> np.uint64(29)
        found *= MULTIPLIERS[1]
        found += words[at:at + n] * MULTIPLIERS[2]
    found ^= found >> np.uint64(32)
    found *= MULTIPLIERS[3]
    return found ^ (found >> np.uint64(29))


def _piece(data: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, runs, anchor) of the stretches among the starts that are allowed."""
    n = len(allowed)
    hashes = gram_hashes(data, n + SPAN - 1)
    low = np.uint64((1 << 22) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width < SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    at = (least[:n] & low).astype(np.int64)
    begins = allowed.copy()
    begins[1:] &= (at[1:] != at[:-1]) | ~allowed[:-1]
    ends = allowed.copy()
    ends[:-1] &= begins[1:] | ~allowed[1:]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) - first + 1, hashes[at[first]]


class Stretches:
    """The stretches of a block, and its distinct (anchor, hash) pairs in the order that codes come back in."""

    def __init__(self, row: dict) -> None:
        self.text = row["text"]
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.hashes = np.frombuffer(row["hashes"], "<i8")
        self.ids = np.array([np.iinfo(np.int64).min if i is None else i for i in row["ids"]], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        data = np.frombuffer(self.text, np.uint8)
        parts = []
        for a in range(0, max(0, len(data) - LENGTH + 1), PIECE):
            n = min(PIECE, len(data) - LENGTH + 1 - a)
            edge = np.zeros(n + 1, np.int32)
            # Starts with under LENGTH bytes left in their document are not allowed.
            barred = np.maximum(self.begins, self.ends - LENGTH + 1)
            edge += np.bincount(np.clip(barred - a, 0, n), minlength=n + 1).astype(np.int32) - np.bincount(np.clip(self.ends - a, 0, n), minlength=n + 1).astype(np.int32)
            start, runs, anchor = _piece(data[a:a + n + LENGTH - 1], np.cumsum(edge)[:n] == 0)
            parts.append((start + a, runs, anchor))
        self.start, self.runs, self.anchor = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, np.uint64)))
        view = memoryview(self.text)
        digest = xxhash.xxh3_64_intdigest
        self.fp = np.fromiter((digest(view[a:b]) for a, b in zip(self.start.tolist(), (self.start + self.runs + LENGTH - 1).tolist())), np.uint64, len(self.start))
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.own = self.start - self.begins[self.doc]
        # Occurrences by anchor and hash, equal ones in document order.
        by = np.lexsort((self.own, self.hashes[self.doc], self.ids[self.doc], self.fp, self.anchor))
        new = np.ones(len(by), bool)
        new[1:] = (self.fp[by][1:] != self.fp[by][:-1]) | (self.anchor[by][1:] != self.anchor[by][:-1])
        self.by, self.pair_of, first = by, np.cumsum(new) - 1, np.flatnonzero(new)
        self.first = by[first]
        self.copies = np.diff(np.append(first, len(by)))

    def order(self, occurrences: np.ndarray) -> np.ndarray:
        d = self.doc[occurrences]
        return np.stack([self.ids[d], self.hashes[d], self.own[occurrences]], axis=1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


BLOCKS = "ids array<long>, hashes binary, lengths binary, text binary"


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Writes (doc_id, text) as blocks, bucketed by `block`."""
    spark, out = docs.sparkSession, _arrow(BLOCKS)
    rows = docs.withColumn("th", F.xxhash64("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, texts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            made = [(ids, np.array(hashes, "<i8").tobytes(), np.array(list(map(len, texts)), "<i8").tobytes(), b"".join(texts))]
            return _batch(out, made)

        for batch in batches:
            for doc, text, th in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                if texts and size + len(text) > block_bytes:
                    yield block()
                    ids, hashes, texts, size = [], [], [], 0
                ids.append(doc)
                hashes.append(th)
                texts.append(text)
                size += len(text)
        if texts:
            yield block()

    # Spark deals a table with fewer buckets than shuffle partitions anew before a join.
    buckets = max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"blocks_{uuid.uuid4().hex}"
    made = rows.select("doc_id", "text", "th").mapInArrow(pack, BLOCKS).withColumn("block", F.monotonically_increasing_id())
    made.write.format("parquet").bucketBy(buckets, "block").option("path", f"{_shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def pairs_of(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, pairs): distinct (anchor, hash) of each block; the lowest bit of the hash tells that the block has it several times."""
    out = _arrow("bucket int, block long, pairs binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = Stretches(row)
            anchor, fp = s.anchor[s.first], (s.fp[s.first] & ~np.uint64(1)) | (s.copies > 1).astype(np.uint64)
            bucket = (anchor % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            found = [(b, row["block"], np.stack([anchor[by[c:d]], fp[by[c:d]]]).tobytes()) for b, (c, d) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if d > c]
            if found:
                yield _batch(out, found)

    return blocks.select("block", *[c.split()[0] for c in BLOCKS.split(", ")]).mapInArrow(run, "bucket int, block long, pairs binary")


def codes_of(pairs: DataFrame, hot: int) -> DataFrame:
    """(bucket, block, codes, copied, sent, dealt): a code per pair in the order sent, and counts of codes."""
    ddl = "bucket int, block long, codes binary, copied long, sent long, dealt long"
    out = _arrow(ddl)

    def judge(group: pa.Table) -> pa.Table:
        bucket, blocks = group.column("bucket")[0].as_py(), group.column("block").to_pylist()
        sent = [np.frombuffer(p, "<u8").reshape(2, -1) for p in group.column("pairs").to_pylist()]
        anchor, fp = np.concatenate(sent, axis=1)
        several, fp = fp & np.uint64(1), fp >> np.uint64(1)
        by = np.lexsort((fp, anchor))
        a, f = anchor[by], fp[by]
        new_a = np.ones(len(by), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_f = new_a.copy()
        new_f[1:] |= f[1:] != f[:-1]
        of = np.cumsum(new_a) - 1
        distinct, rows = np.bincount(of, new_f)[of], np.bincount(of, 1 + several[by])[of]
        code = np.full(len(by), COPIED, np.uint8)
        code[rows == 1] = ALONE
        code[(distinct > 1) & new_f] = SEND
        code[distinct > hot] = DEAL
        codes = np.empty(len(by), np.uint8)
        codes[by] = code
        made, at = [], 0
        for block, own in zip(blocks, sent):
            part = codes[at:at + own.shape[1]]
            at += own.shape[1]
            made.append((bucket, block, part.tobytes(), *(int((part == c).sum()) for c in (COPIED, SEND, DEAL))))
        return pa.Table.from_batches([_batch(out, made)])

    return pairs.groupBy("bucket").applyInArrow(judge, ddl)


def _records(row: dict, buckets1: int, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(bucket, block, records, bytes) that a block sends by the codes it got."""
    s = Stretches(row)
    anchor = s.anchor[s.first]
    codes = np.empty(len(s.first), np.uint8)
    codes[np.argsort(anchor % np.uint64(buckets1), kind="stable")] = np.frombuffer(b"".join(c["codes"] for c in sorted(row["answers"], key=lambda c: c["bucket"])), np.uint8)
    view, parts = memoryview(s.text), []

    def records(which: np.ndarray, fp, start, runs, source, bit, size) -> np.ndarray:
        made = np.zeros(len(which), RECORD)
        order = s.order(which)
        made["id"], made["th"], made["start"] = order[:, 0], order[:, 1], order[:, 2] + bit
        made["fp"], made["source"], made["runs"], made["bit"], made["size"] = fp, source, runs, bit, size
        parts.append((made, start))
        return made

    plain = np.flatnonzero((codes == COPIED) | (codes == SEND))
    which = s.first[plain]
    size = np.where(codes[plain] == SEND, s.runs[which] + LENGTH - 1, 0)
    records(which, s.fp[which], s.start[which], s.runs[which], s.fp[which], 0, size)
    bucket = [(anchor[plain] % np.uint64(buckets)).astype(np.int64)]
    dealt = np.repeat(s.first[codes == DEAL], s.runs[s.first[codes == DEAL]])
    if len(dealt):
        runs = s.runs[s.first[codes == DEAL]]
        bit = np.arange(len(dealt)) - np.repeat(np.cumsum(runs) - runs, runs)
        start = s.start[dealt] + bit
        fp = np.fromiter((xxhash.xxh3_64_intdigest(view[a:a + LENGTH]) for a in start.tolist()), np.uint64, len(start))
        records(dealt, fp, start, 1, s.fp[dealt], bit, LENGTH)
        bucket.append((fp % np.uint64(buckets)).astype(np.int64))
    made, start, bucket = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(bucket)
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
    for c, d in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = by[c:d]
        yield int(bucket[own[0]]), row["block"], made[own].tobytes(), b"".join(view[a:a + n] for a, n in zip(start[own].tolist(), made["size"][own].tolist()) if n)


def _joined(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with what came back to them. The blocks' buckets stay where they are; only the answers are shuffled."""
    return blocks.join(answers.hint("shuffle_hash"), "block", "left")


def stretches_sent(blocks: DataFrame, codes: DataFrame, buckets1: int, buckets: int) -> DataFrame:
    ddl = "bucket int, block long, records binary, bytes binary"
    out = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if row["answers"] and (made := list(_records(row, buckets1, buckets))):
                yield _batch(out, made)

    answers = codes.groupBy("block").agg(F.collect_list(F.struct("bucket", "codes")).alias("answers"))
    return _joined(blocks, answers).select("block", *[c.split()[0] for c in BLOCKS.split(", ")], "answers").mapInArrow(run, ddl)


def marks_of(sent: DataFrame) -> DataFrame:
    """(block, marks): (hash of the stretch, starts that go in the block's first occurrence of it), where there are any."""
    ddl = "block long, marks binary"
    out = _arrow(ddl)

    def judge(group: pa.Table) -> pa.Table:
        blocks = group.column("block").to_pylist()
        parts = [np.frombuffer(r, RECORD) for r in group.column("records").to_pylist()]
        data = [np.frombuffer(b, np.uint8) for b in group.column("bytes").to_pylist()]
        rows, text = np.concatenate(parts), np.concatenate(data)
        at = np.cumsum(rows["size"], dtype=np.int64) - rows["size"]
        by = np.lexsort((rows["start"], rows["th"], rows["id"], rows["fp"]))
        new = np.ones(len(by), bool)
        new[1:] = rows["fp"][by][1:] != rows["fp"][by][:-1]
        of = np.empty(len(by), np.int64)
        of[by] = np.cumsum(new) - 1
        earliest = rows[by[new]]
        # The bytes of a stretch lie with any one of its records.
        holder = np.full(len(earliest), -1)
        holder[of[rows["size"] > 0]] = np.flatnonzero(rows["size"] > 0)
        known = np.flatnonzero(holder >= 0)
        known = known[np.lexsort((earliest["start"][known], earliest["th"][known], earliest["id"][known]))]
        bits = np.zeros(len(earliest), np.uint64)
        if len(known):
            lengths = rows["size"][holder[known]].astype(np.int64)
            joined = np.concatenate([text[a:a + n] for a, n in zip(at[holder[known]].tolist(), lengths.tolist())])
            index = RunIndex(joined.tobytes(), lengths)
            runs = lengths - LENGTH + 1
            ahead = np.cumsum(runs) - runs
            places = np.arange(int(runs.sum())) - np.repeat(ahead, runs)
            positions = np.repeat(index.starts, runs) + places
            later = index.first_of_equals(positions, LENGTH) != np.arange(len(positions))
            bits[known] = np.bitwise_or.reduceat(np.where(later, np.uint64(1) << places.astype(np.uint64), np.uint64(0)), ahead)
        first = earliest[of]
        same = (rows["id"] == first["id"]) & (rows["th"] == first["th"]) & (rows["start"] == first["start"])
        every = np.where(rows["runs"] >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(rows["runs"], 63).astype(np.uint64)) - np.uint64(1))
        mark = np.where(same, bits[of], every) << rows["bit"].astype(np.uint64)
        made, begin = [], 0
        for block, part in zip(blocks, parts):
            own = mark[begin:begin + len(part)]
            begin += len(part)
            if own.any():
                made.append((block, np.stack([part["source"][own != 0], own[own != 0]]).tobytes()))
        return pa.Table.from_batches([_batch(out, made)])

    return sent.groupBy("bucket").applyInArrow(judge, ddl)


def _covered(s: Stretches, marks: np.ndarray) -> np.ndarray:
    """Which bytes of a block go."""
    edge = np.zeros(len(s.text) + 1, np.int32)
    if len(s.by):
        by = np.argsort(marks[0], kind="stable")
        fps, first = np.unique(marks[0][by], return_index=True)
        bits = np.bitwise_or.reduceat(marks[1][by], first) if len(fps) else np.empty(0, np.uint64)
        at = np.searchsorted(fps, s.fp[s.first])
        hit = np.zeros(len(s.first), bool)
        hit[at < len(fps)] = fps[at[at < len(fps)]] == s.fp[s.first][at < len(fps)]
        own = np.zeros(len(s.first), np.uint64)
        own[hit] = bits[at[hit]]
        # Occurrences behind a block's first one go as a whole, but for those of a repeated row.
        first_order = s.order(s.first)[s.pair_of]
        later = np.any(s.order(s.by) != first_order, axis=1)
        np.add.at(edge, s.start[s.by][later], 1)
        np.add.at(edge, s.start[s.by][later] + s.runs[s.by][later] + LENGTH - 1, -1)
        some = np.flatnonzero(~later & (own[s.pair_of] != 0))
        places, which = np.nonzero(((own[s.pair_of[some]][None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(bool))
        starts = s.start[s.by[some[which]]] + places
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def kept_parts(blocks: DataFrame, marks: DataFrame, kind: str) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: removed runs as (first, past) bytes, and the bytes that stay."""
    ddl = f"doc_id {kind}, n_bytes long, spans array<struct<first:long,past:long>>, kept binary"
    out = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = Stretches(row)
            found = [np.frombuffer(m, "<u8").reshape(2, -1) for m in row["answers"] or ()]
            gone = _covered(s, np.concatenate(found, axis=1) if found else np.empty((2, 0), np.uint64))
            data, made, size = np.frombuffer(s.text, np.uint8), [], 0
            for doc, a, b in zip(row["ids"], s.begins.tolist(), s.ends.tolist()):
                own = gone[a:b]
                cuts = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist() if own.any() else []
                made.append((doc, b - a, [{"first": c, "past": d} for c, d in cuts], data[a:b][~own].tobytes() if cuts else bytes(memoryview(s.text)[a:b])))
                size += len(made[-1][-1])
                if size > 8 << 20:
                    yield _batch(out, made)
                    made, size = [], 0
            if made:
                yield _batch(out, made)

    answers = marks.groupBy("block").agg(F.collect_list("marks").alias("answers"))
    return _joined(blocks, answers).select("block", *[c.split()[0] for c in BLOCKS.split(", ")], "answers").mapInArrow(run, ddl)


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int | None = None) -> DataFrame:
    """(key, n_bytes, spans, kept) of every row."""
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    blocks = blocks_of(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), whole_text(f"`{text}`").alias("text")), block_bytes or BLOCK_BYTES)
    total = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets1 = 1 + total // (BUCKET_PAIRS * SPAN // 2)
    codes = checkpoint(codes_of(pairs_of(blocks, buckets1), HOT))
    copied, sent, dealt = (n or 0 for n in codes.agg(F.sum("copied"), F.sum("sent"), F.sum("dealt")).first())
    buckets = 1 + (RECORD.itemsize * (copied + sent) + (LENGTH + SPAN // 2) * sent + (LENGTH + RECORD.itemsize) * SPAN // 2 * dealt) // BUCKET_BYTES
    marks = checkpoint(marks_of(stretches_sent(blocks, codes, buckets1, buckets)))
    return kept_parts(blocks, marks, kind).withColumnRenamed("doc_id", key)


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of every document."""
    rows = dedup_substrings(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
