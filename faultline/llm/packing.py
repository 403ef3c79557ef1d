"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

Each document's ids (with the end id) are cut into full sequences and one remainder. Only the histogram of lengths, at most
`size` numbers, meets in one place: lengths are placed longest first, always onto the shortest pack so far, as counts of
packing patterns. Each pattern slot then owns a range of ranks of its length; pieces find their sequence and offset by their
rank. Ranks are row numbers inside bounded (length, bucket) groups plus the counts of the buckets before, so a length shared
by a third of all documents is spread over many tasks.

Defined cases: null text is the end id alone; null and repeated doc_ids keep their rows; repeated rows are packed once each;
an empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

import heapq
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import map_batches, prepare, whole_text
from .tokens import DEFAULT_FILE, END_ID, crc, id_bytes, tokenizer_path, worker_encoder

SEQUENCE = 2048
#: Rows that one (length, bucket) group is planned for.
BUCKET_ROWS = 20_000


def pieces_of(docs: DataFrame, size: int = SEQUENCE, tokenizer: str = DEFAULT_FILE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every id of every document in exactly one piece of at most `size`."""
    prepare(docs.sparkSession)
    path, kind = tokenizer_path(tokenizer), docs.schema[key].dataType.simpleString()

    def cut(batches):
        cache = worker_encoder(path)
        for batch in batches:
            out = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            for doc, data in zip(batch["doc_id"], batch["text"]):
                ids = id_bytes(cache, data, END_ID)
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start:4 * (start + size)]
                    for name, value in zip(out, (doc, start, len(piece) // 4, crc(piece), total)):
                        out[name].append(value)
            yield out

    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("text"))
    return map_batches(rows, cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long", binary=["text"])


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths) that hold every counted length exactly once, none over `size`. Lengths go longest first;
    each goes to the shortest pack, and if that has no room no pack has, so a new one opens. A pack kind is only split
    when a length runs out, so kinds stay within twice the number of lengths."""
    open_packs: list[tuple[int, int, tuple[int, ...], int]] = []
    serial = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if open_packs and open_packs[0][0] + length <= size:
                used, _, pattern, count = heapq.heappop(open_packs)
            else:
                used, pattern, count = 0, (), left
            placed = min(count, left)
            serial += 1
            heapq.heappush(open_packs, (used + length, serial, (*pattern, length), placed))
            if count > placed:
                serial += 1
                heapq.heappush(open_packs, (used, serial, pattern, count - placed))
            left -= placed
    return [(count, pattern) for _, _, pattern, count in sorted(open_packs)]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """Per length: first ranks of its slots, the sequence of each first rank, and the offset inside the sequence."""
    found: dict[int, tuple[list[int], list[int], list[int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            first, sequence, offsets = found.setdefault(length, ([], [], []))
            first.append(ranks.get(length, 0))
            sequence.append(base)
            offsets.append(offset)
            ranks[length] = ranks.get(length, 0) + count
            offset += length
        base += count
    return found


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds `rank`, from 0 without gaps inside each length. Written as a table before it is used, so a lost executor cannot
    rank anew what others have read."""
    counted = pieces.count()
    buckets = max(1, -(-counted // BUCKET_ROWS))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    rows = checkpoint(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets))).withColumn("place", F.row_number().over(inside) - 1))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    return rows.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place")).drop("bucket", "before", "place")


def pack(docs: DataFrame, size: int = SEQUENCE, tokenizer: str = DEFAULT_FILE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its sequence_id and the offset there, gapless from 0."""
    pieces = checkpoint(pieces_of(docs, size, tokenizer, key, text))
    histogram = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(shortest_pack_first(histogram, size))
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch["length"], batch["rank"]):
                first, base, offsets = places[length]
                slot = bisect_right(first, rank) - 1
                sequence.append(base[slot] + rank - first[slot])
                offset.append(offsets[slot])
            del batch["rank"]
            yield batch | {"sequence_id": sequence, "offset": offset}

    rows = ranked(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return map_batches(rows, place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("doc_id", key)


def padding(packed: DataFrame, size: int = SEQUENCE) -> float:
    """Share of padding when sequences are padded to `size`, except those whose length is a power of two."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    padded = F.when(F.col("used").bitwiseAND(F.col("used") - 1) == 0, F.col("used")).otherwise(F.lit(size))
    row = used.agg(F.sum("used").alias("used"), F.sum(padded).alias("padded")).first()
    return 0.0 if not row["padded"] else 1 - row["used"] / row["padded"]
