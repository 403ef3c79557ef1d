"""Line dedup by winnowing over line hashes.

A document is its sequence of lines with words. A run of lines counts as repeated if it has `min_words` words or more and the
same run begins earlier, in the order of (doc_id, line). All lines of a later run go, with wordless lines inside it; the first
occurrence stays.

1. Winnowing: every shortest run of `min_words` words, forward from each line and backward to each line, is a window; its
   line of least hash is its fingerprint. What a window selects depends on its own lines only, so equal runs select equal
   fingerprints wherever they stand: no repeated run can be missed.
2. Positions are joined by fingerprint: those whose line is a fingerprint only once in the corpus end here.
3. A match is extended both ways from a joined position through the windows that selected it, before and after it; a window's
   lines are compared whole, by a 128-bit hash. The earliest occurrence is a minimum per window, not a pair of occurrences, so
   a line that a third of all documents share costs one row per occurrence. Forward and backward windows together cover
   every repeated run to both its ends.

Defined cases: null text counts as empty; an empty text is one line and stays; rows that share doc_id and text are one document
and get the same result; rows that share only doc_id are ordered by a hash of the text; a null doc_id sorts first; runs
repeated inside one document are treated like those across documents; other columns are kept as they are."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import map_batches, prepare, whole_text

MIN_WORDS = 50


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Shortest runs (first, last) of at least `min_words` words, forward from and backward to each line, once each."""
    found, total, last = [], 0, -1
    for first in range(len(words)):
        while total < min_words and last + 1 < len(words):
            last += 1
            total += words[last]
        if total < min_words:
            break
        found.append((first, last))
        total -= words[first]
    back, total, first = [], 0, len(words)
    for last in range(len(words) - 1, -1, -1):
        while total < min_words and first > 0:
            first -= 1
            total += words[first]
        if total < min_words:
            break
        back.append((first, last))
        total -= words[last]
    return sorted({*found, *back})


def _least(digests: list[bytes], first: int, last: int) -> int:
    """Position of the window's fingerprint: the least hash, the first of equals."""
    return min(range(first, last + 1), key=digests.__getitem__)


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, hashes, words, numbers) for lines with words: 16-byte hashes, word counts and line numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def split(batches):
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "th": batch["th"], "hashes": [], "words": [], "numbers": []}
            for data in batch["text"]:
                lines = [(i, line, n) for i, line in enumerate(data.split(b"\n")) if (n := len(line.split()))]
                out["hashes"].append(b"".join(xxhash.xxh3_128_digest(line) for _, line, _ in lines))
                out["words"].append(np.array([n for _, _, n in lines], "<i4").tobytes())
                out["numbers"].append(np.array([i for i, _, _ in lines], "<i4").tobytes())
            yield out

    return map_batches(docs, split, f"doc_id {kind}, th long, hashes binary, words binary, numbers binary", binary=["text"])


def _digests(hashes: bytes) -> list[bytes]:
    return [hashes[i:i + 16] for i in range(0, len(hashes), 16)]


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """(fp, doc_id, th, at): the selected line positions of each document."""
    kind = lines.schema["doc_id"].dataType.simpleString()

    def select(batches):
        for batch in batches:
            out = {"fp": [], "doc_id": [], "th": [], "at": []}
            for doc, th, hashes, words in zip(batch["doc_id"], batch["th"], batch["hashes"], batch["words"]):
                digests = _digests(hashes)
                for at in sorted({_least(digests, a, b) for a, b in windows(np.frombuffer(words, "<i4").tolist(), min_words)}):
                    for name, value in zip(out, (digests[at], doc, th, at)):
                        out[name].append(value)
            yield out

    return map_batches(lines.select("doc_id", "th", "hashes", "words"), select, f"fp binary, doc_id {kind}, th long, at int")


def extended(rows: DataFrame, min_words: int) -> DataFrame:
    """(window, doc_id, th, first, last): the windows that selected a joined position, as line numbers, with their content hash."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def extend(batches):
        for batch in batches:
            out = {"window": [], "doc_id": [], "th": [], "first": [], "last": []}
            for doc, th, hashes, words, numbers, joined in zip(*(batch[n] for n in ("doc_id", "th", "hashes", "words", "numbers", "joined"))):
                digests, numbers, joined = _digests(hashes), np.frombuffer(numbers, "<i4").tolist(), set(joined)
                for a, b in windows(np.frombuffer(words, "<i4").tolist(), min_words):
                    if _least(digests, a, b) in joined:
                        for name, value in zip(out, (xxhash.xxh3_128_digest(hashes[16 * a:16 * (b + 1)]), doc, th, numbers[a], numbers[b])):
                            out[name].append(value)
            yield out

    return map_batches(rows, extend, f"window binary, doc_id {kind}, th long, first int, last int")


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, gone): numbers of the lines to delete, for documents that have any. Takes doc_id, th and text."""
    lines = checkpoint(line_table(docs))
    marks = checkpoint(fingerprints(lines, min_words))
    repeated = checkpoint(marks.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"))
    joined = marks.join(repeated, "fp").groupBy("doc_id", "th").agg(F.collect_set("at").alias("joined")).withColumnsRenamed({"doc_id": "d", "th": "t"})
    rows = lines.dropDuplicates(["doc_id", "th"]).join(joined, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).drop("d", "t")
    runs = checkpoint(extended(rows, min_words))
    at = F.struct("doc_id", "th", "first")
    earliest = checkpoint(runs.groupBy("window").agg(F.min(at).alias("earliest"), F.count("*").alias("n")).filter("n > 1").select("window", "earliest"))
    later = runs.join(earliest, "window").filter(~at.eqNullSafe(F.col("earliest")))
    return later.groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, n_lines, n_deleted, clean): the input row as a struct, so that no column can clash, and its text without later
    repeated runs."""
    prepare(docs.sparkSession)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = source.select("row", F.col(f"row.`{key}`").alias("doc_id"), whole_text(f"row.`{text}`").alias("text")).withColumn("th", F.xxhash64("text"))
    gone = checkpoint(repeated_lines(own.select("doc_id", "th", "text"), min_words)).withColumnsRenamed({"doc_id": "d", "th": "t"})
    # The deletions grow with the corpus, so this join shuffles at every size; it never turns into a broadcast.
    joined = own.join(gone.hint("merge"), own["doc_id"].eqNullSafe(gone["d"]) & (own["th"] == gone["t"]), "left")
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.element_at(lines, i + 1)), "\n")
    return joined.select("row", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
                         F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("clean"))


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, n_lines, n_deleted, text) of every row."""
    return dedup_lines(docs, key, text, min_words).select(F.col(f"row.`{key}`").alias(key), "n_lines", "n_deleted", F.col("clean").alias(text))


SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents),
    n AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
    k AS (SELECT *, row_number() OVER o AS k, sum(w) OVER o AS c FROM n WHERE w > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
    forward AS (SELECT a.doc_id, a.k AS i, min(b.k) AS j FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.k >= a.k AND b.k < a.k + 50 AND b.c - a.c + a.w >= 50 GROUP BY ALL),
    backward AS (SELECT b.doc_id, max(a.k) AS i, b.k AS j FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.k >= a.k AND b.k < a.k + 50 AND b.c - a.c + a.w >= 50 GROUP BY b.doc_id, b.k),
    win AS (FROM forward UNION FROM backward),
    content AS (SELECT win.doc_id, i, j, min(no) AS first, max(no) AS last, string_agg(line, chr(10) ORDER BY k.k) AS t FROM win JOIN k ON k.doc_id = win.doc_id AND k.k BETWEEN i AND j GROUP BY ALL),
    later AS (SELECT doc_id, first, last FROM content QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, first) > 1),
    gone AS (SELECT DISTINCT n.doc_id, n.no FROM n JOIN later ON later.doc_id = n.doc_id AND n.no BETWEEN first AND last)
    SELECT n.doc_id, count(*) AS n_lines, count(gone.no) AS n_deleted, coalesce(string_agg(n.line, chr(10) ORDER BY n.no) FILTER (WHERE gone.no IS NULL), '') AS text
    FROM n LEFT JOIN gone ON gone.doc_id = n.doc_id AND gone.no = n.no GROUP BY n.doc_id"""
