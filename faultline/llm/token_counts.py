"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table with the token counts of the corpus' frequent words, broadcast to the workers. Its words
come from frequent-item sketches, one per task, merged in two steps: no word is shuffled. Tier two is each worker's cache,
which encodes a miss once. The table only saves work; every count is the library's own.

Defined cases: null text counts as empty (0 bytes, 0 tokens); a null or repeated doc_id keeps its row; extra columns are
ignored; an empty table gives an empty result; words longer than WORD_BYTES never enter the table."""

from __future__ import annotations

import functools

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, prepare, whole_text
from .tokens import DEFAULT_FILE, WordEncoder, by_word, load, tokenizer_path

#: Bounds of the broadcast table: so many words of so many bytes at most, hence below 1 MB.
TABLE_WORDS, WORD_BYTES = 8192, 64
#: Items that a task's sketch follows, and the groups that merge sketches before the last merge.
TRACKED, MERGE_GROUPS = 32_768, 64


class LengthTable:
    """Open addressing over one byte string of words; a probe compares the whole word, so a hash collision cannot lie."""

    def __init__(self, words: list[bytes], lengths: list[int]):
        self.blob = b"".join(words)
        self.ends = np.cumsum([0, *map(len, words)]).astype(np.uint32)
        self.lengths = np.asarray(lengths, np.uint32)
        self.mask = (1 << max(1, (2 * len(words)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        for i, word in enumerate(words):
            at = xxhash.xxh3_64_intdigest(word) & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = i

    def get(self, word: bytes) -> int:
        """The word's token count, or -1."""
        at = xxhash.xxh3_64_intdigest(word) & self.mask
        while (i := self.slots[at]) >= 0:
            if self.blob[self.ends[i]:self.ends[i + 1]] == word:
                return int(self.lengths[i])
            at = (at + 1) & self.mask
        return -1


def frequent_words(docs: DataFrame, text: str = "text", words: int = TABLE_WORDS) -> list[bytes]:
    """The words that the merged sketches report as most frequent, over all documents; at most `words`, sorted."""
    tokens = docs.select(F.explode(F.split(whole_text(text), r"[\x20\x09-\x0D]+")).alias("word")).filter(f"word <> '' and octet_length(word) <= {WORD_BYTES}")
    by_task = tokens.groupBy((F.spark_partition_id() % MERGE_GROUPS).alias("part")).agg(F.expr(f"approx_top_k_accumulate(word, {TRACKED})").alias("sketch"))
    # Grouped by a constant, as a task without rows must not send an empty sketch to the merge.
    merged = by_task.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {words})").alias("top"))
    row = merged.first()
    return sorted(item["item"].encode() for item in row["top"]) if row and row["top"] else []


class WordCounts(WordEncoder):
    """word -> token count: the broadcast table first, then this worker's own encoding."""

    tier_one: LengthTable

    def __init__(self, path: str):
        super().__init__(path, len)

    def encode_word(self, word: bytes):
        known = self.tier_one.get(word)
        return range(known) if known >= 0 else super().encode_word(word)


@functools.lru_cache(maxsize=2)
def _worker_counts(path: str) -> WordCounts:
    return WordCounts(path)


def _whole_text_counter(path: str):
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text.decode(), num_threads=1))
    tokenizer = load(path)
    return lambda text: len(tokenizer.encode(text.decode(), add_special_tokens=False).ids)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_FILE, limit: int = 2048) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row. A tokenizer that joins across white space is run on whole texts."""
    prepare(docs.sparkSession)
    path = tokenizer_path(tokenizer)
    kind = docs.schema[key].dataType.simpleString()
    exact_words = by_word(path)
    table = None
    if exact_words:
        encoder = WordEncoder(path, len)
        found = frequent_words(docs, text)
        table = docs.sparkSession.sparkContext.broadcast(LengthTable(found, [len(encoder.encode_word(w)) for w in found]))

    def count(batches):
        if exact_words:
            cache = _worker_counts(path)
            cache.tier_one = table.value

            def tokens_of(data: bytes) -> int:
                cache.trim()
                return sum(map(cache.__getitem__, data.split()))
        else:
            tokens_of = _whole_text_counter(path)
        for batch in batches:
            n = [tokens_of(data) for data in batch["text"]]
            yield {"key": batch["key"], "n_bytes": [len(data) for data in batch["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return map_batches(rows, count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean", binary=["text"]).withColumnRenamed("key", key)
