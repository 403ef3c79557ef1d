"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus' frequent words are compiled, with their ids as outputs, into an automaton that shares prefixes and suffixes. Each
state knows how many words it accepts, so the sum of the counts skipped on the way is a word's number, and numbers index one
flat array of ids. The automaton is a handful of arrays in one file of the shared folder, memory-mapped by the workers.
Words it does not hold are merged by rank, each once, with the merge table of the tokenizer file.

Defined cases: null text counts as empty (no ids, empty decoded text); null and repeated doc_ids keep their rows; an empty
table gives an empty lexicon and an empty result; extra columns are ignored; words over WORD_BYTES are never compiled."""

from __future__ import annotations

import functools
import hashlib
import io
import json
import mmap
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import _shared_folder
from .arrow_files import _open
from .common import map_batches, prepare, whole_text
from .tokens import DEFAULT_FILE, WordEncoder, as_uint32, tokenizer_path

#: The lexicon's bounds: words, and bytes of a word.
LEXICON_WORDS, WORD_BYTES = 20_000, 48
_ARRAYS = ("first", "labels", "targets", "skips", "final", "counts", "offsets", "ids")


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of distinct words in byte order. A state that no longer changes is replaced by an equal one
    if there is one. The arrays: edges of state s are first[s] .. first[s + 1], each with its byte, its target, and the words
    that sort before those behind it."""
    edges: list[list[tuple[int, int]]] = [[]]
    final, register, path, free = [False], {}, [0], []
    previous = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            twin = register.setdefault((final[state], tuple(edges[state])), state)
            if twin != state:
                label = edges[path[-1]][-1][0]
                edges[path[-1]][-1] = (label, twin)
                free.append(state)

    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(previous, word)) if a != b), min(len(previous), len(word)))
        settle(common)
        for byte in word[common:]:
            if free:
                state = free.pop()
                edges[state], final[state] = [], False
            else:
                state = len(edges)
                edges.append([])
                final.append(False)
            edges[path[-1]].append((byte, state))
            path.append(state)
        final[path[-1]] = True
        previous = word
    settle(0)

    number, order, stack = {}, [], [(0, False)]
    while stack:  # targets before their sources, for the counts
        state, left = stack.pop()
        if left:
            number[state] = len(order)
            order.append(state)
        elif state not in number:
            number[state] = -1
            stack.append((state, True))
            stack.extend((target, False) for _, target in edges[state] if target not in number)
    order.reverse()  # the start comes first
    number = {state: i for i, state in enumerate(order)}
    counts = np.zeros(len(order), np.int64)
    for i in range(len(order) - 1, -1, -1):
        counts[i] = final[order[i]] + sum(counts[number[t]] for _, t in edges[order[i]])
    first, labels, targets, skips = [0], [], [], []
    for state in order:
        before = int(final[state])
        for label, target in edges[state]:
            labels.append(label)
            targets.append(number[target])
            skips.append(before)
            before += int(counts[number[target]])
        first.append(len(labels))
    return {"first": np.array(first, np.int32), "labels": np.array(labels, np.uint8), "targets": np.array(targets, np.int32), "skips": np.array(skips, np.int32),
            "final": np.array([final[s] for s in order], np.uint8), "counts": counts.astype(np.int32)}


class Lexicon:
    """Words with ids, over arrays that may lie in a mapped file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        n = len(arrays["first"]) - 1
        source = np.repeat(np.arange(n, dtype=np.int64), np.diff(arrays["first"]))
        self.edge_keys = (source << 8) | arrays["labels"]  # sorted: states ascend, labels ascend inside a state

    @classmethod
    def compile(cls, ids_of: dict[bytes, list[int]]) -> Lexicon:
        words = sorted(ids_of)
        outputs = [ids_of[w] for w in words]
        arrays = build_automaton(words)
        arrays["offsets"] = np.cumsum([0, *map(len, outputs)]).astype(np.int32)
        arrays["ids"] = np.array([i for ids in outputs for i in ids], np.uint32)
        return cls(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in byte order, -1 for words that are not held: all words take each step together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.edge_keys):
            return out
        blob, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        alive = np.flatnonzero((lengths > 0) & (lengths <= WORD_BYTES))
        state, skipped = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64)
        for step in range(WORD_BYTES + 1):
            ended = lengths[alive] == step
            good = ended & (self.a["final"][state] == 1)
            out[alive[good]] = skipped[good]
            alive, state, skipped = alive[~ended], state[~ended], skipped[~ended]
            if not len(alive):
                break
            wanted = (state << 8) | blob[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.edge_keys, wanted), len(self.edge_keys) - 1)
            found = self.edge_keys[at] == wanted
            at = at[found]
            alive, state, skipped = alive[found], self.a["targets"][at].astype(np.int64), skipped[found] + self.a["skips"][at]
        return out

    def ids(self, number: int) -> np.ndarray:
        return self.a["ids"][self.a["offsets"][number]:self.a["offsets"][number + 1]]

    def save(self, folder: str, name: str) -> None:
        head, body = {}, io.BytesIO()
        for key in _ARRAYS:
            data = np.ascontiguousarray(self.a[key])
            body.write(b"\0" * (-body.tell() % 8))
            head[key] = (body.tell(), str(data.dtype), len(data))
            body.write(data.tobytes())
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(len(text).to_bytes(8, "little") + text + body.getvalue())

    @classmethod
    def open(cls, folder: str, name: str) -> Lexicon:
        """Mapped where the folder is a local or mounted path; read once otherwise."""
        fs, root = _open(folder)
        if isinstance(fs, pa.fs.LocalFileSystem):
            with open(f"{root}/{name}", "rb") as file:
                data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with fs.open_input_file(f"{root}/{name}") as file:
                data = file.read()
        size = int.from_bytes(data[:8], "little")
        head = json.loads(bytes(data[8:8 + size]))
        return cls({k: np.frombuffer(data, t, n, 8 + size + at) if n else np.zeros(0, t) for k, (at, t, n) in head.items()})


class Codec:
    """Encodes and decodes whole texts. Words seen lately stay at hand, in two generations of at most `limit`."""

    def __init__(self, lexicon: Lexicon, path: str, limit: int = 250_000):
        self.lexicon, self.merger, self.limit, self.known, self.older = lexicon, WordEncoder(path, as_uint32, limit), limit, {}, {}
        tokenizer = self.merger.tokenizer
        self.decimals = [str(i) for i in range(tokenizer.get_vocab_size())]
        self.tokens = None if tokenizer.decoder is not None else [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]

    def encode_batch(self, texts: list[bytes], at_once: int = 128) -> list[np.ndarray]:
        """Ids of every text; so many texts at a time stand as lists of words in memory. A tokenizer that joins across white space
        gets whole texts, which the automaton of words cannot serve."""
        if not self.merger.by_word:
            return [np.array(self.merger.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4") for t in texts]
        return [ids for at in range(0, len(texts), at_once) for ids in self._encode(texts[at:at + at_once])]

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        self.merger.trim()
        split = [t.split() for t in texts]
        new = list(set().union(*split) - self.known.keys())
        met = [w for w in new if w not in self.older]
        self.known.update((w, self.older[w]) for w in new if w in self.older)
        for word, number in zip(met, self.lexicon.numbers(met).tolist()):
            # The automaton's output, or the word's own merges by rank.
            self.known[word] = self.lexicon.ids(number).tobytes() if number >= 0 else as_uint32(self.merger.encode_word(word))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode with special tokens kept; without a decoder it joins the tokens with spaces."""
        if self.tokens is None:
            return self.merger.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))

    def decimal(self, ids: np.ndarray) -> str:
        """The ids in decimal, joined by one space."""
        return " ".join(map(self.decimals.__getitem__, ids.tolist()))


def frequent_words(docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> list[bytes]:
    """The corpus' most frequent words, counted over all documents; counts are combined in the tasks before the shuffle."""
    rows = docs.select(whole_text(text).alias("text"))

    def count(batches):
        from collections import Counter
        seen: Counter = Counter()
        for batch in batches:
            for data in batch["text"]:
                seen.update(data.split())
            if len(seen) > 150_000:
                yield {"word": list(seen), "n": list(seen.values())}
                seen = Counter()
        yield {"word": list(seen), "n": list(seen.values())}

    counts = map_batches(rows, count, "word binary, n long", binary=["text"]).filter(f"octet_length(word) <= {WORD_BYTES}").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counts.filter("n > 1").orderBy(F.desc("n"), "word").limit(words).collect()]


def build_lexicon(docs: DataFrame, tokenizer: str = DEFAULT_FILE, text: str = "text", words: int = LEXICON_WORDS) -> tuple[str, str]:
    """Compiles the lexicon into a file of the shared folder: (folder, name). At most `words` words reach the driver."""
    merger = WordEncoder(tokenizer_path(tokenizer), as_uint32)
    lexicon = Lexicon.compile({w: merger.encode_word(w) for w in frequent_words(docs, text, words)})
    folder, name = _shared_folder(docs.sparkSession), f"lexicon-{uuid.uuid4().hex}.bin"
    lexicon.save(folder, name)
    return folder, name


@functools.lru_cache(maxsize=2)
def _codec(folder: str, name: str, path: str) -> Codec:
    return Codec(Lexicon.open(folder, name), path)


def encode(docs: DataFrame, lexicon: tuple[str, str], tokenizer: str = DEFAULT_FILE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row."""
    path, kind = tokenizer_path(tokenizer), docs.schema[key].dataType.simpleString()

    def run(batches):
        codec = _codec(*lexicon, path)
        for batch in batches:
            yield {"key": batch["key"], "ids": codec.encode_batch(batch["text"])}

    return map_batches(docs.select(F.col(key).alias("key"), whole_text(text).alias("text")), run, f"key {kind}, ids array<int>", binary=["text"]).withColumnRenamed("key", key)


def decode(rows: DataFrame, lexicon: tuple[str, str], tokenizer: str = DEFAULT_FILE, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row with an array of ids."""
    path, kind = tokenizer_path(tokenizer), rows.schema[key].dataType.simpleString()

    def run(batches):
        codec = _codec(*lexicon, path)
        for batch in batches:
            yield {"key": batch["key"], "text": [codec.decode(np.asarray(i or [], np.uint32)) for i in batch["ids"]]}

    return map_batches(rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")), run, f"key {kind}, text string").withColumnRenamed("key", key)


def digests(docs: DataFrame, tokenizer: str = DEFAULT_FILE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every document in one pass: (key, n_tokens, ids_sha256, decoded_sha256)."""
    prepare(docs.sparkSession)
    lexicon, path, kind = build_lexicon(docs, tokenizer, text), tokenizer_path(tokenizer), docs.schema[key].dataType.simpleString()

    def run(batches):
        codec = _codec(*lexicon, path)
        for batch in batches:
            out = {"key": batch["key"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids in codec.encode_batch(batch["text"]):
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(codec.decimal(ids).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield out

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return map_batches(rows, run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", binary=["text"]).withColumnRenamed("key", key)
