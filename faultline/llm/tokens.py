"""Exact encoding by word with worker caches.

Where no pre-token of a tokenizer spans ASCII white space (`by_word`), and neither normalisation nor merging looks past
it, a text's ids are those of its words in order; other tokenizers encode whole texts. A word is a run without ASCII white space; each is encoded once per
worker and cache life."""

from __future__ import annotations

import codecs
import functools
import operator
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_FILE = "word_bpe_49k.json"
END_ID = 1
#: Letters that lower-casing, composition and the splitter treat alike everywhere, then marks that form one pre-token.
_SIMPLE = re.compile(r"([a-zß-öø-ÿ]+)([.,!?;:#$%&*|]*)")
_MARKS = b".,!?;:#$%&*|"
_SIMPLE_CHARACTERS = re.compile(r"[a-zß-öø-ÿ.,!?;:#$%&*|]+")

_token_id = operator.attrgetter("id")


def tokenizer_path(name_or_path: str = DEFAULT_FILE) -> str:
    """A path as it is; a bare file name is looked up among the public tokenizer files."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers
    return public_tokenizers.path(name_or_path)


@functools.lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer, without truncation and padding; one thread, as tasks are the parallel unit."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_symbols() -> dict[int, str]:
    """The byte-level alphabet as a translation: printable Latin-1 stays, other bytes take the code points from 256 on."""
    stays = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in stays)}


def by_word(path: str) -> bool:
    """Whether this tokenizer's ids are those of its words in turn: white space is dropped and nothing joins across it."""
    if path.endswith(".model"):
        return False
    tokenizer = load(path)
    if tokenizer.pre_tokenizer is None or tokenizer.post_processor is not None:
        return False
    if any(len(t.content.split()) != 1 for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    probe = "a b\n c"
    seen = tokenizer.normalizer.normalize_str(probe) if tokenizer.normalizer else probe
    return [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(seen)] == ["a", "b", "c"]


class WordEncoder(dict):
    """word (UTF-8 bytes) -> `make`(ids). Call `trim` between documents: two generations of at most `limit` words stay, so
    that words in use survive and memory is bounded whatever the corpus."""

    def __init__(self, path: str, make: Callable[[list[int]], object], limit: int = 500_000):
        super().__init__()
        self.tokenizer, self.make, self.limit, self.by_word = load(path), make, limit, by_word(path)
        self.older: dict[bytes, object] = {}
        self.parts: dict[str | bytes, object] = {}
        symbols, self.model = byte_symbols(), self.tokenizer.model
        self.alphabet = "".join(symbols.get(b, chr(b)) for b in range(256))
        self.fast = self._is_word_bpe()

    def _is_word_bpe(self) -> bool:
        """Whether a lower-cased Latin word and the marks after it are separate byte-level pre-tokens here."""
        t = self.tokenizer
        if any(_SIMPLE_CHARACTERS.fullmatch(a.content.lower()) for a in t.get_added_tokens_decoder().values()):
            return False
        if t.normalizer is None or t.pre_tokenizer is None or t.post_processor is not None or t.normalizer.normalize_str("AÉ") != "aé":
            return False
        split = [p for p, _ in t.pre_tokenizer.pre_tokenize_str("ab.,#")] == ["ab", ".,#"]
        return split and self._merged("éüñ") == t.encode("éüñ", add_special_tokens=False).ids

    def _tokens(self, text: str) -> list:
        """The model's tokens of one pre-token."""
        return self.model.tokenize(text if text.isascii() else codecs.charmap_decode(text.encode(), "strict", self.alphabet)[0])

    def _merged(self, text: str) -> list[int]:
        return list(map(_token_id, self._tokens(text)))

    def _part(self, text: str) -> list[int]:
        ids = self.parts.get(text)
        if ids is None:
            ids = self.parts[text] = self._merged(text)
        return ids

    def encode_word(self, word: bytes) -> list[int]:
        if self.fast and word.isascii():
            stem = word.rstrip(_MARKS)
            if stem.isalpha():
                ids = self._part(stem.lower().decode())
                return ids + self._part(word[len(stem):].decode()) if len(stem) < len(word) else ids
        text = word.decode()
        simple = _SIMPLE.fullmatch(text.lower()) if self.fast else None
        if simple is None:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self._part(simple[1]) + self._part(simple[2]) if simple[2] else self._part(simple[1])

    def __missing__(self, word: bytes):
        value = self.older.get(word)
        if value is None:
            value = self.make(self.encode_word(word))
        self[word] = value
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        if len(self.parts) > self.limit:
            self.parts.clear()


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def as_uint32(ids: list[int]) -> bytes:
    n = len(ids)
    return _PACKERS[n](*ids) if n < len(_PACKERS) else struct.pack(f"<{n}I", *ids)


class PackedWords(WordEncoder):
    """word -> little-endian ids. Ids of a word's parts are kept packed, so an unseen word of known parts is put together from bytes."""

    def __init__(self, path: str):
        super().__init__(path, as_uint32)

    def _packed(self, part: str | bytes) -> bytes:
        found = self.parts.get(part)
        if found is None:
            tokens = self._tokens(part if isinstance(part, str) else part.decode())
            found = self.parts[part] = _PACKERS[n](*map(_token_id, tokens)) if (n := len(tokens)) < len(_PACKERS) else as_uint32(list(map(_token_id, tokens)))
        return found

    def _made(self, word: bytes) -> bytes:
        if not self.fast:
            return as_uint32(self.encode_word(word))
        stem = word.rstrip(_MARKS)
        if stem.isalpha():  # of bytes: ASCII letters alone
            found = self._packed(stem.lower())
            return found if len(stem) == len(word) else found + self._packed(word[len(stem):])
        simple = _SIMPLE.fullmatch(word.decode().lower())
        if simple is None:
            return as_uint32(self.encode_word(word))
        stem, marks = simple.groups()
        return self._packed(stem) + self._packed(marks) if marks else self._packed(stem)

    def __missing__(self, word: bytes) -> bytes:
        value = self.older.get(word)
        if value is None:
            value = self._made(word)
        self[word] = value
        return value


@functools.lru_cache(maxsize=2)
def worker_encoder(path: str) -> WordEncoder:
    """A worker's encoder to little-endian ids; it outlives the task."""
    return PackedWords(path)


def id_bytes(cache: WordEncoder, text: bytes, end: int = END_ID) -> bytes:
    """Little-endian unsigned 32-bit ids of a whole text and the end id. A tokenizer that joins across white space gets the text whole."""
    if not cache.by_word:
        return as_uint32(cache.tokenizer.encode(text.decode(), add_special_tokens=False).ids) + end.to_bytes(4, "little")
    cache.trim()
    return b"".join(map(cache.__getitem__, text.split())) + end.to_bytes(4, "little")


def encode_texts(cache: WordEncoder, texts: list[bytes], end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some whole texts, the end id after each, and how many each text has. Every distinct word is looked up once;
    Arrow lays the words' ids side by side."""
    if not cache.by_word:
        found = [id_bytes(cache, text, end) for text in texts]
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(ids) // 4 for ids in found], np.int64)
    cache.trim()
    words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    coded = words.flatten().dictionary_encode()
    known = list(map(cache.__getitem__, coded.dictionary.cast(pa.large_binary()).to_pylist()))  # no word: no ids
    bounds = words.offsets.to_numpy()
    order = np.insert(coded.indices.to_numpy(), bounds[1:], len(known))
    laid = pa.array([*known, end.to_bytes(4, "little")], pa.large_binary()).take(pa.array(order))
    offsets = np.frombuffer(laid.buffers()[1], np.int64, len(order) + 1)
    ids = np.frombuffer(laid.buffers()[2], "<u4", int(offsets[-1]) // 4) if len(order) else np.zeros(0, "<u4")
    return ids, np.diff(offsets[bounds + np.arange(len(bounds))]) // 4


def portions(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """The texts in turn, in lists that end with the text that brings them to `size` bytes."""
    held, total = [], 0
    for text in texts:
        held.append(text)
        total += len(text)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def crc(data: bytes) -> int:
    return zlib.crc32(data)
