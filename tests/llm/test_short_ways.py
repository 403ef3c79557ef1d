"""The encoder's short ways give the library's ids."""

import struct

import numpy as np
import pyarrow as pa

from faultline.llm.arrow_files import SequenceReader, SequenceWriter
from faultline.llm.tokens import PackedWords, WordEncoder, as_uint32, encode_texts, id_bytes, portions, tokenizer_path
from faultline.llm.transducer import Codec, Lexicon


def test_short_ways_give_the_same_ids():
    assert all(as_uint32(list(range(n))) == struct.pack(f"<{n}I", *range(n)) for n in (0, 1, 31, 32, 100))
    encoder = WordEncoder(tokenizer_path(), list)
    for word in ("Word", "WORD***", "***", "word's", "a.b", "x1", "Straße", "ÉTÉ;", "K", "end.|#"):
        assert encoder[word.encode()] == encoder.tokenizer.encode(word, add_special_tokens=False).ids
    codec = Codec(Lexicon.compile({}), tokenizer_path())
    assert codec.decimal(np.array([3, 41, 0], np.uint32)) == "3 41 0"


def test_a_distinct_word_is_looked_up_once_for_many_texts():
    texts = [t.encode() for t in ("", " ", " Straße  word's\n", "\x1c a\x1db", "　 日本 É;", "same same SAME***", "same K", "")]
    plain, words = WordEncoder(tokenizer_path(), as_uint32), PackedWords(tokenizer_path())
    looked = []

    class Counting(PackedWords):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    for some in (texts, texts[:1], []):
        wanted = [id_bytes(plain, t) for t in some]
        ids, counts = encode_texts(words, some)
        assert ids.tobytes() == b"".join(wanted) and counts.tolist() == [len(w) // 4 for w in wanted]
    encode_texts(Counting(tokenizer_path()), texts * 50)
    assert len(looked) == len(set(looked)) and {w for t in texts for w in t.split()} <= set(looked)
    assert list(portions([b"ab", b"c", b"", b"defg"], 3)) == [[b"ab", b"c"], [b"", b"defg"]]


def test_a_reader_opens_a_batch_once_for_its_documents():
    sink = pa.BufferOutputStream()
    writer = SequenceWriter(sink, 4, 2, pa.uint16())
    writer.add(np.arange(20, dtype=np.uint16))
    writer.close()
    reader = SequenceReader(pa.BufferReader(sink.getvalue()))
    opened, values = [], reader._values
    reader._values = lambda batch, column: opened.append(batch) or values(batch, column)
    assert [reader.ids(s, n).tolist() for s, n in ((0, 3), (3, 5), (8, 0), (8, 2), (6, 14))] == [[0, 1, 2], [3, 4, 5, 6, 7], [], [8, 9], list(range(6, 20))]
    assert opened == [0, 1, 0, 1, 2]
