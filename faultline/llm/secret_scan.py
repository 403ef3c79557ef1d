"""Secret scans with structural confirmation.

Pattern matches alone are the base kinds `assign`, `access` and `hex`. Further candidates, runs of base64 or hex characters,
count only if what they decode to parses: a DER key (every nested length must close exactly where its parent ends, and the
shape must be that of a PKCS#1, PKCS#8 or SEC1 private key), an OpenSSH key container (each length-prefixed field inside the
data), or a signed token (a JSON header with a string `alg`, a JSON object as payload). A PEM block of a private key is decoded
the same way, across its lines.

Kinds in their order: assign, access, hex, pem, ssh, der, token. Spans are code points, end exclusive.

Defined cases: null text counts as empty (no spans, the digest of an empty string); null and repeated doc_ids keep their
rows; an empty table gives an empty result; extra columns are ignored. Texts are scanned whole."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, prepare, whole_text

KINDS = ("assign", "access", "hex", "pem", "ssh", "der", "token")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 16 or more: the longest run from its first character, as for "one or more" with shorter runs dropped.
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]+)")
#: DER keys begin with the bytes 30 .., OpenSSH containers with "openssh-key-v1": so do their base64 and hex forms.
_KEY64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-P]|b3BlbnNzaC1rZXktdj)[A-Za-z0-9+/_-]{30,}={0,2}")
_KEY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:30|6f70656e7373682d6b65792d7631|6F70656E7373682D6B65792D7631)[0-9A-Fa-f]{46,}(?![0-9A-Fa-f])")
_SSH_MAGIC = b"openssh-key-v1\0"


def from_base64(text: str) -> bytes | None:
    """Either alphabet, padding optional, white space ignored; None if it doesn't decode."""
    text = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the items that fill data[at:end] exactly, or None."""
    found = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            size, at = int.from_bytes(data[at:at + width], "big"), at + width
        if at + size > end:
            return None
        found.append((tag, at, at + size))
        at += size
    return found


def is_der_key(data: bytes) -> bool:
    """A PKCS#1, PKCS#8 or SEC1 private key that fills the data, lengths checked through every nested sequence."""
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(data, *outer[0][1:])
    if not items or items[0][0] != 0x02 or items[0][2] - items[0][1] != 1:
        return False
    version, tags = data[items[0][1]], [tag for tag, _, _ in items]
    if len(items) >= 9 and set(tags[:9]) == {0x02}:
        return version in (0, 1)
    if version == 1 and len(items) >= 2 and tags[1] == 0x04:
        return all(der_items(data, a, b) is not None for tag, a, b in items[2:] if tag & 0x20)
    if version in (0, 1) and len(items) >= 3 and tags[1:3] == [0x30, 0x04]:
        algorithm = der_items(data, *items[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def is_ssh_key(data: bytes) -> bool:
    """Magic, then cipher, key derivation, its options, the number of keys, and as many length-prefixed keys."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at, fields = len(_SSH_MAGIC), 0
    while fields < 3:
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        at, fields = at + 4 + size, fields + 1
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return False
    for _ in range(keys + 1):  # the public keys and the private section
        size = int.from_bytes(data[at:at + 4], "big")
        if not size or at + 4 + size > len(data):
            return False
        at += 4 + size
    return True


def is_signed_token(header: str, payload: str) -> bool:
    parts = []
    for text in (header, payload):
        raw = from_base64(text)
        try:
            parts.append(json.loads(raw) if raw is not None else None)
        except (ValueError, RecursionError):
            return False
    return isinstance(parts[0], dict) and isinstance(parts[0].get("alg"), str) and isinstance(parts[1], dict)


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "ssh" if is_ssh_key(data) else "der" if is_der_key(data) else None


def confirmed(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, rank of kind, end) that structure confirms."""
    found = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            if key_kind(from_base64(m[2])) or (m[1] == "ENCRYPTED PRIVATE KEY" and der_items(d := from_base64(m[2]) or b"", 0, len(d))):
                found.append((m.start(), KINDS.index("pem"), m.end()))
    if "eyJ" in text:
        for m in _TOKEN.finditer(text):
            if is_signed_token(m[1], m[2]):
                found.append((m.start(), KINDS.index("token"), m.end()))
    for pattern, decode in ((_KEY64, from_base64), (_KEY_HEX, lambda s: bytes.fromhex(s) if len(s) % 2 == 0 else None)):
        for m in pattern.finditer(text):
            if kind := key_kind(decode(m[0])):
                found.append((m.start(), KINDS.index(kind), m.end()))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    found = []
    if _ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each by start, then kind."""
    base = sorted(base_spans(text))
    return base, sorted(base + confirmed(text))


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = {"key": batch["key"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
            for one in batch["text"]:
                base, every = spans(one)
                for i, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(k == i for _, k, _ in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(every))
            yield out

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return map_batches(rows, run, f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("key", key)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with secrets replaced; a null text stays null."""
    prepare(docs.sparkSession)
    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redacted(t))

    return docs.withColumn(text, replace(F.col(text)))
