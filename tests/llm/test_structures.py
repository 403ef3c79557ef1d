"""Manifest, prefix trie and repeated substrings against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from faultline.llm import manifest, prefix_trie, scan, substring_dedup
from faultline.llm.run_index import RunIndex

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, rank long, grp string, leaf string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    def leaf(doc, text, lang, source, n):
        return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])

    def lower(text):
        return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    def climb(nodes):
        """The top digest, and the siblings on each node's way."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = i // 8 * 8
                paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + 8])))
            nodes, at = [digest(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
        return nodes[0], paths

    groups = defaultdict(list)
    for doc, text, lang, source, n, *_ in rows:
        other = leaf(doc, lower(text), lang, source, n) if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 else None
        groups[lang].append((doc, leaf(doc, text, lang, source, n), other))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or ""))
        tops[g] = climb([r[1] for r in groups[g]])
    root, above = climb([tops[g][0] for g in order]) if order else (None, [])
    out = Counter()
    for g, more in zip(order, above):
        for (doc, own, other), path in zip(groups[g], tops[g][1]):
            path, fold = path + more, other or own
            for before, after in path:
                fold = digest(before, fold, after)
            out[(doc, own, tops[g][0], root, digest(*[b + a for b, a in path]), fold, fold == root)] += 1
    return out


def manifest_rows(n, langs):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, "", "plain text", "Text WITH capitals", "ünï " * 40]), rng.choice(langs), rng.choice(["s", None]), rng.choice([1, None]), "p", 1, "g", "l") for i in range(n)]
    return rows + rows[:5] + [(None, "A", langs[0], None, None, None, None, None, None)] * 3 + [(7, "Another", langs[0], "s", 1, "p", 1, "g", "l")]


@pytest.mark.parametrize("n, langs, fan", [(0, ["en"], 4), (90, ["en"], 4), (90, [None, "de", "en", "zz", "日本", "éa", "b", "c", "d", "e"], 1), (700, ["en", None], 2)])
def test_manifest_is_the_plain_tree(spark, n, langs, fan, monkeypatch):
    """`fan` levels a tier: small tiers make several of them."""
    monkeypatch.setattr(manifest, "LEVELS", fan)
    rows = manifest_rows(n, langs)
    got = Counter(tuple(r) for r in manifest.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == brute_manifest(rows)


def test_manifest_edges(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    [row] = manifest.manifest(spark.createDataFrame([(1, "x", "en", "s", 1, "", 1, "", "")], SCHEMA)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == digest()
    copies = [(3, "Same", "en", "s", 1, "", 1, "", "")] * 100
    got = manifest.manifest(spark.createDataFrame(copies, SCHEMA)).collect()
    assert Counter(tuple(r) for r in got) == brute_manifest(copies)


def test_ranks_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(7)
    got = {(r.g, r.v): (r["rank"], r.group_rows) for r in scan.ranked(df, ["g"], ["v"]).collect()}
    for g in (None, "a", "b"):
        own = [v for k, v in rows if k == g]
        assert [got[(g, v)] for v in own] == [(i, len(own)) for i in range(len(own))]
    sums = {r.v: r.s for r in scan.running(df, "v", {"s": scan.F.col("v")}, 64).collect()}
    assert sums == {i: i * (i + 1) // 2 for i in range(500)}


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    first = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in first.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = first.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            nodes[tuple(rebuilt[c][:d])].append(c)
    out = Counter()
    for prefix, convs in nodes.items():
        below = [p for p in nodes if p[:len(prefix)] == prefix]
        leaves = [p for p in below if not any(q[:-1] == p for q in below if q)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        parent = nodes[prefix[:-1]][0] if prefix else None
        ended = ",".join(str(c) for c in convs if len(rebuilt[c]) == len(prefix))
        out[(convs[0], len(prefix), parent, len(convs), sum(q[:-1] == prefix for q in below if q), len(leaves), saved, digest(ended))] += 1
    return out


def conversation_rows(n):
    rng = random.Random(n)
    rows = []
    for c in [*range(n), 100, 105, 199, -3]:
        for turn in range(rng.choice([1, 2, 3, 7])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "long text", None, ""]), "x", 0))
    rows += [(2, None, None, None, "x", 0), (2, None, "user", "z", "x", 0), (None, 0, "user", "q", "x", 0)] + rows[:4] + [(3, 1, "user", "tie", "x", 0)]
    return rows + [(7, t, "user", f"turn {t % 3}", "x", 0) for t in range(40)] + [(207, t, "user", f"turn {t % 3}", "x", 0) for t in range(40)]


@pytest.mark.parametrize("n, chunk, gather", [(40, 4, 60), (25, 1024, 1 << 16), (0, 4, 60)])
def test_trie_is_the_plain_one(spark, n, chunk, gather, monkeypatch):
    """Small chunks and little gathered at once: many rounds."""
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "GATHER", gather)
    rows = conversation_rows(n) if n else []
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rank string, id long").repartition(3)
    assert Counter(tuple(r) for r in prefix_trie.shared_prefixes(df).collect()) == brute_trie(rows)


def brute_substrings(rows, length=100):
    """Rows of equal doc_id and text are one document."""
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest(t, 42), "big", signed=True)  # noqa: E731  Spark's xxhash64
    texts = sorted({(r[0] is not None, r[0] or 0, signed((r[1] or "").encode()), (r[1] or "").encode(), r[0]) for r in rows}, key=lambda t: t[:4])
    seen, made = set(), {}
    for _, _, _, text, doc in texts:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            if text[i:i + length] in seen:
                gone[i:i + length] = True
            seen.add(text[i:i + length])
        kept = bytes(b for b, g in zip(text, gone) if not g)
        made[(doc, text)] = (doc, len(text), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return Counter(made[(r[0], (r[1] or "").encode())] for r in rows)


def substring_rows():
    rng = random.Random(8)

    def prose(n):
        return " ".join(rng.choice(["lorem", "ipsüm", "dolor", "sit", "amet", "x", "日本"]) + str(rng.randrange(60)) for _ in range(n))

    passage, base = prose(40), prose(120)
    texts = [None, "", "short", "a" * 99, "a" * 100, "a" * 350, "ab" * 300, base, base, base[:200] + "!" + base[200:], base[150:500] + prose(30), passage, passage + "x"]
    texts += [prose(rng.randrange(5)) + passage[rng.randrange(30):] + prose(20) for _ in range(40)] + [prose(1200) + base + passage * 3, "\0" * 130, "\0" * 120]
    rows = [(i, t, "en", "s", 1, "p", 1, "g", "l") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[3], rows[9], (5, base, *rows[0][2:]), (5, passage, *rows[0][2:]), (None, base, *rows[0][2:]), (None, passage, *rows[0][2:])]


@pytest.mark.parametrize("hot, block, piece", [(1 << 14, 4 << 20, 1 << 21), (2, 3000, 1 << 21), (5, 900, 700)])
def test_substrings_against_brute_force(spark, hot, block, piece, monkeypatch):
    """Small blocks and pieces; anchors with more than two stretches are dealt by single strings."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(substring_dedup, "BUCKET_PAIRS", 200)
    rows = substring_rows()
    got = Counter(tuple(r) for r in substring_dedup.digests(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())
    assert got == brute_substrings(rows)


def test_substrings_of_nothing(spark):
    assert substring_dedup.digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_run_index_matches_and_stays_small():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 4, 400, np.uint8).tobytes()
    for length in (1, 5, 12):
        strings = [base[a:a + n] for a, n in zip(rng.integers(0, 350, 40).tolist(), rng.integers(0, 60, 40).tolist())] + [b"", bytes([255, 0, 255] * 9)]
        index = RunIndex(b"".join(strings), np.array(list(map(len, strings))))
        grams = [s[j:j + length] for s in strings for j in range(len(s) - length + 1)]
        places = np.array([index.starts[i] + j for i, s in enumerate(strings) for j in range(len(s) - length + 1)])
        first = {}
        assert index.first_of_equals(places, length).tolist() == [first.setdefault(g, i) for i, g in enumerate(grams)]
    copies = RunIndex(base * 50, np.full(50, 400))
    assert len(copies.run_rows) < 2 * 400 < 50 * 400 / 10
