"""Prefix trie of conversations by the Euler-tour technique.

1. A conversation's prefixes are named by a running 128-bit exclusive or of position-dependent turn hashes, so that a
   conversation of any length is cut into chunks; a node is a name, its conv_id the smallest member.
2. Every node has an enter and an exit arc. The successor of an arc follows from first children, next siblings and parents;
   siblings are numbered by ranges, so a parent of any number of children spreads.
3. The tour is list-ranked by contraction: in each round coins mark about a quarter of the arcs, no two of them neighbours;
   they are spliced out and remember their predecessor and its weight. When at most `GATHER` arcs are left, these are
   ranked in one task; then the rounds are undone, each by a join on the arcs removed in it.
4. Prefix sums at arc positions: what lies between a node's two arcs is its subtree.

Defined cases: rows without conv_id belong to no conversation; null role or text counts as empty; turns of equal number (or
none: null sorts first) ascend by a digest of role and text; repeated rows are turns of their own each; a conversation may be
turnless and is then a member of the root; conversations of any length and number of copies are spread; an empty table
has no conversation, no root, and gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import checkpoint
from . import scan
from .common import prepare
from .manifest import crc32_sql

#: Turns of a conversation that one window takes.
CHUNK = 1024
#: Arcs that are ranked in one task at the end of the contraction.
GATHER = 1 << 16
#: Conversations of one block of ids share the first one's first turns, fewer than SHARED.
BLOCK, SHARED = 100, 6
KEY = ["depth", "k1", "k2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, digest, chars, rank, group_rows): the turns of each conversation by number, from 0."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("chars"))
    counted = own.groupBy("conv", "turn", "digest", "chars").agg(F.count("*").alias("copies"))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return scan.ranked(copies, ["conv"], ["turn", "digest", "copy"]).select("conv", "digest", "chars", "rank", "group_rows")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, digest, chars, length) and (conv, length): each conversation begins with the first turns of the first
    conversation of its block, as many as a checksum of its id says, and goes on with its own."""
    turns = checkpoint(turns)
    sizes = turns.filter("rank = 0").select("conv", "group_rows")
    own = sizes.select("conv", "group_rows", (F.crc32(F.col("conv").cast("string")) % SHARED).alias("h"), (F.col("conv") - F.col("conv") % BLOCK).alias("base"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("group_rows").alias("base_rows"))
    convs = own.join(bases, "base", "left").withColumn("b", F.least(F.coalesce("base_rows", F.lit(0)), "h"))
    convs = checkpoint(convs.select("conv", "base", "h", "b", (F.col("b") + F.greatest(F.col("group_rows") - F.col("h"), F.lit(0))).alias("length")))
    heads = turns.filter(F.col("rank") < SHARED - 1).withColumnRenamed("conv", "base").join(convs, "base").filter(F.col("rank") < F.col("b"))
    rest = turns.join(convs, "conv").filter(F.col("rank") >= F.col("h"))
    made = [heads.select("conv", (F.col("rank") + 1).alias("pos"), "digest", "chars", "length"),
            rest.select("conv", (F.col("rank") - F.col("h") + F.col("b") + 1).alias("pos"), "digest", "chars", "length")]
    return made[0].unionByName(made[1]), convs.select("conv", "length")


def members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, chars, length): each prefix of each conversation, the empty one included, by name and parent's name."""
    hashed = checkpoint(turns.withColumns({"x1": F.xxhash64("pos", "digest"), "x2": F.xxhash64(F.lit("second"), "pos", "digest"), "chunk": F.floor((F.col("pos") - 1) / CHUNK)}))
    many = hashed.filter(F.col("length") > CHUNK).groupBy("conv", "chunk").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    # One row per chunk of a conversation that has several.
    before = Window.partitionBy("conv").orderBy("chunk")
    carried = many.select("conv", "chunk", *[F.bit_xor(s).over(before).bitwiseXOR(F.col(s)).alias(c) for s, c in (("s1", "c1"), ("s2", "c2"))])
    inside = Window.partitionBy("conv", "chunk").orderBy("pos")
    own = hashed.join(carried, ["conv", "chunk"], "left")
    for x, c, k in (("x1", "c1", "k1"), ("x2", "c2", "k2")):
        own = own.withColumn(k, F.bit_xor(x).over(inside).bitwiseXOR(F.coalesce(F.col(c), F.lit(0))))
    own = own.select("conv", F.col("pos").alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "chars", "length")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("chars"), "length")
    return own.unionByName(roots)


def ends(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes at which a conversation ends. Ids are hashed as they stream by in order, so a node
    at which any number ends takes no memory."""
    sorted_rows = rows.filter("depth = length").select(*KEY, "conv").repartition(*KEY).sortWithinPartitions(*KEY, "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i < 3 else pa.string()) for i in range(4)], names=[*KEY, "ends_sha256"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                own, ids = tuple(int(c[a]) for c in columns[:3]), ",".join(map(str, columns[3][a:b].tolist())).encode()
                if own == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(ids)
            if len(out) >= 10_000:
                yield full()
                out.clear()
        if key is not None:
            out.append((*key, state.hexdigest()))
            yield full()

    return sorted_rows.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def tour(nodes: DataFrame, siblings: DataFrame) -> DataFrame:
    """(arc, next): enter arcs are twice the node's id, exit arcs one more; the root's exit has no successor."""
    first = siblings.filter("rank = 0").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    enter = nodes.select("id").join(first, "id", "left").select((F.col("id") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("next"))
    after = siblings.select("parent", (F.col("rank") - 1).alias("rank"), F.col("id").alias("sibling"))
    leave = siblings.join(after, ["parent", "rank"], "left").select((F.col("id") * 2 + 1).alias("arc"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"))
    last = nodes.filter("depth = 0").select((F.col("id") * 2 + 1).alias("arc"), F.lit(None).cast("long").alias("next"))
    return enter.unionByName(leave).unionByName(last)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks a whole short list: the arc that no other one points to begins it."""
    follow = {}
    for batch in batches:
        for arc, nxt, weight in zip(*(c.to_pylist() for c in batch.columns)):
            follow[arc] = (nxt, weight)
    arcs, places, at = [], [], 0
    arc = next(iter(follow.keys() - {n for n, _ in follow.values()}), None)
    while arc is not None:
        arcs.append(arc)
        places.append(at)
        arc, weight = follow[arc]
        at += weight
    yield pa.RecordBatch.from_arrays([pa.array(arcs, pa.int64()), pa.array(places, pa.int64())], names=["arc", "pos"])


def list_ranks(links: DataFrame, gather: int | None = None) -> DataFrame:
    """(arc, next) of one list -> (arc, pos) from 0."""
    gather = GATHER if gather is None else gather
    left, removed = checkpoint(links.select("arc", "next", F.lit(1).cast("long").alias("weight"))), []
    while left.count() > gather:
        coin = F.xxhash64("arc", F.lit(len(removed))) % 2 == 0
        u = left.filter(coin).toDF("u", "u_next", "u_weight")
        v = left.filter(~coin).toDF("v", "v_next", "v_weight")
        # A v behind a u is spliced out. Keys on either side are unique: no arc has two successors or predecessors.
        met = checkpoint(u.join(v, F.col("u_next") == F.col("v"), "full"))
        both = F.col("u").isNotNull() & F.col("v").isNotNull()
        left = met.select(F.coalesce("u", "v").alias("arc"), F.when(F.col("v").isNotNull(), F.col("v_next")).otherwise(F.col("u_next")).alias("next"),
                          (F.coalesce("u_weight", F.lit(0)) + F.coalesce("v_weight", F.lit(0))).alias("weight"))
        removed.append(met.filter(both).select(F.col("v"), F.col("u"), F.col("u_weight").alias("offset")))
    parts = [checkpoint(left.repartition(1).mapInArrow(_walk, "arc long, pos long"))]
    for spliced in reversed(removed):
        known = reduce(DataFrame.unionByName, parts)
        parts.append(checkpoint(spliced.join(known, F.col("u") == F.col("arc")).select(F.col("v").alias("arc"), (F.col("pos") + F.col("offset")).alias("pos"))))
    return reduce(DataFrame.unionByName, parts)


def subtree_sums(arcs: DataFrame, nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(id, each value summed over the node's subtree) from ranked arcs; values are expressions over `nodes`."""
    entered = F.col("arc") % 2 == 0
    placed = arcs.select("pos", "arc", F.shiftright("arc", 1).alias("id")).join(nodes.select("id", *[v.cast("long").alias(f"own_{k}") for k, v in values.items()]), "id")
    sums = scan.running(placed, "pos", {k: F.when(entered, F.col(f"own_{k}")).otherwise(0) for k in values})
    return sums.groupBy("id").agg(*[(F.sum(F.when(entered, F.col(f"own_{k}") - F.col(k)).otherwise(F.col(k)))).alias(k) for k in values])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv, pos, digest, chars, length) under (conv, length): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = checkpoint(members(turns, convs))
    named = rows.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = checkpoint(scan.ranked(named, [], ["depth", "conv_id"]).drop("group_rows").withColumnRenamed("rank", "id"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.join(above, ["depth", "p1", "p2"]).select("id", "conv_id", "parent", "parent_conv_id")
    siblings = checkpoint(scan.ranked(below, ["parent"], ["conv_id"]))
    children = siblings.filter("rank = 0").select(F.col("parent").alias("id"), F.col("group_rows").alias("n_children"))
    full = checkpoint(nodes.join(children, "id", "left").join(siblings.select("id", "parent_conv_id"), "id", "left").join(ends(rows), KEY, "left").na.fill({"n_children": 0}))
    sums = subtree_sums(list_ranks(tour(nodes, siblings)), full, {
        "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    return full.join(sums, "id").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with shared heads."""
    prepare(conversations.sparkSession)
    return prefix_trie(*with_shared_heads(turns_of(conversations)))


SQL = f"""WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(strlen(role)::VARCHAR || ':' || role || text)) - 1 AS k FROM t),
    v AS (SELECT c, {crc32_sql('c::VARCHAR')} % 6 AS h, c - c % 100 AS base FROM (SELECT DISTINCT c FROM t)),
    s AS (SELECT v.c, k, 0 AS own, role, text FROM v JOIN r ON r.c = v.base AND k < h UNION ALL SELECT v.c, k, 1, role, text FROM v JOIN r ON r.c = v.c AND k >= h),
    q AS (SELECT c, row_number() OVER w AS d, text, string_agg(strlen(role)::VARCHAR || ':' || role || strlen(text)::VARCHAR || ':' || text, '') OVER w AS p FROM s WINDOW w AS (PARTITION BY c ORDER BY own, k)),
    m AS (SELECT c, d, p, length(text) AS chars FROM q UNION ALL SELECT c, 0, '', 0 FROM v),
    e AS (SELECT c, max(d) AS e FROM m GROUP BY c),
    n AS (SELECT d, p, min(m.c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (WHERE e = d), '')) AS ends FROM m JOIN e ON e.c = m.c GROUP BY d, p),
    a AS (SELECT m.c, m.d, n.conv_id AS node FROM m JOIN n ON n.d = m.d AND n.p = m.p),
    u AS (SELECT n.conv_id, n.d, a.node AS parent FROM n LEFT JOIN a ON a.c = n.conv_id AND a.d = n.d - 1),
    k AS (SELECT parent, d - 1 AS d, count(*) AS n FROM u WHERE parent IS NOT NULL GROUP BY ALL),
    x AS (SELECT n.conv_id, n.d, (n.n_convs - 1) * n.chars AS saved, coalesce(k.n, 0) AS n FROM n LEFT JOIN k ON k.parent = n.conv_id AND k.d = n.d),
    z AS (SELECT a.node, a.d, sum(saved) AS saved, count(*) FILTER (WHERE n = 0) AS leaves FROM x JOIN a ON a.c = x.conv_id AND a.d <= x.d GROUP BY a.node, a.d)
    SELECT n.conv_id, n.d AS depth, u.parent AS parent_conv_id, n.n_convs, x.n AS n_children, z.leaves AS n_leaves, z.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
    FROM n JOIN u ON u.conv_id = n.conv_id AND u.d = n.d JOIN x ON x.conv_id = n.conv_id AND x.d = n.d JOIN z ON z.node = n.conv_id AND z.d = n.d"""
