"""Merkle manifest of a dataset by a rollup of nested structs.

Every row is a leaf. Ranks inside a group are written in base 8; the last digit is the place among its parent's children. A
tier takes four digits: nodes are dealt once by (group, rank without these digits), a block of at most 4,096 nodes, and the
digit columns are grouped away one after the other inside the block, each time nesting the children's structs in their
parent's. What is left of a block is one struct; its digest is a node of the next tier, which works the same on a 4,096th of
the rows, until each group has one node. The groups' subroots are the nodes of one last group, whose node is the root.

Proofs go down the same way: a block and the path above it (the digests left and right of each node on the way to the root)
meet under the block's key, transforms walk the nested structs, and explode emits one row per node: no join on leaves.

Defined cases: a null column counts as `-`; null doc_id and null group sort first, each is a key like others; rows of one
doc_id ascend by their leaf digest; repeated rows are leaves of their own each, counted before they are dealt, so any
number of copies spreads; a null doc_id is not tampered with; null or empty texts and texts of any length are one leaf;
an empty table gives an empty result; other columns are ignored, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from . import scan
from .common import prepare

FAN, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields of a row."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _many(nodes: Column, level: int) -> Column:
    """Whether a group of so many nodes has more than one left after `level` levels."""
    return nodes > FAN ** level


def tier(nodes: DataFrame) -> DataFrame:
    """(grp, rank, nodes, digest, item) -> (grp, block, nodes, digest, tree): four levels nested in `tree`. `nodes` is the number
    of nodes of the group; a group that has one node left is not hashed again."""
    rows = nodes.withColumns({"block": F.floor(F.col("rank") / FAN ** LEVELS), **{f"d{j}": F.floor(F.col("rank") / FAN ** j) % FAN for j in range(LEVELS)}})
    rows = rows.repartition("grp", "block").withColumn("node", F.struct("digest", F.col("item").alias("below")))
    for level in range(LEVELS):
        kept = ["grp", "block", "nodes", *[f"d{j}" for j in range(level + 1, LEVELS)]]
        # The deal by (grp, block) serves all four groupings; sort_array brings children into the order of their digit.
        rows = rows.groupBy(*kept).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(f"d{level}").alias("d"), "node"))), lambda c: c["node"]).alias("below"))
        digests = F.transform("below", lambda c: c["digest"])
        digest = F.when(_many(F.col("nodes"), level), F.sha2(F.array_join(digests, ""), 256)).otherwise(F.element_at(digests, 1))
        rows = rows.select(*kept, F.struct(digest.alias("digest"), "below").alias("node"))
    return rows.select("grp", "block", "nodes", "node.digest", F.col("node.below").alias("tree"))


def _paths(tree: Column, above: Column, nodes: Column, level: int) -> Column:
    """Array of (item, path): every item of a nested tree with the path from it to the root."""
    def child(node: Column, place: Column) -> Column:
        digests = F.transform(tree, lambda c: c["digest"])
        beside = F.struct(F.array_join(F.slice(digests, F.lit(1), place), "").alias("before"),
                          F.array_join(F.slice(digests, place + 2, F.lit(FAN)), "").alias("after"))
        path = F.concat(F.when(_many(nodes, level), F.array(beside)).otherwise(F.array().cast(PATH)), above)
        return _paths(node["below"], path, nodes, level - 1) if level else F.struct(node["below"].alias("item"), path.alias("path"))

    found = F.transform(tree, child)
    return F.flatten(found) if level else found


def with_paths(trees: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, item, path) of all nodes of a tier. `above` has (grp, block, path, root) of its blocks. Both sides meet by one grouping."""
    both = trees.select("grp", "block", "nodes", "tree").unionByName(above, allowMissingColumns=True)
    met = both.groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("nodes", "tree", "path", "root")])
    out = met.select("grp", "root", F.explode(_paths(F.col("tree"), F.col("path"), F.col("nodes"), LEVELS - 1)).alias("out"))
    return out.select("grp", "root", "out.item", "out.path")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of all groups, and (grp, digest) of the nodes that are left."""
    tiers = []
    while True:
        tiers.append(checkpoint(tier(nodes)))
        top = tiers[-1].select("grp", "block", "nodes", "digest")
        if not top.filter("block > 0").head(1):
            return tiers, top.select("grp", "digest")
        left = F.ceil(F.col("nodes") / FAN ** LEVELS)
        nodes = top.select("grp", F.col("block").alias("rank"), left.alias("nodes"), "digest", F.col("block").alias("item"))


def _descend(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    for trees in reversed(tiers[1:]):
        above = with_paths(trees, above).select("grp", F.col("item").alias("block"), "path", "root")
    return with_paths(tiers[0], above)


def proofs(leaves: DataFrame) -> DataFrame:
    """(grp, id, leaf, extra) -> (grp, id, leaf, extra, subroot, root, path), one row per leaf. `extra` is a string that is
    carried along; leaves ascend by id, leaf and extra inside a group."""
    counted = leaves.groupBy("grp", "id", "leaf", "extra").agg(F.count("*").alias("copies"))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    first = scan.ranked(copies, ["grp"], ["id", "leaf", "extra", "copy"])
    nodes = first.select("grp", "rank", F.col("group_rows").alias("nodes"), F.col("leaf").alias("digest"), F.struct("id", "leaf", "extra").alias("item"))
    tiers, subroots = _climb(nodes)
    # All groups' subroots are the nodes of one group.
    subroots = checkpoint(subroots)
    one = scan.ranked(subroots.select(F.lit(0).alias("all"), "grp", "digest"), ["all"], ["grp"])
    tops, root = _climb(one.select(F.col("all").alias("grp"), "rank", F.col("group_rows").alias("nodes"), "digest", F.struct("grp", "digest").alias("item")))
    start = root.select("grp", F.lit(0).cast("long").alias("block"), F.array().cast(PATH).alias("path"), F.struct(F.col("digest").alias("root"), F.lit("").alias("subroot")).alias("root"))
    down = _descend(tops, start).select("item.grp", F.lit(0).cast("long").alias("block"), "path",
                                        F.struct(F.col("root.root"), F.col("item.digest").alias("subroot")).alias("root"))
    return _descend(tiers, down).select("grp", "item.*", F.col("root.subroot"), F.col("root.root"), "path")


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf digest and its proof give."""
    return F.aggregate(path, digest, lambda d, beside: F.sha2(F.concat(beside["before"], d, beside["after"]), 256))


def proof_text(path: Column) -> Column:
    """The siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(path, lambda beside: F.concat(beside["before"], beside["after"])), "")


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", text: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per document: its leaf, subroot, root, proof digest, and the check of a copy of which every third text is tampered with."""
    prepare(docs.sparkSession)
    own = lambda change: leaf([change(F.col(f"`{c}`")) if c == text else F.col(f"`{c}`") for c in fields])
    hit = F.crc32(F.col(f"`{key}`").cast("string")) % 3 == 0
    leaves = docs.select(F.col(f"`{group}`").alias("grp"), F.col(f"`{key}`").alias("id"), own(lambda c: c).alias("leaf"), F.when(hit, own(lower_ascii)).alias("extra"))
    rows = proofs(leaves).withColumn("folded_root", folded(F.col("path"), F.coalesce("extra", "leaf")))
    return rows.select(F.col("id").alias(key), "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text in DuckDB: the polynomial bit by bit."""
    bits = f"list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    return f"xor({bits}, 4294967295)"


def _sql(depth: int = 12, tops: int = 3) -> str:
    """`depth` levels for the leaves of a language and `tops` for the subroots; a group with one node left stays as it is."""
    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""l AS (SELECT lang, doc_id, sha256({' || '.join(field(c) for c in FIELDS)}) AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN sha256({' || '.join(field(low if c == 'text' else c) for c in FIELDS)}) END AS other FROM documents)""",
             "a0 AS (SELECT lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m, leaf AS h, doc_id, leaf, other FROM l)"]

    def levels(name: str, n: int) -> None:
        for j in range(n):
            beside = "string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
            parts.append(f"{name}s{j} AS (SELECT g, i, m, coalesce({beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce({beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS f FROM {name}{j})")
            parts.append(f"{name}{j + 1} AS (SELECT g, i // 8 AS i, (m + 7) // 8 AS m, CASE WHEN m > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {name}{j} GROUP BY g, i // 8, m)")

    levels("a", depth)
    parts.append(f"t0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS m, h, g AS lang FROM a{depth})")
    levels("t", tops)
    parts.append("x0 AS (SELECT a0.doc_id, a0.leaf, a0.g, a0.i, coalesce(other, leaf) AS d, '' AS p FROM a0)")
    step = "CASE WHEN s.m > 1 THEN sha256(s.b || x.d || s.f) ELSE x.d END AS d, x.p || s.b || s.f AS p"
    for j in range(depth):
        parts.append(f"x{j + 1} AS (SELECT x.doc_id, x.leaf, x.g, x.i // 8 AS i, {step} FROM x{j} x JOIN as{j} s ON s.g IS NOT DISTINCT FROM x.g AND s.i = x.i)")
    parts.append(f"y0 AS (SELECT x.doc_id, x.leaf, t0.h AS subroot, t0.i, x.d, x.p FROM x{depth} x JOIN t0 ON t0.lang IS NOT DISTINCT FROM x.g)")
    for j in range(tops):
        parts.append(f"y{j + 1} AS (SELECT x.doc_id, x.leaf, x.subroot, x.i // 8 AS i, {step} FROM y{j} x JOIN ts{j} s ON s.i = x.i)")
    return "WITH " + ",\n    ".join(parts) + f"""
    SELECT y.doc_id, y.leaf, y.subroot, r.h AS root, sha256(y.p) AS proof_sha256, y.d AS folded_root, y.d = r.h AS verified FROM y{tops} y CROSS JOIN t{tops} r"""


SQL = _sql()
