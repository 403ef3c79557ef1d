"""MinHash near-dedup: a chosen-path set similarity join.

A document is its set of distinct shingles of five words; equal sets are one class. Trees branch classes by minwise tokens:
the nodes of level one are the values of one minwise token, another for each tree. A node of at most LIMIT classes is a leaf
and is compared exhaustively. All members of a larger node are compared with its PIVOTS, which then leave it; the rest branches
by BRANCHES further tokens, drawn by the node's hash from those that its path has not used. Nodes whose classes already belong to
one component need no further work, so a group of near copies that holds a third of all rows costs a few comparisons per class
rather than one per pair. Two sets of similarity J stay together at level one with probability J per tree, and from there with
f = 1 - (1 - J f)^2, at least 0.88 at J = 0.75, at any depth, as every level branches twice; ten independent trees miss a
link at the threshold with probability below 2e-5. The trees draw from the same 38 tokens, so a pair of which few agree is
missed more often; the measured recall of planted pairs under ten levels is in the tests. Texts that are alike, but less than the
threshold, cost: of N of them, pairwise alike to J, about (2 J)^levels rows each until nodes are small.

Agreement of the minwise tokens, sent as one byte each, drops only pairs that lie five deviations under the threshold (a byte may
agree by chance, which keeps a pair more); every link is confirmed on the full sets. Links go between classes, copies are never expanded, and no class's links, texts or sets pass through the driver.

Defined cases: null and empty texts have an empty set and are linked with nothing; fewer than five words are one shingle; a
repeated row shares its class; a null doc_id takes part, but never names a component that has another id; extra columns are
ignored (`components`) or kept (`deduplicated`); an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import map_batches, prepare, whole_text
from .components import connected

SHINGLE, PERCENT = 5, 75
TREES, TOKENS, BRANCHES, LIMIT, PIVOTS = 10, 48, 2, 4096, 8
#: A leaf's sets together hold at most so many shingles (32 MB), however long its documents are.
LEAF_SHINGLES = 4_000_000
#: Groups that share members become one, if it has at most so many, so that a text is sent once and not once for each of them.
MERGED = 256
#: Bits of a page of the bitmap of wanted rows, and of all its pages (16 MB).
PAGE, MOST_BITS = 1 << 15, 1 << 27
#: Least number of equal minwise tokens: five deviations under the mean at the threshold.
LEAST_EQUAL = 21
_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; A-Z count as lower case (bytes.lower() is ASCII only)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, np.uint64)
    for i in range(width):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n])
    return np.unique(mixed)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, mixed to signed 32-bit numbers."""
    return (_mix(np.array([(shingles * m + a).min() for m, a in zip(_MULTIPLY, _ADD)], np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, on sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < PERCENT * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, class, tokens) per row; class and tokens are null for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "th": batch["th"], "n_shingles": [], "class": [], "tokens": []}
            for data in batch["text"]:
                shingles = shingle_set(data)
                out["n_shingles"].append(len(shingles))
                out["class"].append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                out["tokens"].append(minwise(shingles) if len(shingles) else None)
            yield out

    return map_batches(docs, sign, f"doc_id {kind}, th long, n_shingles long, class binary, tokens array<int>", binary=["text"])


def _sized(rows: DataFrame) -> DataFrame:
    """Rows (node, id, label, w) of nodes that still hold classes not known to be linked, and whether the node is a leaf; w is
    the size of the class's set."""
    sizes = checkpoint(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum("w").alias("held")).filter("n > 1 and low <> high")
                       .select("node", F.expr(f"n <= {LIMIT} and held <= {LEAF_SHINGLES}").alias("leaf")))
    return checkpoint(rows.join(sizes, "node"))


def _roots(classes: DataFrame) -> DataFrame:
    tokens = [F.xxhash64(F.lit(t), F.element_at("tokens", t + 1)) for t in range(TREES)]
    return classes.select("id", F.explode(F.array(*tokens)).alias("node"), F.col("id").alias("label"), F.col("n_shingles").alias("w"), F.lit(0).cast("long").alias("used"))


def _children(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Each row under the nodes of the tokens that its node selects. `used` has a bit for each token on the way to the node."""
    every = F.sequence(F.lit(0), F.lit(TOKENS - TREES - 1))
    bit = lambda at: F.lit(1).cast("long") * F.pow(F.lit(2.0), at).cast("long")
    free = F.filter(every, lambda at: F.col("used").bitwiseAND(bit(at)) == 0)
    # A path that has used all tokens, 38 levels deep, begins again.
    free = F.when(F.size(free) >= BRANCHES, free).otherwise(every)
    drawn = F.slice(F.transform(F.array_sort(F.transform(free, lambda at: F.struct(F.xxhash64("node", at).alias("by"), at.alias("at")))), lambda d: d["at"]), 1, BRANCHES)
    below = F.transform("drawn", lambda at: F.struct(F.xxhash64("node", at, F.element_at("tokens", at + TREES + 1)).alias("node"), F.col("used").bitwiseOR(bit(at)).alias("used")))
    met = rows.withColumn("drawn", drawn).join(classes.select("id", "tokens"), "id")
    return met.select("id", "label", "w", F.inline(below))


def _equal(a: str, b: str):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _sketches(classes: DataFrame) -> DataFrame:
    """(id, sketch): a byte of each token."""
    return classes.select("id", F.transform("tokens", lambda t: t.bitwiseAND(F.lit(255)) - 128).cast("array<tinyint>").alias("sketch"))


def _leaf_groups(leaves: DataFrame, classes: DataFrame) -> DataFrame:
    """(group, members): parts of leaves that minwise tokens hold together, each once although many trees find it."""
    found = leaves.groupBy("node").agg(F.sort_array(F.collect_set("id")).alias("members")).select("members").withColumn("group", F.xxhash64("members")).dropDuplicates(["group", "members"])
    held = found.select("group", F.posexplode("members").alias("place", "id")).join(_sketches(classes), "id")

    def connect(batches):
        for batch in batches:
            out = {"members": []}
            for rows in batch["rows"]:
                ids, tokens = np.array([r["id"] for r in rows]), np.array([r["sketch"] for r in rows], np.int8)
                part = np.arange(len(ids))
                for i in range(1, len(ids)):
                    met = np.unique(part[:i][(tokens[:i] == tokens[i]).sum(1) >= LEAST_EQUAL])
                    if len(met):
                        part[i] = met[0]
                        if len(met) > 1:
                            part[np.isin(part, met)] = met[0]
                names, sizes = np.unique(part, return_counts=True)
                out["members"] += [np.sort(ids[part == name]).tolist() for name in names[sizes > 1]]
            yield out

    gathered = held.groupBy("group").agg(F.collect_list(F.struct("id", "sketch")).alias("rows")).select("rows")
    return map_batches(gathered, connect, "members array<long>").withColumn("group", F.xxhash64("members")).dropDuplicates(["group", "members"])


def _merged(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Groups that hang together by shared members as one group, as far as it stays small; it holds every pair of them. The
    groups of larger ones stay as they are."""
    own = groups.select("group", F.col("members")[0].alias("first"), F.explode("members").alias("id"))
    linked = own.filter("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct()
    roots = connected(linked).withColumnRenamed("node", "id")
    whole = checkpoint(roots.select("id", "root").union(roots.select(F.col("root").alias("id"), "root").distinct()))
    held = whole.join(classes.select("id", F.col("n_shingles").alias("w")), "id").groupBy("root").agg(F.count("*").alias("n"), F.sum("w").alias("held"))
    small = held.filter(f"n <= {MERGED} and held <= {LEAF_SHINGLES}").select("root")
    as_one = whole.join(small, "root").groupBy("root").agg(F.sort_array(F.collect_list("id")).alias("members")).select("members")
    large = held.filter(f"n > {MERGED} or held > {LEAF_SHINGLES}").select("root")
    # The root of a group is that of its first member.
    as_before = groups.withColumn("id", F.col("members")[0]).join(whole, "id").join(large, "root", "left_semi").select("members")
    return as_one.union(as_before).select("members", F.xxhash64("members").alias("group"))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all pairs of sets: shingles that many sets hold as a product of 0/1 columns, others one by one."""
    n = len(sets)
    shingles, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(n), [len(s) for s in sets])
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    member, ends = member[order], np.cumsum(held)
    often = np.flatnonzero(held > max(1, n // 10))
    for at in range(0, len(often), 4096):
        part = often[at:at + 4096]
        block = np.zeros((n, len(part)), np.float32)
        for i, c in enumerate(part.tolist()):
            block[member[ends[c] - held[c]:ends[c]], i] = 1
        common += block @ block.T
    for c in np.flatnonzero((held > 1) & (held <= max(1, n // 10))).tolist():
        own = member[ends[c] - held[c]:ends[c]]
        common[np.ix_(own, own)] += 1
    return common


def _group_links(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Links from each member to the first of its component within the group; every pair of a group is compared exactly."""

    def link(batches):
        for batch in batches:
            out = {"u": [], "v": []}
            for rows in batch["rows"]:
                rows = sorted({r["id"]: r for r in rows}.values(), key=lambda r: r["id"])
                ids, shingles = [r["id"] for r in rows], [shingle_set(r["text"]) for r in rows]
                size, counts = np.array([len(s) for s in shingles], np.float64), common_counts(shingles)
                part = np.arange(len(ids))
                for i in range(1, len(ids)):
                    common = counts[i, :i].astype(np.float64)
                    met = np.unique(part[:i][100 * common >= PERCENT * (size[i] + size[:i] - common)])
                    if len(met):
                        part[i] = met[0]
                        if len(met) > 1:
                            part[np.isin(part, met)] = met[0]
                for i, p in enumerate(part.tolist()):
                    if i != p:
                        out["u"].append(ids[i])
                        out["v"].append(ids[p])
            yield out

    rows = groups.withColumn("g", F.xxhash64("members", F.lit("g"))).select("g", F.explode("members").alias("id")).join(texts, "id")
    return map_batches(rows.groupBy("g").agg(F.collect_list(F.struct("id", "text")).alias("rows")).select("rows"), link, "u long, v long")


def _pair_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def confirm(batches):
        for batch in batches:
            good = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch["a"], batch["b"])]
            yield {name: [x for x, ok in zip(batch[name], good) if ok] for name in ("u", "v")}

    # Only the sets of the pairs' classes are sent.
    met = sets.join(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_semi")
    both = pairs.join(met.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(met.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    return map_batches(both.select("u", "v", "a", "b"), confirm, "u long, v long")


def _likely(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that may be among rows (d, t): all that are, and of the others few, as long as the bitmap has room. It has
    16 bits a row, but at most MOST_BITS, so it can go to every task; a join has the last word."""
    bits = min(MOST_BITS, PAGE * max(1, -(-16 * rows.count() // PAGE)))
    slot = lambda *key: F.pmod(F.xxhash64(*key), F.lit(bits)) + 1
    page, bit = lambda at: F.bitmap_bucket_number(at).alias("page"), lambda at: F.bitmap_bit_position(at).cast("int").alias("bit")
    at = slot("d", "t")
    pages = rows.select(page(at), bit(at)).repartition("page").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("seen"))
    own = slot("doc_id", "th")
    met = docs.withColumns({"page": page(own), "bit": bit(own)}).join(F.broadcast(pages), "page")
    return met.filter("shiftright(cast(conv(hex(substring(seen, bit div 8 + 1, 1)), 16, 10) as int), bit % 8) & 1 = 1").select(*docs.columns)


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the wanted classes, the text of one row each; others are not sent. The sets of a group are made from it
    where they are compared: hashes do not compress, texts do."""
    rows = checkpoint(classes.join(wanted.distinct(), "id").select("id", F.col("doc_id").alias("d"), F.col("th").alias("t")))
    docs = _likely(docs, rows)
    # The wanted classes grow with the corpus, so this join shuffles at every size; it never turns into a broadcast.
    held = docs.join(rows.hint("merge"), docs["doc_id"].eqNullSafe(rows["d"]) & (docs["th"] == rows["t"])).select("id", F.col("text").cast("binary").alias("text"))

    def once(batches):
        # Repeats of a row are joined in one place; where Spark splits that, a class comes once per split, which does no harm.
        seen = set()
        for batch in batches:
            new = [(i, data) for i, data in zip(batch["id"], batch["text"]) if i not in seen and not seen.add(i)]
            yield {"id": [i for i, _ in new], "text": [data for _, data in new]}

    return map_batches(held, once, "id long, text binary")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the wanted classes, for members of large nodes, which meet several pivots at every level."""

    def shingles(batches):
        for batch in batches:
            yield {"id": batch["id"], "shingles": [shingle_set(data).tobytes() for data in batch["text"]]}

    return map_batches(_texts(docs, classes, wanted), shingles, "id long, shingles binary")


def _empty(df: DataFrame) -> bool:
    return not df.head(1)


def _labels(links: list[DataFrame]) -> DataFrame:
    """(id, root): for linked classes the least neighbour of their least neighbour. Equal roots mean one component, which is all
    that pruning needs; components are completed once, at the end."""
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    both = every.select("u", "v").union(every.select(F.col("v"), F.col("u")))
    near = checkpoint(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return checkpoint(near.join(near.select(F.col("id").alias("m"), F.col("m").alias("next")), "m").select("id", F.col("next").alias("root")))


def _relabelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (node, id, w, used) with their component so far as label."""
    return rows.drop("label", "leaf").join(known, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")


def _pivots(rows: DataFrame) -> DataFrame:
    """Up to PIVOTS members of each node, the least of each slot in a fixed random order."""
    least = F.min(F.struct(F.xxhash64("id").alias("by"), F.col("id"), F.col("label"), F.col("sketch"))).alias("least")
    return rows.groupBy("node", F.pmod(F.xxhash64("id", F.lit("slot")), F.lit(PIVOTS)).alias("slot")).agg(least).select("node", F.col("least.id").alias("pivot"), F.col("least.label").alias("of"), F.col("least.sketch").alias("of_sketch"))


def class_components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root): the component of every class that is linked to another one, named by its least class id."""
    level, links, texts, sets = _sized(_roots(classes)), [], None, None
    while True:
        leaves, large = level.filter("leaf"), level.filter("not leaf")
        groups = checkpoint(_merged(checkpoint(_leaf_groups(leaves, classes)), classes))
        if texts is None:  # deeper levels hold no other classes
            texts = checkpoint(_texts(docs, classes, groups.select(F.explode("members").alias("id")).union(large.select("id"))))
        links.append(checkpoint(_group_links(groups, texts)))
        if _empty(large):
            break
        if sets is None:
            sets = checkpoint(_sets(docs, classes, large.select("id")))
        rows = _sized(_relabelled(large, _labels(links)))
        sketched = checkpoint(rows.join(_sketches(classes), "id").select("node", "id", "label", "sketch"))
        pivots = checkpoint(_pivots(sketched))
        met = sketched.join(pivots, "node").filter((F.col("label") != F.col("of")) & (_equal("sketch", "of_sketch") >= LEAST_EQUAL))
        pairs = checkpoint(met.select(F.least("id", "pivot").alias("u"), F.greatest("id", "pivot").alias("v")).distinct())
        links.append(checkpoint(_pair_links(pairs, sets)))
        rest = rows.join(pivots.select("node", F.col("pivot").alias("id")), ["node", "id"], "left_anti")
        level = _sized(_children(_relabelled(rest, _labels(links)), classes))
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    return checkpoint(connected(every))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept) per row; th is a hash of the text, to tell rows of one id apart."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("text")).withColumn("th", F.xxhash64("text"))
    signed = checkpoint(signatures(own.select("doc_id", "th", "text")))
    full = signed.filter("class is not null")
    classes = checkpoint(full.select("class", "doc_id", "th", "tokens", "n_shingles").dropDuplicates(["class"]).withColumn("id", F.monotonically_increasing_id()))
    roots = class_components(own, classes)
    least = full.groupBy("class").agg(F.min("doc_id").alias("least"))
    named = checkpoint(classes.select("class", "id").join(least, "class").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    lowest = checkpoint(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of_class = checkpoint(named.join(lowest, "root").select("class", "component_id"))
    alone = signed.filter("class is null").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"))
    rest = full.select("doc_id", "th", "n_shingles", "class").join(of_class, "class").select("doc_id", "th", "n_shingles", "component_id")
    return rest.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) per row."""
    return components(docs, key, text).select(F.col("doc_id").alias(key), "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows of which one per component stays, that of the least doc_id; empty sets all stay. Of rows repeated with
    that doc_id one stays."""
    found = components(docs, key, text).filter("kept")
    once = found.filter("n_shingles > 0").dropDuplicates(["component_id"]).union(found.filter("n_shingles = 0"))
    kept = checkpoint(once.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.lit(True).alias("stays")))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = source.withColumn("d", F.col(f"row.`{key}`")).withColumn("t", F.xxhash64(whole_text(f"row.`{text}`")))
    same = rows["d"].eqNullSafe(kept["d"]) & (rows["t"] == kept["t"])
    repeats = checkpoint(found.filter("n_shingles > 0").groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("d"), F.col("th").alias("t")))
    if _empty(repeats):
        return rows.join(kept.hint("merge"), same, "left_semi").select("row.*")
    is_repeat = rows["d"].eqNullSafe(repeats["d"]) & (rows["t"] == repeats["t"])
    single = rows.join(repeats, is_repeat, "left_anti").join(kept, same, "left_semi").select("row")
    several = rows.join(repeats, is_repeat, "left_semi").join(kept, same, "left_semi").dropDuplicates(["d", "t"]).select("row")
    return single.union(several).select("row.*")


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
    both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b)
    SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.m, documents.doc_id) AS component_id, coalesce(m.m, documents.doc_id) = documents.doc_id AS kept
    FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) m USING (doc_id)"""
