"""Exact top-k by inner product from an impact-ordered index, score at a time.

The vectors are dealt into blocks; a block's index holds its postings (dimension, vector, quantised value) by descending
impact, the size of the value, cut into segments at falling impact bounds. A block of queries takes the segments in that
order and adds each to its accumulators. After a segment, what is left of a vector can change its score by no more than the
length of the query times the length of the vector's unread part. A query stops only once that proves that few vectors can
still be among its best; exactly these are scored again from their whole vectors. Unproven queries read on to the end.

The stated queries meet all vectors, block against block; each pair of blocks gives k rows per query, which are merged.

Defined cases: vectors that are null, or hold null or non-finite components, or have no id, take no part; rows of one id count
as one, the least vector of them; vectors are compared with those of their own length; fewer than k others give fewer rows;
equal scores are ordered by id; a score beyond 64 bits is an error; extra columns are ignored; an empty table gives an empty
result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import map_batches, prepare

SCALE, TOP = 64, 20
BLOCK, QUERY_BLOCK = 8192, 512
#: A segment ends where this share of a block's postings has been read.
SEGMENT_SHARES = (0.55, 0.8, 1.0)
#: A query may stop when no more vectors of a block than this can be members; they are all rescored.
RESCORE = 512


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v, width): floor(scale * x) of every vector that takes part, one row per id."""
    x = F.col(vector)
    usable = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(usable).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))


def _matrix(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(rows, key=lambda r: r["id"])
    return np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.int64).reshape(len(rows), -1)


def build_index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block: ids in order, and postings by descending impact with the ends of their segments."""
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / block)).alias("blocks")
    sizes = checkpoint(vectors.groupBy("width").agg(blocks))
    dealt = vectors.join(sizes, "width").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))

    def post(batches):
        for batch in batches:
            out = {name: [] for name in ("width", "block", "ids", "dims", "places", "values", "ends")}
            for width, number, rows in zip(batch["width"], batch["block"], batch["rows"]):
                ids, v = _matrix(rows)
                places, dims = np.nonzero(v)
                values = v[places, dims]
                order = np.argsort(-np.abs(values), kind="stable")
                ends = [int(len(order) * share) for share in SEGMENT_SHARES]
                for name, value in zip(out, (width, number, ids.tobytes(), dims[order].astype("<i4").tobytes(), places[order].astype("<i4").tobytes(), values[order].astype("<i8").tobytes(), ends)):
                    out[name].append(value)
            yield out

    gathered = dealt.groupBy("width", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    return checkpoint(map_batches(gathered, post, "width int, block long, ids binary, dims binary, places binary, values binary, ends array<int>"))


def _exact_type(queries: np.ndarray, largest: int) -> type:
    """The fastest type in which no sum of products is rounded."""
    most = int(np.abs(queries).sum(1).max(initial=0)) * largest
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray], ends: list[int], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of each query's best k in one block, its own row left out."""
    dims, places, values = postings
    n, width = len(ids), queries.shape[1]
    kind = _exact_type(queries, int(np.abs(values).max(initial=0)))
    whole = np.zeros((n, width), kind)
    whole[places, dims] = values
    q = queries.astype(kind)
    length = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    own = np.searchsorted(ids, query_ids)
    held = (own < n) & (ids[np.minimum(own, n - 1)] == query_ids)
    scores = np.zeros((len(q), n), kind)
    left2 = (whole.astype(np.float64) ** 2).sum(1)
    open_rows, begin, members = np.arange(len(q)), 0, {}
    for end in ends:
        part = np.zeros((n, width), kind)
        part[places[begin:end], dims[begin:end]] = values[begin:end]
        scores[open_rows] += q[open_rows] @ part.T
        left2 -= (part.astype(np.float64) ** 2).sum(1)
        begin, last = end, end == ends[-1]
        rest = np.zeros(n) if last else np.sqrt(np.maximum(left2, 0)) * (1 + 1e-9) + 1e-6
        still = []
        for row in open_rows.tolist():
            now = scores[row].astype(np.float64) if kind is not object else scores[row]
            if held[row]:
                now = now.copy()
                now[own[row]] = -np.inf
            if n <= k:
                found = np.arange(n)
            else:
                slack = rest * length[row]
                bound = np.partition(now - slack, n - k)[n - k]
                found = np.flatnonzero(now + slack >= bound)
            if last or len(found) <= max(RESCORE, k):
                members[row] = found
            else:
                still.append(row)
        open_rows = np.array(still, int)
        if not len(open_rows):
            break
    best = []
    for row in range(len(q)):
        found = members[row]
        found = found[found != own[row]] if held[row] else found
        exact = whole[found] @ q[row]
        order = np.lexsort((found, -exact.astype(np.int64)))[:k]
        best.append((int(query_ids[row]), ids[found[order]], exact[order].astype(np.int64)))
    return best


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, <key>, score): the best k rows of every query among all other rows. `is_query` is over column `id`."""
    prepare(vectors.sparkSession)
    rows = checkpoint(quantised(vectors, key, vector, scale))
    index = build_index(rows)
    blocks = checkpoint(index.groupBy("width").agg(F.collect_set("block").alias("blocks")))
    asked = rows.filter(is_query)
    sizes = checkpoint(asked.groupBy("width").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts")))
    grouped = asked.join(sizes, "width").groupBy("width", F.pmod(F.xxhash64("id", F.lit("query")), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    pairs = grouped.join(blocks, "width").select("width", "queries", F.explode("blocks").alias("block")).join(index, ["width", "block"])

    def search(batches):
        for batch in batches:
            out = {"query_id": [], "id": [], "score": []}
            for queries, ids, dims, places, values, ends in zip(*(batch[name] for name in ("queries", "ids", "dims", "places", "values", "ends"))):
                query_ids, q = _matrix(queries)
                postings = np.frombuffer(dims, "<i4"), np.frombuffer(places, "<i4"), np.frombuffer(values, "<i8")
                for query, found, scores in search_block(query_ids, q, np.frombuffer(ids, np.int64), postings, ends, k):
                    out["query_id"] += [query] * len(found)
                    out["id"] += found.tolist()
                    out["score"] += scores.tolist()
            yield out

    found = map_batches(pairs.drop("width", "block"), search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


SQL = """WITH e AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
        FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20"""
