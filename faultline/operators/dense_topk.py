"""Exact nearest neighbours of dense vectors by two-level cells, visited best first.

Pivots, four times the square root of the number of blocks, are drawn from the corpus. A row's cell is its nearest pivot;
inside a cell rows are ordered by their second nearest pivot and their distance, and cut into blocks of like rows. A cell
knows the range of its rows' distances from the pivot, a block its centroid and radius: by the triangle inequality both
bound the distance from a query to any of its rows. Cells are dealt to parts of a fixed number of numbers. A query goes to the
part of its nearest cell first; the k-th distance found there rules out cells, and the query goes once to every part that has
one left. In a part queries meet all blocks in one task, many queries together; each visits its blocks best first and leaves out
those whose bound no longer reaches its k-th score. So a vector is sent once a part, never once a block, and pairs of a query
and a block are never rows. On data without any structure (many dimensions, no clusters) no bound rules out much, and nearly
all blocks are visited; that is exact, but as dear as comparing all.

To the driver come the pivots and the cells' ranges: they grow with the square root of the corpus, times the groups."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .best_first import FACTOR, FIRST, best_k, split_visitors

#: Rows of a block, and digits of a score (so that ties do not hang on the order of additions).
BLOCK, DIGITS = 256, 9
#: Numbers in the vectors of a part; queries that visit it together have half as many.
CELLS = 1 << 20
#: For rounding errors of a distance, and of a rounded score.
NEAR, SLACK = 1e-7, 2e-9
COSINE, SQUARED = "cosine", "squared"


class Found(NamedTuple):
    """pairs: (query, rank, match, score). visited: (query, block) pairs that were scored, of `possible`."""

    pairs: DataFrame
    visited: int
    possible: int


def _matrix(vectors: pa.Array | pd.Series) -> np.ndarray:
    return np.array(vectors.to_pylist() if isinstance(vectors, (pa.Array, pa.ChunkedArray)) else vectors.to_list(), dtype=np.float64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x ** 2).sum(1)[:, None] + (y ** 2).sum(1)[None, :] - 2 * x @ y.T, 0.0))


def _score_of(distance: np.ndarray, kind: str) -> np.ndarray:
    """The best score that rows at this distance or farther can have."""
    low = np.maximum(distance - NEAR, 0.0) ** 2
    return 1 - low / 2 if kind == COSINE else -low


def _blocks(corpus: DataFrame, pivots: np.ndarray, block: int, id_type: str) -> DataFrame:
    """One row per block of (rep, vec, grp): grp, cell, reps in order, rows, centroid, radius and range of distances from the pivot."""
    @F.pandas_udf("cell int, second int, dist double")
    def place(vec: pd.Series) -> pd.DataFrame:
        if not len(vec):
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "second": pd.Series(dtype="int32"), "dist": pd.Series(dtype="float64")})
        d = _distances(_matrix(vec), pivots)
        order = np.argsort(d, axis=1, kind="stable")
        return pd.DataFrame({"cell": order[:, 0].astype(np.int32), "second": order[:, min(1, len(pivots) - 1)].astype(np.int32), "dist": d[np.arange(len(d)), order[:, 0]]})

    placed = corpus.withColumn("p", place("vec")).select("rep", "vec", "grp", "p.*")
    key = ["grp", "cell", "second", "dist", "rep"]
    ordered = placed.repartitionByRange(*key).sortWithinPartitions(*key)
    ddl = f"grp int, cell int, reps array<{id_type}>, rows binary, centroid binary, radius double, near double, far double"

    def pack(batches):
        held = pd.DataFrame()

        def made(rows: pd.DataFrame) -> pd.DataFrame:
            x = _matrix(rows.sort_values("rep", kind="stable").vec)
            c = x.mean(0)
            return pd.DataFrame({"grp": [rows.grp.iloc[0]], "cell": [rows.cell.iloc[0]], "reps": [rows.rep.sort_values(kind="stable").tolist()], "rows": [x.tobytes()],
                                 "centroid": [c.tobytes()], "radius": [_distances(x, c[None, :]).max()], "near": [rows.dist.min()], "far": [rows.dist.max()]})

        for batch in batches:
            held = pd.concat([held, batch], ignore_index=True)
            while len(held):
                other = np.flatnonzero((held.grp != held.grp.iloc[0]) | (held.cell != held.cell.iloc[0]))
                size = min(block, int(other[0]) if len(other) else block)
                if size == len(held) or size > len(held):
                    break
                yield made(held[:size])
                held = held[size:].reset_index(drop=True)
        if len(held):
            yield made(held)

    return ordered.mapInPandas(pack, ddl).withColumn("block", F.monotonically_increasing_id())


def _rows(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """As _matrix, without a Python number for each component."""
    vectors = vectors.combine_chunks()
    if vectors.null_count or (np.diff(vectors.offsets.to_numpy()) != width).any():
        raise ValueError(f"every vector needs {width} components")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def _scores(q: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    return q @ x.T if kind == COSINE else -(_distances(q, x) ** 2)


def _visit_part(q: np.ndarray, least: np.ndarray, blocks: list[np.ndarray], places: list[np.ndarray], centroids: np.ndarray, radii: np.ndarray,
                k: int, kind: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, places, visited): the k best rows of the blocks for each query, as far as they reach its `least`; the place of a
    row is its rank by id, the smaller of equal scores comes first. Every query takes its blocks in order of their bound, more of
    them each round."""
    bound = _score_of(np.maximum(_distances(q, centroids) - radii, 0), kind)
    turn = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
    best, at, floor = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max), least.copy()
    visited, low, high = 0, 0, FIRST
    while low < len(blocks):
        for j, x in enumerate(blocks):
            asking = np.flatnonzero((turn[:, j] >= low) & (turn[:, j] < high) & (bound[:, j] >= floor - SLACK))
            visited += len(asking)
            if not len(asking):
                continue
            s = _scores(q[asking], x, kind)
            better = s.max(1) >= floor[asking] - SLACK
            asking, s = asking[better], np.round(s[better], DIGITS) + 0.0
            own = np.argsort(-s, axis=1, kind="stable")[:, :k]                 # rows are in order of id: the smaller of equals
            scores, ids = np.hstack([best[asking], np.take_along_axis(s, own, 1)]), np.hstack([at[asking], places[j][own]])
            order = np.lexsort((ids, -scores), axis=1)[:, :k]
            best[asking], at[asking] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
            floor[asking] = np.maximum(floor[asking], best[asking, -1])
        low, high = high, high * FACTOR
    best[best < least[:, None] - SLACK] = -np.inf
    return best, at, visited


def nearest(queries: DataFrame, corpus: DataFrame, k: int, kind: str, block: int | None = None, pivots_wanted: int | None = None, cells_of_part: int = CELLS) -> Found:
    """Both frames: rep, vec array<double>, grp int, one row per distinct vector. The k best rows of every query's group."""
    block = block or BLOCK
    id_type, query_type = dict(corpus.dtypes)["rep"], dict(queries.dtypes)["rep"]
    n = corpus.count()
    wanted = pivots_wanted or 4 * math.isqrt(-(-max(n, 1) // block))
    pivots = _matrix(pd.Series([r.vec for r in corpus.select("vec", "rep").orderBy(F.xxhash64("rep"), "rep").limit(wanted).collect()]))
    if not n:
        return Found(corpus.sparkSession.createDataFrame([], f"query {query_type}, rank int, match {id_type}, score double"), 0, 0)
    width = pivots.shape[1]
    blocks = checkpoint(_blocks(corpus, pivots, block, id_type))
    # Cells are packed to parts in turn, none over two groups; a cell that is larger has several parts to itself.
    part_rows, cells, dealt, part, room = max(block, cells_of_part // max(width, 1)), {}, [], -1, 0
    found = blocks.groupBy("grp", "cell").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.sum(F.size("reps")).alias("n")).collect()
    for r in sorted(found, key=lambda r: (r.grp, r.cell)):
        own = cells.setdefault(r.grp, [])
        if not own or r.n > room:
            part, room = part + 1, part_rows
        slots = -(-r.n // part_rows)
        own.append((r.cell, r.near, r.far, part, slots))
        dealt.append((r.grp, r.cell, part, slots))
        part, room = part + slots - 1, room - r.n
    cells = {g: tuple(np.array(x) for x in zip(*rows)) for g, rows in cells.items()}

    def to_visit(nearest_only: bool):
        @F.pandas_udf("array<int>")
        def udf(vec: pd.Series, grp: pd.Series, least: pd.Series) -> pd.Series:
            out = np.empty(len(vec), object)
            d = _distances(_matrix(vec), pivots) if len(vec) else None
            for g in grp.unique():
                own = np.flatnonzero(grp.to_numpy() == g)
                ids, near, far, first, slots = cells.get(g, (np.empty(0, int),) * 5)
                if not len(ids):
                    out[own] = [[]] * len(own)
                    continue
                at = d[np.ix_(own, ids)]
                if nearest_only:
                    for i, home in zip(own, first[at.argmin(1)]):
                        out[i] = [int(home)]
                    continue
                reach = _score_of(np.maximum(np.maximum(at - far, near - at), 0), kind) >= least.to_numpy()[own, None] - SLACK
                for i, row in zip(own, reach):
                    out[i] = sorted({p for a, n in zip(first[row].tolist(), slots[row].tolist()) for p in range(a, a + n)})
            return pd.Series(out)
        return udf

    asked = queries.select(F.col("rep").alias("query"), "vec", "grp")
    parts = F.broadcast(corpus.sparkSession.createDataFrame(dealt, "grp int, cell int, first int, slots int"))
    of_part = (F.col("first") + F.pmod(F.xxhash64("block"), F.col("slots"))).cast("int").alias("block")
    held = blocks.join(parts, ["grp", "cell"]).select(of_part, "reps", "rows", "centroid", "radius")
    ddl = f"query {query_type}, match {id_type}, score double, visited long"
    fields = _schema(ddl)

    def visit(pairs: DataFrame) -> DataFrame:
        """The best of (query, vec, least, block) pairs, where block is a part, and a row with the number of visits for each task's group."""
        left, right = split_visitors(pairs, held, max(block, cells_of_part // 2 // max(width, 1)))

        def score(ask: pa.Table, own: pa.Table) -> pa.Table:
            if not ask.num_rows or not own.num_rows:
                return fields.empty_table()
            ids = own.column("reps").combine_chunks().flatten()
            place = np.empty(len(ids), np.int64)
            by = pc.sort_indices(ids).to_numpy()
            place[by] = np.arange(len(ids))
            matrices = [np.frombuffer(r).reshape(-1, width) for r in own.column("rows").to_pylist()]
            places = np.split(place, np.cumsum([len(x) for x in matrices])[:-1])
            centroids = np.stack([np.frombuffer(c) for c in own.column("centroid").to_pylist()])
            q = _rows(ask.column("vec"), width)
            best, at, visited = _visit_part(q, ask.column("least").to_numpy(), matrices, places, centroids, own.column("radius").to_numpy(), k, kind)
            i, j = np.nonzero(best > -np.inf)
            names, matches = ask.column("query").combine_chunks().take(pa.array(i)), ids.take(pa.array(by[at[i, j]]))
            columns = [names.cast(fields[0].type), matches.cast(fields[1].type), pa.array(best[i, j]), pa.nulls(len(i), pa.int64())]
            count = [pa.nulls(1, f.type) for f in fields][:3] + [pa.array([visited], pa.int64())]
            return pa.concat_tables([pa.Table.from_arrays(c, schema=fields) for c in (columns, count)])

        keys = ["block", "part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, ddl)

    worst = -1e300
    seen = checkpoint(asked.select("query", F.explode(to_visit(True)("vec", "grp", F.lit(worst))).alias("block")))
    first = checkpoint(visit(asked.join(seen, "query").select("query", "vec", F.lit(worst).alias("least"), "block")))
    ranked = lambda rows: best_k(rows.filter("visited is null").select("query", "match", "score"), ["query"], k, F.desc("score"), F.col("match"))
    least = ranked(first).filter(F.col("rank") == k).select("query", F.col("score").alias("least"))
    going = asked.join(least, "query", "left").na.fill({"least": worst})
    pairs = checkpoint(going.select("query", "least", F.explode(to_visit(False)("vec", "grp", "least")).alias("block")).join(seen, ["query", "block"], "left_anti"))
    rest = checkpoint(visit(pairs.join(asked.select("query", "vec"), "query").select("query", "vec", "least", "block")))
    both = first.unionByName(rest)
    best = checkpoint(ranked(both))
    return Found(best, both.agg(F.sum("visited")).first()[0] or 0, asked.count() * blocks.count())


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
