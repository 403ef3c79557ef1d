import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from faultline.operators import similarity as N
from faultline.operators.oversample import smote


def brute(q, c, k):
    out = {}
    norm = lambda v: v / (np.linalg.norm(v) or 1.0)
    for qi, qv in q:
        sims = [(-round(float(norm(qv) @ norm(cv)), 9) + 0.0, ci) for ci, cv in c]
        out[qi] = [(ci, -s + 0.0) for s, ci in sorted(sims)[:k]]
    return out


@pytest.mark.parametrize("block,pivots", [(1024, None), (16, 5), (7, 40)])
def test_topk_cosine_is_exact_with_copies_and_zero_vectors(spark, block, pivots):
    rng = np.random.default_rng(5)
    c = [(i, rng.normal(size=6)) for i in range(120)] + [(200 + i, np.ones(6)) for i in range(60)] + [(300, np.zeros(6)), (301, np.zeros(6))]
    q = [(i, rng.normal(size=6)) for i in range(25)] + [(50 + i, np.ones(6)) for i in range(10)] + [(90, np.zeros(6))]
    frame = lambda rows, name: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} long, embedding array<double>")
    got = {}
    for r in N.topk_cosine(frame(q, "query_id"), frame(c, "corpus_id"), 3, pivots=pivots, block=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.match_id, r.similarity))
    want = brute(q, c, 3)
    assert set(got) == set(want)
    for key, matches in want.items():
        assert [m for _, m, _ in sorted(got[key])] == [m for m, _ in matches], key
        assert np.allclose([s for *_, s in sorted(got[key])], [s for _, s in matches])


@pytest.mark.parametrize("floor", [0.85, 0.5])
def test_similar_texts_is_exact(spark, floor):
    rng = np.random.default_rng(6)
    def vector():
        idx = sorted(rng.choice(30, rng.integers(1, 6), replace=False))
        return {int(i): float(rng.integers(1, 4)) for i in idx}
    c = [(f"c{i:03d}", vector()) for i in range(150)] + [(f"d{i}", {1: 1.0, 2: 2.0}) for i in range(50)]
    q = [(f"q{i:03d}", vector()) for i in range(60)] + [("qd", {1: 1.0, 2: 2.0}), ("qe", {})]
    frame = lambda rows, name: spark.createDataFrame([(i, Vectors.sparse(30, v)) for i, v in rows], [name, "vec"])
    dense = lambda rows: [(i, np.array([v.get(t, 0.0) for t in range(30)])) for i, v in rows]
    want = {k: [(m, s) for m, s in v if s >= floor] for k, v in brute(dense(q), dense(c), 3).items()}
    got = {}
    for r in N.similar_texts(frame(q, "query_id"), frame(c, "corpus_id"), floor=floor, vector="vec", block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.match_id))
    assert {k: [m for _, m in sorted(v)] for k, v in got.items()} == {k: [m for m, _ in v] for k, v in want.items() if v}


def test_smote_balances_and_stays_between_neighbours(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=3)], 0 if i < 40 else 1) for i in range(52)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    got = smote(df, "id", "v", "y").collect()
    assert len(got) == 40 - 12 and {r.y for r in got} == {1}
    points = {i: np.array(v) for i, v, _ in rows}
    minority = [i for i, _, y in rows if y == 1]
    for r in got:
        near = sorted((np.sum((points[r.id] - points[j]) ** 2), j) for j in minority if j != r.id)[:5]
        assert r.neighbour_id in {j for _, j in near} and 0 <= r.share < 1
        assert np.allclose(r.v, points[r.id] + r.share * (points[r.neighbour_id] - points[r.id]))
    with pytest.raises(MemoryError):
        smote(df, "id", "v", "y", max_features=2)


def test_smote_takes_string_classes(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=3)], "big" if i < 20 else "small") for i in range(26)]
    got = smote(spark.createDataFrame(rows, "id long, v array<double>, y string"), "id", "v", "y").collect()
    assert len(got) == 14 and {r.y for r in got} == {"small"} and all(r.neighbour_id >= 20 for r in got)


def test_bounds_rule_out_blocks_of_clustered_vectors(spark):
    """40 clusters in 16 dimensions: the exact three nearest from a small part of the blocks."""
    from faultline.operators import dense_topk as D

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=16)).tolist(), i % 2) for i in range(1600)]
    asks = [(i, (centres[i % 40] + 0.05 * rng.normal(size=16)).tolist(), i % 2) for i in range(80)]
    frame = lambda r: spark.createDataFrame(r, "rep long, vec array<double>, grp int")
    found = D.nearest(frame(asks), frame(rows), 3, D.SQUARED, block=16)
    got = {}
    for r in found.pairs.collect():
        got.setdefault(r.query, []).append((r["rank"], r.match))
    for q, vec, grp in asks:
        d = sorted((round(float(((np.array(vec) - v) ** 2).sum()), 9), i) for i, v, g in rows if g == grp)[:3]
        assert [m for _, m in sorted(got[q])] == [i for _, i in d]
    assert found.visited < 0.25 * found.possible


@pytest.mark.parametrize("kind", ["cosine", "squared"])
def test_a_query_is_sent_once_to_a_part_not_to_each_block(spark, kind):
    """Vectors without structure: all blocks are visited, but what is sent grows with the parts; cells over many parts, two groups."""
    from faultline.operators import dense_topk as D

    rng = np.random.default_rng(3)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    rows = [(i, unit(rng.normal(size=8)), i % 2) for i in range(400)]
    asks = [(i, unit(rng.normal(size=8)), i % 2) for i in range(60)]
    frame = lambda r: spark.createDataFrame(r, "rep long, vec array<double>, grp int")
    sent, split = [], D.split_visitors
    try:
        D.split_visitors = lambda pairs, blocks, most: sent.append(pairs.select("query", "block").collect()) or split(pairs, blocks, most)
        found = D.nearest(frame(asks), frame(rows), 3, kind, block=8, pivots_wanted=4, cells_of_part=8 * 40)
    finally:
        D.split_visitors = split
    got = {}
    for r in found.pairs.collect():
        got.setdefault(r.query, []).append((r["rank"], r.match))
    for q, vec, grp in asks:
        score = lambda v: -float(np.dot(vec, v)) if kind == "cosine" else float(((np.array(vec) - v) ** 2).sum())
        d = sorted((round(score(v), 9), i) for i, v, g in rows if g == grp)[:3]
        assert [m for _, m in sorted(got[q])] == [i for _, i in d]
    pairs = [tuple(r) for step in sent for r in step]
    assert len(pairs) == len(set(pairs)) and len(pairs) < found.visited / 2
