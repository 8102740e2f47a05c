import numpy as np
from pyspark.sql import functions as F

from glyphloom.llm import vectors


def rows(seed=1, n=400, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[100:140] = x[0] + 0.05 * rng.standard_normal((40, dim))
    x[200:210] = x[1]
    data = [(i, [float(v) for v in r], "l") for i, r in enumerate(x.astype(np.float32))]
    return data + [(9001, None, "l"), (9002, [0.0] * dim, "l"), (9003, [float("nan")] * dim, "l"), (None, data[0][1], "l")], x.astype(np.float32).astype(float)


def test_near_duplicates_and_neighbours_against_brute_force(spark):
    data, x = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, n string")
    norm = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(norm, norm) >= 0.9
    np.fill_diagonal(near, False)
    label = vectors._settle(near)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert all(got[i] == (near[i].sum(), label[i], label[i] == i) for i in range(len(x)))
    assert got[9001] == got[9002][:1] + (9001, True) and got[None] == (0, None, False)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    found = {}
    for r in vectors.nearest(df, F.col("id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(found) == list(range(0, 400, 20))
    right = [len({v for _, v, _ in found[q]} & set(np.lexsort((np.arange(400), -score[q]))[:20].tolist())) for q in found]
    assert sum(right) >= 0.97 * 20 * len(found)


def pairs_at(cosine, n, dim, rng):
    """n unit vectors and, for each, one at this cosine to it."""
    x, y = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)


def test_trees_follow_depth():
    """Pairs at cosine 0.9 share a leaf of some tree, also as deep as trees over a billion vectors are (23 splits)."""
    assert [vectors.trees_for(d) for d in (0, 5, 9)] == [10, 10, 10] and vectors.trees_for(16) > 10
    a, b = pairs_at(0.9005, 100, 64, np.random.default_rng(2))
    met = np.zeros(100, bool)
    for k in range(vectors.trees_for(23)):
        t = vectors.Tree(k, np.zeros((0, 64)), 23)
        for _, r in t.leaves(np.concatenate([a, b])):
            met[np.intersect1d(r[r < 100], r[r >= 100] - 100)] = True
    assert met.mean() >= 0.95


def test_recall_over_many_vectors(spark):
    rng = np.random.default_rng(4)
    a, b = pairs_at(0.9005, 200, 64, rng)
    x = np.concatenate([a, b, rng.standard_normal((19_600, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in vectors.near_duplicates(df).where("n_links > 0").collect()}
    assert sum(got.get(200 + i) == i for i in range(200)) >= 0.95 * 200 and all(v < 200 for v in got.values())


def test_dimensions_ties_repeated_rows_and_empty_tables(spark):
    """Vectors meet those of their own dimension; equal scores go by the smaller id; rows repeated under one id are one vector."""
    data = [(i, [1.0, float(i % 2)]) for i in range(6)] + [(0, [1.0, 0.0])] + [(10, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 3.1]), (12, [-3.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, n string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    even, odd = [(i, 2, 0, i == 0) for i in (0, 0, 2, 4)], [(i, 2, 1, i == 1) for i in (1, 3, 5)]
    assert got == sorted(even + odd + [(10, 1, 10, True), (11, 1, 10, False), (12, 0, 12, True)])
    near = sorted((r.query_id, r.rank, r.vec_id) for r in vectors.nearest(df, F.col("id") % 10 == 0, k=3).collect())
    assert near == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (10, 1, 11), (10, 2, 12)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0 and vectors.nearest(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_neighbours_that_share_their_code(spark):
    """A dense group of long vectors has nearly one code, whose error is the same for all of it: none of them may be missed for that."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 16))
    x[:600] = 8 * rng.standard_normal(16) + 0.3 * rng.standard_normal((600, 16))
    x[600:620] = x[0]
    order = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(order, x)], "vec_id long, embedding array<double>")
    y = x[np.argsort(order)]
    score = np.stack([(y * v).sum(1) for v in y])
    np.fill_diagonal(score, -np.inf)
    found = {}
    for r in vectors.nearest(df, F.col("id") % 20 == 0).collect():
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in range(0, 3000, 20):
        assert [found[q][i] for i in range(1, 21)] == np.lexsort((np.arange(3000), -score[q]))[:20].tolist(), q
