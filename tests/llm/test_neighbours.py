import numpy as np
import pyarrow as pa

from foliant.llm import neighbours


def test_hilbert_is_a_walk_through_all_cells():
    for d, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), -1).reshape(-1, d)
        k = neighbours.hilbert_keys(cells, bits)
        assert sorted(k.tolist()) == list(range(side**d))
        walk = cells[np.argsort(k)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def exact(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {int(ids[i]): [int(ids[j]) for j in sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 6), ids[j])) if j != i][:k] for i in range(len(ids))}, s


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((150, 64))
    x = np.concatenate([centres + 0.25 * r.standard_normal((150, 64)) for _ in range(8)] + [r.standard_normal((800, 64))]).astype(np.float32)
    ids = r.permutation(len(x)) + 10
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "chunk_id long, embedding array<float>")
    got = {}
    for row in neighbours.nearest(df, "chunk_id", "embedding").collect():
        got.setdefault(row["id"], []).append(row["neighbour"])
    want, s = exact(x.astype(np.float64), ids, 5)
    close = {int(ids[i]) for i in range(1200)}
    hits = sum(len(set(got[i]) & set(want[i])) for i in close)
    assert set(got) == set(want) and hits >= 0.98 * 5 * len(close)


def test_copies_bad_vectors_and_small_sets(spark):
    v = [1.0] + [0.0] * 63
    w = [0.9, 0.1] + [0.0] * 62
    rows = [(i, v) for i in range(1, 9)] + [(1, v), (20, w), (21, [0.0] * 64), (22, None), (23, [1.0]), (24, [float("nan")] * 64), (25, [float("inf")] + [0.0] * 63), (None, v), (26, [None] * 64)]
    df = spark.createDataFrame([(a, b, "m") for a, b in rows], "chunk_id long, embedding array<float>, id string")
    got = {}
    for r in neighbours.nearest(df, "chunk_id", "embedding").orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert set(got) == {*range(1, 9), 20}
    assert got[1] == [2, 3, 4, 5, 6] and got[8] == [1, 2, 3, 4, 5] and got[20] == [1, 2, 3, 4, 5]
    assert neighbours.nearest(df.where("chunk_id = 20"), "chunk_id", "embedding").count() == 0
    assert neighbours.nearest(df.where("false"), "chunk_id", "embedding").count() == 0


def test_dense_cluster_is_found(spark):
    r = np.random.default_rng(1)
    centre = r.standard_normal(64)
    for spread, n in ((0.25, 4_000), (1e-3, 4_000)):  # a third of the rows
        x = np.concatenate([centre + spread * r.standard_normal((n, 64)), r.standard_normal((2 * n, 64))]).astype(np.float32)
        df = spark.createDataFrame(pa.table({"chunk_id": np.arange(3 * n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}))
        got = {}
        for row in neighbours.nearest(df, "chunk_id", "embedding").collect():
            got.setdefault(row["id"], set()).add(row["neighbour"])
        u = x.astype(np.float64)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        asked = r.choice(n, 300, replace=False)
        s = u[asked] @ u.T
        s[np.arange(300), asked] = -2
        best = np.argsort(-s, axis=1)[:, :5]
        assert sum(len(got[int(i)] & set(b.tolist())) for i, b in zip(asked, best)) >= 0.97 * 1_500  # windows are planned by a sample
        assert set(got) == set(range(3 * n))


def test_plan_is_the_cheapest_that_holds_enough():
    apart = np.array([[10_000] * 50 + [5] * 950, [5] * 100 + [20_000] * 900])
    assert neighbours.choose_plan(apart, 100_000, 0.999)[0] == 2
    assert neighbours.choose_plan(apart, 100_000, 0.9) == (1, neighbours.LEAST_WINDOW)
    assert neighbours.choose_plan(apart[:1], 3_000, 0.999) == (1, 3_000)
