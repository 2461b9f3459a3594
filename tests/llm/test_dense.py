"""Links between tight clusters that fill every neighbour list."""

import numpy as np

from panelspark.llm import nn_descent


def test_links_across_saturated_clusters(spark):
    rng = np.random.default_rng(8)
    centre = np.zeros(24)
    centre[0] = 1
    x = []
    for k in range(3):
        hub = centre + 0.2 * np.eye(24)[k + 1]  # hubs: cosine about 0.96 to each other
        x.append(hub + 0.004 * rng.standard_normal((220, 24)))
    x = np.concatenate(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    want = s.sum(1) - 1
    assert want.min() == len(x) - 1
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in nn_descent.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == want.tolist()
    assert {r.component_id for r in got.values()} == {0}


def test_recall_grows_by_round(spark):
    """Pairs hidden among 4,000 vectors: the starting lists hold few of them, the rounds find them."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((4000, 12))
    x[2000:] = x[:2000] + 0.3 * rng.standard_normal((2000, 12))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    got = {r.vec_id: r.n_links for r in nn_descent.near_duplicates(df, on_round=lambda r, g: seen.append(g.where("sim >= 0.9").count() / s.sum())).collect()}
    assert seen[0] < 0.85 and seen[-1] > 0.9 and sorted(seen) == seen
    assert all(got[i] <= n for i, n in enumerate(s.sum(1))) and sum(got.values()) >= 0.9 * s.sum()


def test_blocks_count_all_links(spark, monkeypatch):
    """Exact numbers in one loose clump: blocks wholly inside the threshold, wholly outside, and compared."""
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    rng = np.random.default_rng(4)
    hubs = [np.eye(8)[0] + w * np.eye(8)[k] for k, w in ((1, 0.0), (2, 0.35), (3, 0.6))]
    x = np.concatenate([h + 0.01 * rng.standard_normal((150, 8)) for h in hubs] + [hubs[0] + 0.2 * rng.standard_normal((200, 8))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(1, i, [float(v) for v in r], 1, 8) for i, r in enumerate(x)], "component long, rep long, vec array<double>, n long, dim int")
    links, joined = nn_descent._block_links(df, 0.9)
    assert {r.rep: r.links for r in links.collect() if r.links} == {i: n for i, n in enumerate(want.tolist()) if n} and joined.count() == 0
