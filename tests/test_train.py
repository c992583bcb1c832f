import numpy as np
import pytest

from sketchloom.operators import encode
from sketchloom.plans import train
from sketchloom.sources import vectors as source


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((500, 10)) @ rng.standard_normal((10, 10))).astype(np.float32)
    return source.from_numpy(spark, x).cache(), x.astype(float)


def mean_sim(x, centers):
    s = np.where(x @ centers.T >= 0, 1.0, -1.0)
    sim = train.similarity((len(x) + s.T @ s) / 2, len(x))
    return sim.sum() / (len(centers) * (len(centers) - 1))


def test_local_and_distributed_agree(data):
    df, x = data
    a = train.LocalTrainer(x, 8, scale=0.05, centers=x[:8], update_parallel=True, displace_parallel=True)
    b = train.DistributedTrainer(df, 8, scale=0.05, centers=x[:8], update_parallel=True, displace_parallel=True)
    assert np.array_equal(a.overlap_mat, b.overlap_mat) and a.overlap_mat[0, 0] == 500
    a.run(3), b.run(3)
    assert np.allclose(a.centers, b.centers) and np.array_equal(a.overlap_mat, b.overlap_mat)
    assert np.allclose(a.sim_sums, a.sim_mat.sum(1)) and b.n_dims == 10


def test_statistics_follow_the_centers_and_training_helps(data):
    _, x = data
    t = train.LocalTrainer(x, 10, scale=0.1, centers=x[:10], seed=2)
    before = mean_sim(x, t.centers)
    t.run(400)
    s = np.where(x @ t.centers.T >= 0, 1.0, -1.0)
    assert np.array_equal(t.overlap_mat, ((len(x) + s.T @ s) / 2).astype(int))
    assert mean_sim(x, t.centers) < 0.6 * before


def test_one_step_lowers_the_similarity_of_a_pair():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 2))
    t = train.LocalTrainer(x, 2, scale=0.5, centers=np.array([[1.0, 0.0], [0.9, 0.3]]))
    before = t.sim_mat[0, 1]
    t.step()
    assert t.sim_mat[0, 1] < before


def test_degenerate_input():
    same = np.ones((20, 3))
    for options in ({}, {"init_greedy": True}, {"init_ransac": True}):
        t = train.LocalTrainer(same, 4, **options, ransac_pairs_per_bit=5)
        t.run(3)
        assert np.isfinite(t.centers).all()
    parallel = train.LocalTrainer(np.eye(3), 2, centers=np.array([[1.0, 0, 0], [2.0, 0, 0]]))
    parallel.run(2)
    assert np.isfinite(parallel.centers).all()
    with pytest.raises(ValueError):
        train.LocalTrainer(same, 0)


def test_inits(data):
    df, x = data
    plain = mean_sim(x, x[:8])
    for t in (train.LocalTrainer(x, 8, init_ransac=True, seed=1), train.DistributedTrainer(df, 8, init_ransac=True, ransac_pairs_per_bit=60, ransac_sub_sample=300)):
        assert mean_sim(x, t.centers) < plain and np.allclose(np.linalg.norm(t.centers, axis=1), 1)
    for t in (train.LocalTrainer(x, 4, init_greedy=True), train.DistributedTrainer(df, 4, init_greedy=True)):
        assert np.allclose(np.linalg.norm(t.centers, axis=1), 1)
    t = train.DistributedTrainer(df, 6, seed=9)
    assert all(any(np.allclose(c, r) for r in x) for c in t.centers)
    pair = train.nearest_by_code(df.selectExpr("vec_id", "cast(embedding as array<double>) as v"), x[3:4], x[:6])
    code = x @ x[:6].T >= 0
    d = (code != code[3]).sum(1)
    d[3] = 99
    assert np.allclose(pair[1], x[int(np.argmin(d))])


def test_stochastic(data):
    df, x = data
    t = train.StochasticTrainer(df, 200, 10, 8, noise_std=0.01, scale=0.1, seed=3)
    t.run(45)
    assert t.n_samples == 5 and t.centers.shape == (8, 10) and t.overlap_mat.max() == 200
    assert train.StochasticTrainer(df, 200, 10, 8, noise_std=0.01, scale=0.1, seed=3).run(45).centers.tolist() == t.centers.tolist()
    assert t.encode(df, 8).count() == 500


def test_overlaps_from_transposed_bits(data):
    df, x = data
    codes = encode.encode(df, x[:12], 8)
    t = train.LocalTrainer(x, 12, centers=x[:12])
    for r in train.overlap_stats(codes, 12, 500, 8).collect():
        assert r["overlap"] == t.overlap_mat[r["i"], r["j"]] and abs(r["sim"] - t.sim_mat[r["i"], r["j"]]) < 1e-12
    assert np.allclose([r["sim_sum"] for r in train.sim_sums(train.overlap_stats(codes, 12, 500, 8)).orderBy("i").collect()], t.sim_sums)
