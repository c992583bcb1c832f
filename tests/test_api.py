import numpy as np

from sketchloom.operators.encode import pack_bits
from sketchloom.plans.api import SketchSearch


def test_matrices_in_tables_out(spark):
    rng = np.random.default_rng(0)
    x, c = rng.standard_normal((200, 6)), rng.standard_normal((64, 6))
    codes = pack_bits((x @ c.T >= 0).astype(np.uint8), 64)
    s = SketchSearch(spark)
    q, qc = x[:5], codes[:5]
    truth = s.k_largest_dot(x, q, 4)
    ids = np.array([[r["neighbor_id"] for r in truth.where(f"query_id = {i}").orderBy("rank").collect()] for i in range(5)])
    assert np.array_equal(ids, np.argsort(-(q @ x.T), axis=1)[:, :4])
    assert s.query(x, codes, q, qc, 4, 200).select("query_id", "rank", "neighbor_id").exceptAll(truth.select("query_id", "rank", "neighbor_id")).count() == 0
    assert s.query_cascade(x, [codes, codes], q, [qc, qc], 4, [50, 20]).count() == 20
    assert s.recall(ids, ids) == 1.0 == s.recall_of_codes(codes, qc, ids, 200) == s.recall_of_predictions(x, q, ids, 4) == s.recall_end_to_end(x, codes, q, qc, 4, 200)
    assert s.refine(x, q, ids[:, ::-1], 2).count() == 10 and s.refine_with_other_code(codes, qc, ids, 1).count() == 5
    assert s.cascade_hamming([codes], [qc], [3]).count() == 15
    i = s.index(codes, 16, 4, 64)
    assert i.knn(s.codes(qc), 1).where("dist = 0 and neighbor_id = query_id").count() == 5 and s.parallelism >= 1
    t = s.trainer(x, 4, scale=0.02).run(2)
    assert s.encode(x, t.centers, 8).count() == 200
    assert s.stochastic_trainer(x, 50, 5, 4, scale=0.1).run(12).n_samples == 3
