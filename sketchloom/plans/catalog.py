"""The registered queries over the `embeddings` table, and the SQL that checks them.

Deterministic variants: centers are the data rows with the first ids (a trainer accepts given centers), queries are the rows
whose id is divisible by 100, codes have 32-bit words, and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, vectors
from ..operators import encode, index, knn, recall, sampling
from ..sources import hdf5
from ..sources import vectors as source
from ..sources.scratch import scratch_dir
from ..streaming import encode as streaming
from . import train
from .api import SketchSearch

W = 32
LAYER, FANOUT = 16, 4


def _data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.read_vectors(spark, f"{sf_dir}/embeddings.parquet")


def _asked(df: DataFrame) -> DataFrame:
    return df.where(F.col("vec_id") % 100 == 0)


def _codes(data: DataFrame, n_bits: int = 64, first: int = 0) -> DataFrame:
    centers = encode.center_matrix(encode.centers_of(data, n_bits, first))
    return encode.encode(data, centers, W, keep=["vec_id"])


def _pair(data: DataFrame, n_bits: int = 64, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """Codes of all rows, and of the queries: those are filtered before they are encoded."""
    centers = encode.center_matrix(encode.centers_of(data, n_bits, first))
    return encode.encode(data, centers, W, keep=["vec_id"]), encode.encode(_asked(data), centers, W, keep=["vec_id"])


def dot_topk(spark, sf_dir):
    d = _data(spark, sf_dir)
    return knn.k_largest_dot(d, _asked(d), 10).withColumn("dot", F.round("dot", 6))


def dot_topk_sql(spark, sf_dir):
    d = _data(spark, sf_dir)
    return knn.k_largest_dot(d, _asked(d), 10, method="sql").withColumn("dot", F.round("dot", 6))


def _words(codes: DataFrame) -> DataFrame:
    return codes.select("vec_id", F.get("code", F.lit(0)).alias("w0"), F.get("code", F.lit(1)).alias("w1"))


def encode_arrow(spark, sf_dir):
    return _words(_codes(_data(spark, sf_dir)))


def encode_plan(spark, sf_dir):
    d = _data(spark, sf_dir)
    return _words(encode.encode_join(d, encode.centers_of(d, 64), W))


def encode_literal(spark, sf_dir):
    d = _data(spark, sf_dir)
    c = encode.center_matrix(encode.centers_of(d, 8))
    return d.select("vec_id", F.get(encode.encode_expr(F.col("embedding"), c, 8), F.lit(0)).alias("w0"))


def bit_ops(spark, sf_dir):
    d = _data(spark, sf_dir)
    c = _codes(d).join(_codes(d, 64, 64).withColumnRenamed("code", "other"), "vec_id")
    a, b, i = F.col("code"), F.col("other"), (F.col("vec_id") % 70).cast("int")
    word = lambda x, k, name: F.get(x, F.lit(k)).alias(name)
    return c.select(
        "vec_id",
        F.coalesce(bits.get_bit(a, i, W).cast("int"), F.lit(-1)).alias("bit"),  # -1: outside the code
        word(bits.set_bit(a, i, True, W), 0, "set0"),
        word(bits.set_true(a, i, W), 1, "set1"),
        word(bits.set_false(a, i, W), 1, "unset1"),
        word(bits.flip_bit(a, i, W), 0, "flip0"),
        bits.count_bits(a).cast("long").alias("ones"),
        bits.hamming(a, b).cast("long").alias("dist"),
        bits.bit_dot(a, b).cast("long").alias("both"),
        word(bits.or_code(a, b), 0, "or0"),
        word(bits.and_code(a, b), 0, "and0"),
        word(bits.xor_code(a, b), 1, "xor1"),
        word(bits.not_code(a, W), 1, "not1"),
        bits.size_bits(a, W).alias("size"),
        word(bits.zeros(40, W), 1, "zero1"),
        word(bits.ones(40, W), 1, "one1"),
    )


def bit_ops_mixed(spark, sf_dir):
    d = _data(spark, sf_dir)
    c = _codes(d).join(encode.encode(d, encode.center_matrix(encode.centers_of(d, 48, 64)), 8, code="other", keep=["vec_id"]), "vec_id")
    a, b = F.col("code"), F.col("other")
    return c.select(
        "vec_id",
        bits.hamming_mixed(a, W, b, 8).cast("long").alias("dist"),
        bits.bit_dot_mixed(a, W, b, 8).cast("long").alias("both"),
        F.get(bits.or_mixed(a, b, W, 8, 16), F.lit(3)).alias("or3"),
        F.get(bits.and_mixed(a, b, W, 8, 16), F.lit(1)).alias("and1"),
        F.get(bits.xor_mixed(a, b, W, 8, W), F.lit(0)).alias("xor0"),
        F.get(bits.not_mixed(b, 8, 16), F.lit(2)).alias("not2"),
        F.get(bits.repack(a, W, 8), F.lit(7)).alias("byte7"),
    )


def popcount_range(spark, sf_dir):
    c = _codes(_data(spark, sf_dir))
    lo, hi = (F.col("vec_id") % 60).cast("int"), (F.col("vec_id") % 60 + F.col("vec_id") % 7).cast("int")
    return c.select("vec_id", F.coalesce(bits.count_bits_range(F.col("code"), lo, hi, W), F.lit(-1)).cast("long").alias("ones"), bits.count_bits_range_unchecked(F.col("code"), 5, 40, W).cast("long").alias("middle"))


def hamming_topk(spark, sf_dir):
    return knn.k_smallest_hamming(*_pair(_data(spark, sf_dir)), 20)


def hamming_topk_sql(spark, sf_dir):
    return knn.k_smallest_hamming(*_pair(_data(spark, sf_dir)), 20, method="sql")


def _stages(d):
    return [_pair(d, 32), _pair(d, 64, 32)]


def hamming_cascade(spark, sf_dir):
    return knn.cascade_hamming(_stages(_data(spark, sf_dir)), [100, 20])


def refine_dot(spark, sf_dir):
    d = _data(spark, sf_dir)
    return knn.refine_dot(d, _asked(d), knn.k_smallest_hamming(*_pair(d), 50), 10).withColumn("dot", F.round("dot", 6))


def refine_code(spark, sf_dir):
    d = _data(spark, sf_dir)
    (one, q1), (two, q2) = _stages(d)
    return knn.refine_code(two, q2, knn.k_smallest_hamming(one, q1, 50), 10)


def query_single(spark, sf_dir):
    d = _data(spark, sf_dir)
    c, q = _pair(d)
    return knn.query(d, c, _asked(d), q, 10, 50).withColumn("dot", F.round("dot", 6))


def query_cascade(spark, sf_dir):
    d = _data(spark, sf_dir)
    s = _stages(d)
    return knn.query_cascade(d, [a for a, _ in s], _asked(d), [b for _, b in s], 10, [100, 30]).withColumn("dot", F.round("dot", 6))


def _rounded(df):
    return df.withColumn("recall", F.round("recall", 9))


def recall_pairs(spark, sf_dir):
    d = _data(spark, sf_dir)
    return _rounded(recall.recall(knn.k_largest_dot(d, _asked(d), 10), knn.k_smallest_hamming(*_pair(d), 50)))


def recall_codes(spark, sf_dir):
    d = _data(spark, sf_dir)
    return _rounded(recall.recall_of_codes(*_pair(d), knn.k_largest_dot(d, _asked(d), 10), 50))


def recall_predictions(spark, sf_dir):
    d = _data(spark, sf_dir)
    return _rounded(recall.recall_of_predictions(d, _asked(d), knn.k_smallest_hamming(*_pair(d), 50), 10))


def recall_end_to_end(spark, sf_dir):
    d = _data(spark, sf_dir)
    c, q = _pair(d)
    return _rounded(recall.recall_end_to_end(d, c, _asked(d), q, 10, 50))


def _index(d):
    return index.CodeIndex.build(_codes(d), LAYER, FANOUT, 64, W)


def index_assign(spark, sf_dir):
    t = _index(_data(spark, sf_dir)).table
    return t.select("vec_id", "leaf_id", *[F.get("path", F.lit(i)).alias(f"b{i}") for i in range(4)])


def index_nodes(spark, sf_dir):
    n = _index(_data(spark, sf_dir)).node_counts()
    return n.select("depth", F.array_join(F.col("prefix").cast("array<string>"), ",").alias("prefix"), "n")


def index_knn(spark, sf_dir):
    d = _data(spark, sf_dir)
    return _index(d).knn(_pair(d)[1], 20)


def index_range(spark, sf_dir):
    d = _data(spark, sf_dir)
    return _index(d).within(_pair(d)[1], 24)


def index_cost(spark, sf_dir):
    d = _data(spark, sf_dir)
    return _index(d).knn_cost(_pair(d)[1], 20)


def index_tree(spark, sf_dir):
    """Every node of a complete tree of height 3: its parent (-1: none), place below it, depth, and whether it is a leaf."""
    row = lambda x: (x, index.parent_of(x, FANOUT) if not index.is_root(x) else -1, index.child_index_of(x, FANOUT) if x else -1, index.depth_of(x, FANOUT), index.is_leaf(x, 3, FANOUT), index.child_of(x, 2, FANOUT))
    return spark.createDataFrame([row(x) for x in range(index.n_nodes(48, LAYER, FANOUT))], "node int, parent int, place int, depth int, leaf boolean, third int")


def overlap_stats(spark, sf_dir):
    d = _data(spark, sf_dir)
    return train.overlap_stats(_codes(d), 64, d.count(), W).withColumn("sim", F.round("sim", 9))


def sim_sums(spark, sf_dir):
    d = _data(spark, sf_dir)
    return train.sim_sums(train.overlap_stats(_codes(d), 64, d.count(), W)).withColumn("sim_sum", F.round("sim_sum", 6))


def _given(d, n_bits=16, **options):
    return train.DistributedTrainer(d, n_bits, centers=encode.center_matrix(encode.centers_of(d, n_bits)), **options)


def _center_rows(spark, centers):
    rows = [(i, k, float(x)) for i, c in enumerate(centers) for k, x in enumerate(c)]
    return spark.createDataFrame(rows, "bit_idx int, dim int, value double").withColumn("value", F.round("value", 6))


def train_step(spark, sf_dir):
    """One step in parallel mode, every center relative to the one it is most similar to."""
    return _center_rows(spark, _given(_data(spark, sf_dir), scale=0.1, update_parallel=True).run(1).centers)


def train_step_all(spark, sf_dir):
    """One step in which every center moves relative to all others."""
    return _center_rows(spark, _given(_data(spark, sf_dir), scale=0.1, update_parallel=True, displace_parallel=True).run(1).centers)


def train_run(spark, sf_dir):
    """Three steps of the default mode: one center of the most similar pair moves."""
    return _center_rows(spark, _given(_data(spark, sf_dir), scale=0.1).run(3).centers)


def stochastic_run(spark, sf_dir):
    """Two steps, each over a sample of its own."""
    d = _data(spark, sf_dir)
    centers = encode.center_matrix(encode.centers_of(d, 16))
    return _center_rows(spark, train.StochasticTrainer(d, 200, 1, 16, seed=1, centers=centers, scale=0.1, update_parallel=True).run(2).centers)


def ransac_init(spark, sf_dir):
    return _center_rows(spark, train.DistributedTrainer(_data(spark, sf_dir), 4, init_ransac=True, ransac_pairs_per_bit=5, ransac_sub_sample=200).centers)


def greedy_init(spark, sf_dir):
    return _center_rows(spark, train.DistributedTrainer(_data(spark, sf_dir), 3, init_greedy=True).centers)


def train_gain(spark, sf_dir):
    """Mean similarity of two bits before and after training; sampled noise, so without SQL."""
    d = _data(spark, sf_dir)
    off = lambda t: float(t.sim_mat.sum() / (t.n_bits * (t.n_bits - 1)))
    make = lambda: train.StochasticTrainer(d, 300, 64, 32, noise_std=0.001, scale=0.1, seed=1)
    return spark.createDataFrame([(off(make()), off(make().run(300)))], "mean_before double, mean_after double")


def greedy_pair(spark, sf_dir):
    """The data row nearest to row 0 by its code, other than itself: the choice that greedy initialisation makes."""
    c = _codes(_data(spark, sf_dir))
    near = knn.k_smallest_hamming(c, c.where("vec_id = 0"), 2)
    return near.where("neighbor_id <> 0").agg(F.min(F.struct("dist", "neighbor_id")).alias("m")).select("m.neighbor_id", "m.dist")


def epoch_sample(spark, sf_dir):
    """Draws over one epoch and a half, in their order."""
    d = _data(spark, sf_dir)
    n = d.count()
    return sampling.draw(d, 0, n + n // 2, seed=3)


def kernels(spark, sf_dir):
    d = _data(spark, sf_dir)
    row0 = encode.center_matrix(encode.centers_of(d, 1))[0]
    a, b = F.col("embedding"), F.array(*[F.lit(float(x)) for x in row0])
    eye = [[float(i == j) + 0.25 * float(abs(i - j) == 1) for j in range(len(row0))] for i in range(len(row0))]
    zero = F.array_repeat(F.lit(0.0), len(row0))
    cols = {
        "prod": vectors.dot(a, b),
        "self_prod": vectors.self_prod(a),
        "dist": vectors.induced_dist(a, F.transform(b, lambda x: x + F.lit(0.5))),
        "cos": vectors.cos_sim(a, b),
        "cos_dist": vectors.cosine_distance(a, b),
        "rbf": vectors.rbf(2.0)(a, b),
        "mahalanobis": vectors.mahalanobis(eye)(a, b),
        "poly": vectors.poly(0.5, 1.0, 3.0)(a, b),
        "sigmoid": vectors.sigmoid(0.5, 0.1)(a, b),
        "induced": vectors.induced_product(vectors.induced_dist, zero)(a, b),
    }
    return d.select("vec_id", *[F.round(c, 6).alias(k) for k, c in cols.items()])


def cross_prods(spark, sf_dir):
    d = _data(spark, sf_dir)
    out = vectors.cross_prods(_asked(d), d, "vec_id", "vec_id", "embedding", "embedding")
    return out.groupBy("left_id").agg(F.count("*").alias("n"), F.round(F.sum("prod"), 5).alias("total"))


def zip_prods(spark, sf_dir):
    """Each row with the one whose id is one less."""
    d = _data(spark, sf_dir)
    return vectors.zip_prods(d, d.select((F.col("vec_id") + 1).alias("vec_id"), "embedding"), "embedding", "embedding", "vec_id").withColumn("prod", F.round("prod", 6))


def normalise(spark, sf_dir):
    d = _data(spark, sf_dir)
    v = F.transform("embedding", lambda x: x * 3 + F.lit(0.125))
    return d.select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(F.get(vectors.normalise(v), F.lit(5)), 6).alias("x5"), F.round(vectors.norm(vectors.normalise(v)), 6).alias("unit"))


def row_access(spark, sf_dir):
    """Row sets in request order, a slice, and the shape."""
    d = _data(spark, sf_dir)
    some = source.get_rows(d, [7, 3, 3, 499, 0]).select(F.concat(F.lit("set "), F.col("pos").cast("string")).alias("what"), "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    part = source.get_rows_slice(d, 100, 104).select(F.lit("slice").alias("what"), "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    one = source.get_row(d, 42).select(F.lit("row").alias("what"), "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return some.unionByName(part).unionByName(one).withColumn("x", F.round("x", 6)).withColumn("cols", F.lit(source.n_cols(d)))


def half_precision(spark, sf_dir):
    d = source.quantise_half(_data(spark, sf_dir))
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 9)
    return d.select("vec_id", at(0).alias("x0"), at(63).alias("x63"))


def numpy_round_trip(spark, sf_dir):
    """Rows to a matrix, stored and read again as a table, and back."""
    ids, x = source.to_numpy(_data(spark, sf_dir).where("vec_id < 50"), dtype=np.float32)
    path = scratch_dir(spark)
    source.write_vectors(source.from_numpy(spark, x, first_id=int(ids[0])), f"file://{path}")
    d = source.read_vectors(spark, f"file://{path}")
    return d.select("vec_id", F.round(F.get("embedding", F.lit(7)).cast("double"), 6).alias("x7"), F.size("embedding").alias("cols"))


def words_128(spark, sf_dir):
    d = _data(spark, sf_dir)
    wide = lambda first: encode.encode(d, encode.center_matrix(encode.centers_of(d, 100, first)), 128, keep=["vec_id"])
    a, b, i = F.col("code"), F.col("other"), (F.col("vec_id") % 140).cast("int")
    c = wide(0).join(wide(100).withColumnRenamed("code", "other"), "vec_id")
    return c.select(
        "vec_id",
        bits.size_bits(a, 128).alias("size"),
        F.coalesce(bits.get_bit(a, i, 128).cast("int"), F.lit(-1)).alias("bit"),
        bits.count_bits_range_unchecked(a, 50, 90, 128).cast("long").alias("middle"),
        bits.hamming(a, b).cast("long").alias("dist"),
        bits.count_bits(bits.flip_bit(a, i, 128)).cast("long").alias("flipped"),
        bits.count_bits(bits.not_code(a, 128)).cast("long").alias("zeros"),
        bits.count_bits(bits.ones(40, 128)).cast("long").alias("ones"),
        bits.hamming(bits.repack(bits.repack(a, 128, 16), 16, 128), a).cast("long").alias("repacked"),
    )


def signed_words(spark, sf_dir):
    """Codes in signed 16-bit words, made of the ids."""
    ids = np.array([r["vec_id"] for r in _data(spark, sf_dir).where("vec_id < 200").select("vec_id").orderBy("vec_id").collect()])
    words = ((ids[:, None] * 7919 + np.arange(4) * 104729) % 65536 - 32768).astype(np.int16)
    c = source.from_numpy(spark, words, name="code")
    return c.select("vec_id", F.get("code", F.lit(0)).alias("w0"), F.get("code", F.lit(3)).alias("w3"), bits.count_bits(F.col("code")).cast("long").alias("ones"))


def _files(spark, sf_dir, n_codes=2):
    """The vectors and their codes as data sets of a matrix store, written by `encode_file`."""
    d, s, path = _data(spark, sf_dir), SketchSearch(spark), scratch_dir(spark)
    hdf5.store_hdf5(d, path, "emb")
    for name, n, first in [("code", 64, 0), ("c1", 32, 0), ("c2", 64, 32)][: 1 if n_codes < 2 else 3]:
        s.encode_file((path, "emb"), encode.center_matrix(encode.centers_of(d, n, first)), (path, name), W)
    return d, s, path


def matrix_encode(spark, sf_dir):
    _, s, path = _files(spark, sf_dir, 1)
    return _words(s.codes((path, "code")))


def matrix_query(spark, sf_dir):
    d, s, path = _files(spark, sf_dir, 1)
    return s.query((path, "emb"), (path, "code"), _asked(d), _asked(s.codes((path, "code"))), 10, 50).withColumn("dot", F.round("dot", 6))


def matrix_cascade(spark, sf_dir):
    d, s, path = _files(spark, sf_dir)
    codes = [(path, "c1"), (path, "c2")]
    return s.query_cascade((path, "emb"), codes, _asked(d), [_asked(s.codes(c)) for c in codes], 10, [100, 30]).withColumn("dot", F.round("dot", 6))


def matrix_refine(spark, sf_dir):
    d, s, path = _files(spark, sf_dir, 1)
    found = s.k_smallest_hamming((path, "code"), _asked(s.codes((path, "code"))), 50)
    return s.refine((path, "emb"), _asked(d), found, 10).withColumn("dot", F.round("dot", 6))


def encode_stream(spark, sf_dir):
    """The codes of a stream of vectors, as its sink has them."""
    d, path = _data(spark, sf_dir), f"file://{scratch_dir(spark)}"
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/embeddings.parquet*")
    streaming.encode_stream(stream.select("vec_id", "embedding"), encode.center_matrix(encode.centers_of(d, 64)), f"{path}/out", f"{path}/checkpoint", W).awaitTermination()
    return _words(spark.read.parquet(f"{path}/out"))


QUERIES = [
    dot_topk, dot_topk_sql, encode_arrow, encode_plan, encode_literal, bit_ops, bit_ops_mixed, popcount_range, hamming_topk, hamming_topk_sql, hamming_cascade,
    refine_dot, refine_code, query_single, query_cascade, recall_pairs, recall_codes, recall_predictions, recall_end_to_end, index_assign, index_nodes, index_knn, index_range,
    index_cost, index_tree, overlap_stats, sim_sums, train_step, train_step_all, greedy_pair, train_run, stochastic_run, ransac_init, greedy_init, train_gain, epoch_sample, kernels, cross_prods, zip_prods, normalise, row_access,
    half_precision, numpy_round_trip, words_128, signed_words, matrix_encode, matrix_query, matrix_cascade, matrix_refine, encode_stream,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


# --- the same in SQL -------------------------------------------------------------------------------------------------

_E = "e as (select vec_id, embedding::double[] as v from embeddings)"


def _sql_codes(name: str, n: int, first: int, word: int = W) -> str:
    """name(vec_id, code): bit i of the words is the sign of the product with row first + i."""
    return (
        f"{name} as (select vec_id, list(word order by w) as code from (select x.vec_id, (c.vec_id - {first}) // {word} as w, "
        f"bit_or(case when list_dot_product(x.v, c.v) >= 0 then 1::bigint << ((c.vec_id - {first}) % {word})::int else 0::bigint end) as word "
        f"from e x, e c where c.vec_id >= {first} and c.vec_id < {first + n} group by 1, 2) group by 1)"
    )


def _sql_hamming(a: str, b: str, words: int) -> str:
    return "(" + " + ".join(f"bit_count(xor({a}[{i + 1}], {b}[{i + 1}]))::int" for i in range(words)) + ")"


def _sql_best(name: str, pairs: str, k: int, score: str, largest: bool) -> str:
    return (
        f"{name} as (select * from (select query_id, row_number() over (partition by query_id order by {score} {'desc' if largest else 'asc'}, neighbor_id)::int as rank, "
        f"neighbor_id, {score} from ({pairs})) where rank <= {k})"
    )


_DOT_PAIRS = "select q.vec_id as query_id, d.vec_id as neighbor_id, list_dot_product(d.v, q.v) as dot from e d, e q where q.vec_id % 100 = 0"


def _sql_hamming_pairs(codes: str, words: int) -> str:
    return f"select q.vec_id as query_id, d.vec_id as neighbor_id, {_sql_hamming('d.code', 'q.code', words)} as dist from {codes} d, {codes} q where q.vec_id % 100 = 0"


def _sql_refine(found: str) -> str:
    return f"select query_id, neighbor_id, list_dot_product(d.v, q.v) as dot from {found} f join e d on d.vec_id = f.neighbor_id join e q on q.vec_id = f.query_id"


_C = _sql_codes("c", 64, 0)
_H = "with " + ", ".join([_E, _C])
_TRUE = _sql_best("t", _DOT_PAIRS, 10, "dot", True)
_PRED = _sql_best("p", _sql_hamming_pairs("c", 2), 50, "dist", False)
_RECALL = f"{_H}, {_TRUE}, {_PRED}, h as (select (select count(*) from p where exists (select 1 from t where t.query_id = p.query_id and t.neighbor_id = p.neighbor_id)) as hits, (select count(*) from t) as n_true) select hits, n_true, round(hits / n_true::double, 9) as recall from h"
_TWO = ", ".join([_E, _sql_codes("c1", 32, 0), _sql_codes("c2", 64, 32)])
_CASCADE = ", ".join(
    [
        _sql_best("s1", _sql_hamming_pairs("c1", 1), 100, "dist", False),
        "s2p as (select f.query_id, f.neighbor_id, f.dist + " + _sql_hamming("d.code", "q.code", 2) + " as dist from s1 f join c2 d on d.vec_id = f.neighbor_id join c2 q on q.vec_id = f.query_id)",
    ]
)
_BOUNDS = index.bucket_bounds(LAYER, FANOUT)
_LAYERS = ", ".join(
    f"(select count(*) filter (where n >= {_BOUNDS[0]}) + count(*) filter (where n >= {_BOUNDS[1]}) + count(*) filter (where n >= {_BOUNDS[2]}) from (select bit_count((code[{i // 2 + 1}] >> {16 * (i % 2)}) & 65535)::int as n))::int as b{i}" for i in range(4)
)
_PATHS = f"{_H}, l as (select vec_id, {_LAYERS} from c)"
_STATS = "b as (select vec_id, i, (code[i // 32 + 1] >> (i % 32)::int) & 1 as bit from c, generate_series(0, 63) g(i)), st as (select x.i, y.i as j, count(*) filter (where x.bit = y.bit) as overlap, abs(count(*) filter (where x.bit = y.bit) / count(*)::double - 0.5) as sim from b x join b y using (vec_id) where x.i <> y.i group by 1, 2)"
_LEAST = [
    f"greatest([0, {', '.join(map(str, _BOUNDS[:-1]))}][p.b{i} + 1] - q.n{i}, q.n{i} + 1 - [{', '.join(map(str, _BOUNDS[:-1]))}, {LAYER + 1}][p.b{i} + 1], 0)" for i in range(4)
]
_COUNTS = ", ".join(f"bit_count((code[{i // 2 + 1}] >> {16 * (i % 2)}) & 65535)::int as n{i}" for i in range(4))


def _sql_draws(name: str, seed: int, epoch: int = 0) -> str:
    """name(vec_id, v, pos): the order of an epoch."""
    key = f"('0x' || substr(md5('{seed}:{epoch}:' || vec_id), 1, 13))::bigint"
    return f"{name} as materialized (select vec_id, v, row_number() over (order by {key}, vec_id) - 1 as pos from e)"


def _sql_step(k: int, data: str, everyone: bool, choice: int | None = None, scale: float = 0.1) -> list[str]:
    """From centers c<k>(i, v) to c<k+1>. choice: which center of the most similar pair moves; None: all do."""
    nearest = f"(select i, j, eq from (select *, row_number() over (partition by i order by abs(eq - 0.5) desc, j) as r from st{k}) where r = 1)"
    moved = "" if choice is None else f"where p.i = (select {'ij'[choice]} from st{k} where i < j order by abs(eq - 0.5) desc, i, j limit 1)"
    return [
        f"b{k} as materialized (select x.vec_id, c.i, list_dot_product(x.v, c.v) >= 0 as bit from {data} x, c{k} c)",
        f"st{k} as materialized (select x.i, y.i as j, count(*) filter (where x.bit = y.bit) / count(*)::double as eq from b{k} x join b{k} y using (vec_id) where x.i <> y.i group by 1, 2)",
        f"u{k} as (select p.i, p.j, d, a.v[d] as x, a.v[d] * list_dot_product(a.v, o.v) - o.v[d] as y, tan((2 * eq - 1) * pi() / 2 * {scale}) as f from {f'st{k}' if everyone else nearest} p "
        f"join c{k} a on a.i = p.i join c{k} o on o.i = p.j, generate_series(1, 64) g(d) {moved})",
        f"z{k} as (select i, d, any_value(x) + sum(y / ny * f) as z from (select *, sqrt(sum(y * y) over (partition by i, j)) as ny from u{k}) group by i, d)",
        f"m{k} as materialized (select i, list(z / nz order by d) as v from (select *, sqrt(sum(z * z) over (partition by i)) as nz from z{k}) group by i)",
        f"c{k + 1} as materialized (select i, v from m{k} union all select i, v from c{k} where i not in (select i from m{k}))",
    ]


_FIRST_16 = "c0 as materialized (select vec_id as i, v from e where vec_id < 16)"


def _sql_centers(ctes: list[str], last: str) -> str:
    return f"with {', '.join([_E, *ctes])} select i::int as bit_idx, (d - 1)::int as dim, round(v[d], 6) as value from {last}, generate_series(1, 64) g(d)"


def _sql_unit(a: str, b: str) -> str:
    apart = f"list_transform(list_zip({a}, {b}), lambda t: t[1] - t[2])"
    return f"list_transform({apart}, lambda x: x / sqrt(list_dot_product({apart}, {apart})))"


def _sql_ransac(n_bits: int, pairs: int, sample: int) -> str:
    ctes = [_sql_draws("pool", 1), _sql_draws("epoch", 0), f"s as materialized (select pos, v from epoch where pos < {sample})"]
    for b in range(n_bits):
        ctes.append(f"k{b} as materialized (select a.pos // 2 - {b * pairs} as t, {_sql_unit('a.v', 'o.v')} as v from pool a join pool o on o.pos = a.pos + 1 where a.pos % 2 = 0 and a.pos // 2 between {b * pairs} and {(b + 1) * pairs - 1})")
        ctes.append(f"g{b} as materialized (select t, pos, list_dot_product(s.v, k{b}.v) >= 0 as bit from s, k{b})")
        if b:
            one = " union all ".join(f"select t, abs(2 * count(*) filter (where x.bit = y.bit) - count(*)) as w from g{b} x join h{a} y using (pos) group by t" for a in range(b))
            ctes.append(f"p{b} as materialized (select t from ({one}) group by t order by max(w), t limit 1)")
        else:
            ctes.append("p0 as (select 0 as t)")
        ctes.append(f"h{b} as materialized (select pos, bit from g{b} where t = (select t from p{b}))")
    ctes.append("c as (" + " union all ".join(f"select {b} as i, v from k{b} where t = (select t from p{b})" for b in range(n_bits)) + ")")
    return _sql_centers(ctes, "c")


def _sql_greedy(n_bits: int, points: int = 20) -> str:
    ctes = []
    for b in range(n_bits):
        dist = " + ".join(["0", *(f"((list_dot_product(x.v, (select v from c{a})) >= 0) <> (list_dot_product(p.v, (select v from c{a})) >= 0))::int" for a in range(b))])
        ctes.append(_sql_draws(f"o{b}", b))
        ctes.append(f"n{b} as materialized (select p.v as a, x.v as b, {dist} as apart from o{b} p, e x where p.pos < {points} and p.v <> x.v order by apart, p.pos, x.vec_id limit 1)")
        ctes.append(f"c{b} as materialized (select {_sql_unit('a', 'b')} as v from n{b})")
    ctes.append("c as (" + " union all ".join(f"select {b} as i, v from c{b}" for b in range(n_bits)) + ")")
    return _sql_centers(ctes, "c")


def _sql_half(x: str) -> str:
    step = f"(case when abs({x}) < pow(2, -14) then pow(2, -24) else pow(2, floor(log2(abs({x}))) - 10) end)"
    return f"round(case when {x} = 0 then 0 else round_even({x} / {step}, 0) * {step} end, 9)"


def _choices(seed: int, n: int) -> list[int]:
    """Which center of a pair moves in each step of a trainer with this seed."""
    rng = np.random.default_rng(seed)
    return [int(rng.integers(2)) for _ in range(n)]


def oracle_sql() -> dict[str, str]:
    i, w = "(vec_id % 70)", "(vec_id % 70) // 32"
    mask = "(1::bigint << ((vec_id % 70) % 32)::int)"
    at = lambda k, change: f"case when {w} = {k} then {change} else a[{k + 1}] end"
    out = {
        "dot_topk": f"with {_E}, {_TRUE} select query_id, rank, neighbor_id, round(dot, 6) as dot from t",
        "encode_arrow": f"{_H} select vec_id, code[1] as w0, code[2] as w1 from c",
        "encode_literal": f"with {_E}, {_sql_codes('c', 8, 0, 8)} select vec_id, code[1] as w0 from c",
        "bit_ops": f"""with {_E}, {_C}, {_sql_codes("o", 64, 64)}, z as (select c.vec_id, c.code as a, o.code as b from c join o using (vec_id))
            select vec_id, case when {i} < 64 then ((a[{w} + 1] >> ({i} % 32)::int) & 1)::int else -1 end as bit,
              {at(0, f"a[1] | {mask}")} as set0, {at(1, f"a[2] | {mask}")} as set1, {at(1, f"a[2] & (4294967295 - {mask})")} as unset1, {at(0, f"xor(a[1], {mask})")} as flip0,
              (bit_count(a[1]) + bit_count(a[2]))::bigint as ones, {_sql_hamming("a", "b", 2)}::bigint as dist, (bit_count(a[1] & b[1]) + bit_count(a[2] & b[2]))::bigint as both,
              a[1] | b[1] as or0, a[1] & b[1] as and0, xor(a[2], b[2]) as xor1, 4294967295 - a[2] as not1, 64::bigint as size, 0::bigint as zero1, 4294967295::bigint as one1 from z""",
        "bit_ops_mixed": f"""with {_E}, {_C}, {_sql_codes("o", 48, 64, 48)}, z as (select c.vec_id, c.code[1] + (c.code[2] & 65535) * 4294967296 as a, c.code[2] >> 16 as high, o.code[1] as b from c join o using (vec_id))
            select vec_id, bit_count(xor(a, b))::bigint as dist, bit_count(a & b)::bigint as both, 0::bigint as or3, ((a & b) >> 16) & 65535 as and1, xor(a, b) & 4294967295 as xor0, 65535 - (b >> 32) as not2, high >> 8 as byte7 from z""",
        "popcount_range": f"""{_H}, z as (select vec_id, code, vec_id % 60 as lo, vec_id % 60 + vec_id % 7 as hi from c)
            select vec_id, case when lo < hi and hi <= 64 then list_sum(list_transform(range(lo, hi), lambda i: (code[i // 32 + 1] >> (i % 32)::int) & 1))::bigint else -1 end as ones,
              list_sum(list_transform(range(5, 40), lambda i: (code[i // 32 + 1] >> (i % 32)::int) & 1))::bigint as middle from z""",
        "hamming_topk": f"{_H}, {_sql_best('t', _sql_hamming_pairs('c', 2), 20, 'dist', False)} select * from t",
        "hamming_cascade": f"with {_TWO}, {_CASCADE}, {_sql_best('t', 'select * from s2p', 20, 'dist', False)} select * from t",
        "refine_dot": f"{_H}, {_PRED}, {_sql_best('t', _sql_refine('p'), 10, 'dot', True)} select query_id, rank, neighbor_id, round(dot, 6) as dot from t",
        "refine_code": f"with {_TWO}, {_sql_best('s1', _sql_hamming_pairs('c1', 1), 50, 'dist', False)}, s2p as (select f.query_id, f.neighbor_id, {_sql_hamming('d.code', 'q.code', 2)} as dist from s1 f join c2 d on d.vec_id = f.neighbor_id join c2 q on q.vec_id = f.query_id), {_sql_best('t', 'select * from s2p', 10, 'dist', False)} select * from t",
        "query_cascade": f"with {_TWO}, {_CASCADE}, {_sql_best('s2', 'select * from s2p', 30, 'dist', False)}, {_sql_best('t', _sql_refine('s2'), 10, 'dot', True)} select query_id, rank, neighbor_id, round(dot, 6) as dot from t",
        "recall_pairs": _RECALL,
        "index_assign": f"{_PATHS} select vec_id, (((b0 * 4 + b1) * 4 + b2) * 4 + b3)::bigint as leaf_id, b0, b1, b2, b3 from l",
        "index_nodes": f"{_PATHS} select d::int as depth, array_to_string([b0, b1, b2, b3][1:d], ',') as prefix, count(*) as n from l, generate_series(0, 4) g(d) group by 1, 2",
        "index_range": f"{_H}, t as (select * from ({_sql_hamming_pairs('c', 2)}) where dist <= 24) select query_id, row_number() over (partition by query_id order by dist, neighbor_id)::int as rank, neighbor_id, dist from t",
        "overlap_stats": f"{_H}, {_STATS} select i::int as i, j::int as j, overlap, round(sim, 9) as sim from st",
        "sim_sums": f"{_H}, {_STATS} select i::int as i, round(sum(sim), 6) as sim_sum from st group by 1",
        "train_step": _sql_centers([_FIRST_16, *_sql_step(0, "e", False)], "c1"),
        "train_step_all": _sql_centers([_FIRST_16, *_sql_step(0, "e", True)], "c1"),
        "train_run": _sql_centers([_FIRST_16, *(x for k, c in enumerate(_choices(0, 3)) for x in _sql_step(k, "e", False, c))], "c3"),
        "stochastic_run": _sql_centers(
            [_sql_draws("epoch", 1), *(f"s{k} as (select vec_id, v from epoch where pos >= {200 * k} and pos < {200 * k + 200})" for k in range(2)), _FIRST_16, *(x for k in range(2) for x in _sql_step(k, f"s{k}", False))], "c2"
        ),
        "ransac_init": _sql_ransac(4, 5, 200),
        "greedy_init": _sql_greedy(3),
        "index_cost": f"""{_PATHS}, {_sql_best("t", _sql_hamming_pairs("c", 2), 20, "dist", False)}, u as (select query_id, max(dist) as ub from t group by 1),
            q as (select vec_id as query_id, {_COUNTS} from c where vec_id % 100 = 0), p as (select b0, b1, b2, b3, count(*) as n from l group by all)
            select q.query_id, count(*) as leaves, sum(p.n)::bigint as distances from q join u using (query_id), p where {" + ".join(_LEAST)} <= u.ub group by 1""",
        "index_tree": "select x::int as node, case when x = 0 then -1 else (x - 1) // 4 end::int as parent, case when x = 0 then -1 else (x - 1) % 4 end::int as place, case when x = 0 then 0 when x < 5 then 1 when x < 21 then 2 else 3 end::int as depth, x >= 21 as leaf, (4 * x + 3)::int as third from range(85) t(x)",
        "half_precision": f"with {_E} select vec_id, {_sql_half('v[1]')} as x0, {_sql_half('v[64]')} as x63 from e",
        "numpy_round_trip": f"with {_E} select vec_id, round(v[8], 6) as x7, 64::int as cols from e where vec_id < 50",
        "words_128": f"""with {_E}, b as (select x.vec_id, c.vec_id as i, list_dot_product(x.v, c.v) >= 0 as bit from e x, e c where c.vec_id < 200),
            z as (select vec_id, list(bit order by i) as a from b group by 1)
            select vec_id, 128::bigint as size, case when vec_id % 140 < 100 then a[vec_id % 140 + 1]::int when vec_id % 140 < 128 then 0 else -1 end as bit,
              len(list_filter(a[51:90], lambda x: x))::bigint as middle, len(list_filter(list_zip(a[1:100], a[101:200]), lambda t: t[1] <> t[2]))::bigint as dist,
              (len(list_filter(a[1:100], lambda x: x)) + case when vec_id % 140 < 100 then (case when a[vec_id % 140 + 1] then -1 else 1 end) when vec_id % 140 < 128 then 1 else 0 end)::bigint as flipped,
              (128 - len(list_filter(a[1:100], lambda x: x)))::bigint as zeros, 128::bigint as ones, 0::bigint as repacked from z""",
        "signed_words": """with w as (select vec_id, list_transform(range(4), lambda j: (vec_id * 7919 + j * 104729 + 32768) % 65536) as a from embeddings where vec_id < 200)
            select vec_id, a[1]::bigint as w0, a[4]::bigint as w3, list_sum(list_transform(a, lambda x: bit_count(x)))::bigint as ones from w""",
        "greedy_pair": f"{_H} select q.vec_id as neighbor_id, {_sql_hamming('q.code', 'p.code', 2)} as dist from c q, c p where p.vec_id = 0 and q.vec_id <> 0 order by 2, 1 limit 1",
        "epoch_sample": f"with {_E}, {_sql_draws('a', 3)}, {_sql_draws('b', 3, 1)}, n as (select count(*) as n from e) select pos as draw, vec_id from a union all select pos + n, vec_id from b, n where pos < n // 2",
        "kernels": f"""with {_E}, z as (select d.vec_id, d.v as a, o.v as b from e d, e o where o.vec_id = 0),
            y as (select vec_id, list_dot_product(a, b) as p, list_dot_product(a, a) as aa, list_dot_product(b, b) as bb,
                sqrt(list_sum(list_transform(list_zip(a, b), lambda t: (t[1] - t[2] - 0.5) ** 2))) as dist, list_sum(list_transform(list_zip(a, b), lambda t: (t[1] - t[2]) ** 2)) as sq,
                list_dot_product(a[1:63], b[2:64]) + list_dot_product(a[2:64], b[1:63]) as side from z)
            select vec_id, round(p, 6) as prod, round(aa, 6) as self_prod, round(dist, 6) as dist, round(p / sqrt(aa * bb), 6) as cos, round(1 - p / sqrt(aa * bb), 6) as cos_dist, round(exp(-sq / 2), 6) as rbf,
              round(p + 0.25 * side, 6) as mahalanobis, round((0.5 * p + 1) ** 3, 6) as poly, round(tanh(0.5 * p + 0.1), 6) as sigmoid, round(p, 6) as induced from y""",
        "cross_prods": f"with {_E} select q.vec_id as left_id, count(*) as n, round(sum(list_dot_product(d.v, q.v)), 5) as total from e d, e q where q.vec_id % 100 = 0 group by 1",
        "zip_prods": f"with {_E} select a.vec_id, round(list_dot_product(a.v, b.v), 6) as prod from e a join e b on a.vec_id = b.vec_id + 1",
        "normalise": f"with {_E}, z as (select vec_id, list_transform(v, lambda x: x * 3 + 0.125) as v from e), n as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from z) select vec_id, round(n, 6) as norm, round(v[6] / n, 6) as x5, 1.0::double as unit from n",
        "row_access": f"with {_E}, r as (select * from (values (0, 7), (1, 3), (2, 3), (3, 499), (4, 0)) t(pos, id)) select 'set ' || pos as what, vec_id, round(v[1], 6) as x, 64::int as cols from r join e on e.vec_id = r.id union all select 'slice', vec_id, round(v[1], 6), 64 from e where vec_id between 100 and 103 union all select 'row', vec_id, round(v[1], 6), 64 from e where vec_id = 42",
    }
    out |= {"matrix_encode": out["encode_arrow"], "encode_stream": out["encode_arrow"], "matrix_query": out["refine_dot"], "matrix_refine": out["refine_dot"], "matrix_cascade": out["query_cascade"]}
    out |= {"dot_topk_sql": out["dot_topk"], "encode_plan": out["encode_arrow"], "hamming_topk_sql": out["hamming_topk"], "query_single": out["refine_dot"], "index_knn": out["hamming_topk"]}
    out |= {k: out["recall_pairs"] for k in ("recall_codes", "recall_predictions", "recall_end_to_end")}
    return out
