import numpy as np
import pytest

from sketchloom.operators import encode
from sketchloom.sources import hdf5
from sketchloom.sources import vectors as source
from sketchloom.streaming.encode import encode_stream


class FakeFile:
    """What the reader needs of an HDF5 file."""

    sets: dict = {}

    def __init__(self, path=None):
        pass

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def __getitem__(self, name):
        return FakeFile.sets[name]

    def create_dataset(self, name, shape, dtype):
        FakeFile.sets[name] = np.zeros(shape, dtype)
        return FakeFile.sets[name]


def test_numpy_round_trip_and_row_access(spark, tmp_path):
    x = np.arange(60, dtype=np.float32).reshape(20, 3)
    d = source.from_numpy(spark, x)
    ids, y = source.to_numpy(d)
    assert ids.tolist() == list(range(20)) and np.array_equal(x, y) and source.n_rows(d) == 20 and source.n_cols(d) == 3
    got = source.get_rows(d, [5, 2, 5]).orderBy("pos").collect()
    assert [r["vec_id"] for r in got] == [5, 2, 5]
    assert sorted(r["vec_id"] for r in source.get_rows_slice(d, 17, 99).collect()) == [17, 18, 19]
    assert source.get_row(d, 4).first()["embedding"] == [12.0, 13.0, 14.0]
    w = np.array([[2**64 - 1, 5], [0, 2**63]], np.uint64)
    assert np.array_equal(source.to_numpy(source.from_numpy(spark, w, name="code"), "code", dtype=np.uint64)[1], w)
    assert source.from_numpy(spark, x.astype(np.float16)).dtypes[1] == ("embedding", "array<float>")
    with pytest.raises(ValueError):
        source.spark_type(np.complex64)
    source.write_vectors(d, f"{tmp_path}/v")
    back = source.read_vectors(spark, f"{tmp_path}/v")
    assert back.count() == 20
    plan = source.get_rows_slice(back, 3, 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(vec_id), GreaterThanOrEqual(vec_id,3), LessThan(vec_id,5)]" in plan


def test_half_precision(spark):
    rows = [(1, [0.1, 1e-9, None]), (2, None), (3, []), (4, [2049.0, 65504.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["embedding"] for r in source.quantise_half(df).collect()}
    assert got[2] is None and got[3] == [] and got[4] == [2048.0, 65504.0] and got[1] == [float(np.float16(0.1)), 0.0, None]


def test_hdf5_reader_with_a_stand_in(spark):
    x = np.random.default_rng(0).standard_normal((25, 4)).astype(np.float32)
    FakeFile.sets["emb"] = x
    r = hdf5.MatrixReader({"path": "p", "dataset": "emb", "rows_per_partition": "10", "batch_size": "4"}, opener=FakeFile)
    parts = r.partitions()
    assert [(p.start, p.stop) for p in parts] == [(0, 10), (10, 20), (20, 25)]
    rows = [row for p in parts for b in r.read(p) for row in b.to_pylist()]
    assert [q["vec_id"] for q in rows] == list(range(25)) and np.array_equal(np.array([q["embedding"] for q in rows], np.float32), x)
    hdf5.store_hdf5(source.from_numpy(spark, x), "q", "out", opener=FakeFile)
    assert np.array_equal(FakeFile.sets["out"], x)
    assert hdf5.MatrixSource.name() == "hdf5_matrix"


def test_streamed_codes_equal_batch_codes(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, c = rng.standard_normal((50, 4)), rng.standard_normal((10, 4))
    d = source.from_numpy(spark, x)
    d.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    encode_stream(stream, c, f"{tmp_path}/out", f"{tmp_path}/cp", 8).awaitTermination(120)
    got = {r["vec_id"]: r["code"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r["vec_id"]: r["code"] for r in encode.encode(d, c, 8).collect()}


def test_matrix_store_through_the_data_source(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((250, 5)).astype(np.float32)
    path = f"{tmp_path}/store"
    hdf5.store_hdf5(source.from_numpy(spark, x), path, "emb", block=40)
    back = hdf5.read_hdf5(spark, path, "emb", rows_per_partition=60, batch_size=7)
    assert back.rdd.getNumPartitions() == 5 and np.array_equal(source.to_numpy(back)[1].astype(np.float32), x)
    w = np.array([[2**64 - 1, 5], [0, 2**63]], np.uint64)
    hdf5.store_hdf5(source.from_numpy(spark, w, name="code"), path, "code", embedding="code", dtype="i8")
    codes = hdf5.read_hdf5(spark, path, "code", kind="code")
    assert codes.columns == ["vec_id", "code"] and np.array_equal(source.to_numpy(codes, "code", dtype=np.uint64)[1], w)
    small = hdf5.FolderStore(path).create_dataset("signed", (2, 2), "i2")
    small[:] = [[-1, 5], [-32768, 0]]
    small.flush()
    assert [r["code"] for r in hdf5.read_hdf5(spark, path, "signed", kind="code").orderBy("vec_id").collect()] == [[65535, 5], [32768, 0]]
    signed = source.from_numpy(spark, np.array([[-1, 5], [-128, 0]], np.int8), name="code")
    assert [r["code"] for r in signed.orderBy("vec_id").collect()] == [[255, 5], [128, 0]]
