import numpy as np
import pytest

from sketchloom.llm import common


def test_sieve_and_rows_without_keys(spark):
    rows = common.materialize(spark.range(5000).selectExpr("id as at", "cast(id as string) as `c0`", "if(id = 7, null, id) as k").repartition(3))
    gone = common.materialize(spark.createDataFrame([(i,) for i in range(0, 5000, 7)] + [(3,), (3,)], "x long"))
    left = common.without(rows, "k", gone)
    assert left.columns == ["at", "c0", "k"]
    assert sorted(r["at"] for r in left.collect()) == [i for i in range(5000) if (i % 7 or i == 7) and i != 3]
    sieve = common.sieve_of(gone)
    assert {r["at"] for r in common.sifted(rows, "at", sieve, True).collect()} >= {i for i in range(0, 5000, 7)}
    assert common.sifted(rows, "at", sieve, False).count() > 4000
    full = np.full(common.SIEVE_BITS // 64, 2**64 - 1, np.uint64)
    assert common.sifted(rows, "at", full, False).count() == 0
    assert common.without(rows, "k", gone.where("false")).count() == 5000 and common.without(rows.where("false"), "k", gone).count() == 0


def test_token_hashes_read_every_byte():
    words = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"x" * 255, b"x" * 256, b"x" * 257, b"x" * 900, "é".encode()]
    words += [w[: len(w) // 2] + b"#" + w[len(w) // 2 + 1 :] for w in words if len(w) > 2]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends = common.words_of(raw, np.array([0, len(raw)]))
    h = common.token_hashes(raw, starts, ends)
    assert len(set(h.tolist())) == len(words) == len(h)
    for w, x in zip(words, h, strict=True):
        one = np.frombuffer(w, np.uint8)
        assert common.token_hashes(one, np.array([0]), np.array([len(w)]))[0] == x


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.work_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert common.work_dir(Session()).startswith("hdfs://x/y/llm-")
