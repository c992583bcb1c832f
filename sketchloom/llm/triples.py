"""One level of the distributed difference-cover suffix sort, as dealt: kept to measure it, not used by `suffix`.

A level takes the positions of residue 1 and 2 modulo 3, sorts their triples across the cluster, and names them: equal
triples get equal names, in order. The recursion would repeat this on the names, and the merge would sort all positions
three times more. README has what one level shuffles and costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sums_before, text_slices


def sampled_triples(docs: DataFrame, text: str = "text", span: int = 2) -> DataFrame:
    """text number, position and triple (three symbols of `span` bytes as one number, at most 2) of the sampled positions."""
    if not 1 <= span <= 2:
        raise ValueError("three symbols must fit in a number")
    base = docs.select(F.monotonically_increasing_id().alias("u"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in text_slices(batch, "t", 1_000_000):
                u = np.asarray(part.column("u"))
                for d in range(len(off) - 1):
                    own = np.append(raw[off[d] : off[d + 1]].astype(np.int64) + 1, np.zeros(3 * span, np.int64))
                    key = np.zeros(off[d + 1] - off[d], np.int64)
                    for k in range(3 * span):
                        key = key * 257 + own[k : k + len(key)]  # 0 stands for what is beyond the end
                    at = np.flatnonzero(np.arange(len(key)) % 3)
                    yield pa.RecordBatch.from_pydict({"u": pa.array(np.full(len(at), u[d])), "pos": pa.array(at), "triple": pa.array(key[at])})

    return base.mapInArrow(run, "u long, pos long, triple long")


def named(triples: DataFrame) -> DataFrame:
    """u, pos, name: how many different triples are smaller."""
    triples = materialize(triples)
    names = sums_before(triples.groupBy("triple").count().select("triple"), [F.col("triple")], {"name": F.lit(1)})
    return materialize(triples.join(names, "triple").select("u", "pos", "name"))
