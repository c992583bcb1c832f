"""Encoding a stream of vectors as it arrives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.encode import encode


def encode_stream(vectors: DataFrame, centers: np.ndarray, path: str, checkpoint: str, word_bits: int = 64, once: bool = True) -> StreamingQuery:
    """Append codes of a streaming vector table to Parquet files at `path`; the sink is exactly once per checkpoint."""
    out = encode(vectors, centers, word_bits).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start(path)
