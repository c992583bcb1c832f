"""Folders for files that a query writes and reads back."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new path on storage that driver and executors mount: in `spark.checkpoint.dir`, or on one machine in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        if not re.match(r"(file:/*)?/", base):
            raise RuntimeError("matrix files need a folder that every executor mounts")
        return f"{re.sub(r'^file:/*', '/', base).rstrip('/')}/matrix-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sketchloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"{_own[0]}/matrix-{uuid.uuid4().hex}"
