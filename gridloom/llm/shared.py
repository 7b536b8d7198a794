"""Staged tables and files in the folder that all executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from gridloom.staging import release, shared_dir, stage

__all__ = ["local_path", "map_bytes", "release", "shared_dir", "small_batches", "stage", "write_bytes"]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: str = "4m") -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes for the jobs that run inside: both ends of a Python worker hold whole batches."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def local_path(uri: str) -> str | None:
    """The path of a mounted folder, or None for a store that only a filesystem client reaches."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def write_bytes(uri: str, parts) -> None:
    """Write the buffers of parts as one file that appears whole or not at all."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = f"{path}.{uuid.uuid4().hex}.part"
        with open(temp, "wb") as f:
            for x in parts:
                f.write(x)
        os.replace(temp, path)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(name), recursive=True)
    with store.open_output_stream(f"{name}.part") as f:
        for x in parts:
            f.write(x)
    store.move(f"{name}.part", name)


def map_bytes(uri: str, dtype):
    """The file as a read-only array: memory-mapped if its folder is mounted, else read."""
    import numpy as np

    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype)
