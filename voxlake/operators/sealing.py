"""Answers that are kept the moment they are paid for.

A task writes every few answers to a folder of its round, under its partition. A task
that runs again reads what its partition has sealed and asks only the rest; what a call
that ended early has sealed is read as a table.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, types as T

# Tasks get this module's code with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Answers between two seals: what a killed task can cost at most.
GROUP = 16


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """A folder as tasks see it: local and mounted ones, HDFS, S3 and GCS."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Seals:
    """What one partition of one round has sealed."""

    def __init__(self, uri: str, partition: int, keys: list[str]) -> None:
        self.fs, self.folder = file_system(uri)
        self.prefix, self.keys = f"p{partition:07d}-", keys

    def read(self) -> dict[tuple, tuple[str | None, str | None]]:
        """(raw, error) by key."""
        files = self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True))
        mine = sorted(f.path for f in files if f.base_name.startswith(self.prefix) and f.extension == "parquet")
        known = {}
        for path in mine:
            table = pq.read_table(path, filesystem=self.fs).to_pydict()
            told = zip(table["raw"], table["error"])
            known.update(zip(zip(*[table[k] for k in self.keys]), told))
        return known

    def add(self, rows: pa.Table) -> None:
        """Keep some answers; they count once the file has its name."""
        self.fs.create_dir(self.folder)
        path = f"{self.folder}/{self.prefix}{uuid.uuid4().hex}"
        pq.write_table(rows, f"{path}.tmp", filesystem=self.fs)
        self.fs.move(f"{path}.tmp", f"{path}.parquet")


def ask(
    frames: Iterator[pd.DataFrame], transport: Callable[[str], str | None], keys: list[str], threads: int,
    seals: Seals | None, group: int,
) -> Iterator[pd.DataFrame]:
    """Frames of keys and prompt to frames of keys, raw and error; sealed prompts are not asked."""

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return transport(prompt), None
        except Exception as e:  # noqa: BLE001 - kept as a row
            return None, str(e) or type(e).__name__

    known = {} if seals is None else seals.read()
    with ThreadPoolExecutor(threads) as pool:
        for frame in frames:
            step = len(frame) if seals is None else max(group, threads)
            for start in range(0, len(frame), max(step, 1)):
                part = frame.iloc[start:start + step]
                named = list(zip(*[part[k].tolist() for k in keys]))
                fresh = [k not in known for k in named]
                new = dict(zip([k for k, f in zip(named, fresh) if f], pool.map(one, part["prompt"][fresh])))
                out = part.drop(columns="prompt")
                told = [new.get(k) or known[k] for k in named]
                out["raw"], out["error"] = [raw for raw, _ in told], [error for _, error in told]
                if seals is not None and new:
                    texts = {c: pa.array(out[c][fresh].tolist(), pa.string()) for c in ("raw", "error")}
                    columns = {k: pa.array(out[k][fresh].tolist()) for k in keys}
                    seals.add(pa.table({**columns, **texts}))
                yield out


def sealed(spark: SparkSession, uri: str, schema: T.StructType | str, keys: list[str]) -> DataFrame:
    """The sealed answers of a round, one per key: two tasks may have asked the same."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(uri).dropDuplicates(keys)
