"""One file for each group, in folders key=value that name it, written by the tasks that hold the groups.

Spark's own partitioned writers create, check and commit each file on its own through Hadoop, which costs tens of milliseconds a
file; here a task writes a file under a hidden name and moves it to its place, so a file is there whole or not at all.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.signals import dealt

NULL = "__HIVE_DEFAULT_PARTITION__"


def _folder(keys: Sequence[str], values: Sequence[str | None]) -> str:
    """key=value/..., escaped as Spark does it."""
    escaped = (re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", v) if v else NULL for v in values)
    return "/".join(f"{k}={v}" for k, v in zip(keys, escaped, strict=True))


class Lines:
    """Text: a head and the column ``value``, a line each."""

    def __init__(self, stream: pa.NativeFile, head: str):
        self.stream = stream
        self.stream.write(head.encode())

    def write(self, batch: pa.RecordBatch) -> None:
        self.stream.write("".join(f"{v or ''}\n" for v in batch.column("value").to_pylist()).encode())

    def close(self) -> None:
        self.stream.close()


class Rows:
    """Parquet of all columns."""

    def __init__(self, stream: pa.NativeFile, schema: pa.Schema):
        self.stream, self.writer = stream, pq.ParquetWriter(stream, schema, compression="snappy")

    def write(self, batch: pa.RecordBatch) -> None:
        self.writer.write_batch(batch)

    def close(self) -> None:
        self.writer.close()
        self.stream.close()


def _write(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], ending: str, opened: Callable, mode: str) -> None:
    """A file for each group of the keys, in order, read as a stream: a task holds a batch.

    The name is chosen once for all attempts of a task; a group whose file is in place was written by an earlier attempt.
    """
    system, place = fs.FileSystem.from_uri(path)
    there = system.get_file_info(place).type != fs.FileType.NotFound
    if there and mode == "ignore":
        return
    if there and mode in ("error", "errorifexists"):
        raise FileExistsError(path)
    system.create_dir(place, recursive=True)
    if mode == "overwrite":
        system.delete_dir_contents(place)
    name = f"part-{uuid.uuid4()}{ending}"

    def run(batches):
        system, place = fs.FileSystem.from_uri(path)
        attempt, key, file, target, n = TaskContext.get().taskAttemptId(), None, None, None, 0

        def closed():
            if file is not None:
                file.close()
                system.move(f"{target}/.{attempt}-{name}", f"{target}/{name}")

        for batch in batches:
            own = list(zip(*(batch.column(f"__f_{k}").to_pylist() for k in keys), strict=True))
            rows = batch.select(list(columns))
            edges = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for lo, hi in itertools.pairwise(edges):
                if lo == hi:
                    continue
                if own[lo] != key:
                    closed()
                    key, n, target = own[lo], n + 1, f"{place}/{_folder(keys, own[lo])}"
                    system.create_dir(target, recursive=True)
                    done = system.get_file_info(f"{target}/{name}").type != fs.FileType.NotFound
                    file = None if done else opened(system.open_output_stream(f"{target}/.{attempt}-{name}"), rows.schema)
                if file is not None:
                    file.write(rows.slice(lo, hi - lo))
        closed()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    named = {f"__f_{k}": F.col(k).cast("string") for k in keys}
    dealt(df.withColumns(named), list(named), order).select(*named, *columns).mapInArrow(run, "files long").agg(F.sum("files")).collect()
    system.open_output_stream(f"{place}/_SUCCESS").close()


def write_lines(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], head: str = "", ending: str = ".txt", mode: str = "errorifexists") -> None:
    """Text files of the column ``value``, sorted by order, below ``head`` (whole lines)."""
    _write(df, path, keys, order, ["value"], ending, lambda stream, schema: Lines(stream, head), mode)


def write_csv_files(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], sep: str = ",", mode: str = "errorifexists") -> None:
    """CSV files with a header, formatted by Spark."""
    line = F.to_csv(F.struct(*columns), {"sep": sep}).alias("value")
    write_lines(df.select(*dict.fromkeys([*keys, *order]), line), path, keys, order, sep.join(columns) + "\n", ".csv", mode)


def write_parquet_files(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], mode: str = "errorifexists") -> None:
    """Parquet files of all columns but the keys."""
    _write(df, path, keys, order, [c for c in df.columns if c not in keys], ".snappy.parquet", Rows, mode)
