"""Vector code compression: product quantisation in exact integers.

Vectors are cut into equal consecutive parts.  Each part position has a codebook, which starts as that part of the vectors
with the smallest ids.  In a round, Arrow batches assign all parts: squared distances are |x|^2 - 2 x.c + |c|^2, from one
int64 matrix product for each batch, and the first smallest wins.  Every task sums the parts of each entry, a grouped
shuffle adds the tasks' sums, and the entries become the floors of the means; unused entries stay.  What travels is the
broadcast codebooks (parts x entries x components) and as many sums from a task; vectors stay where they are.

Integers are exact: where squares might leave an int64, a batch is computed with Python's integers instead.

Cases: vectors that are null or hold a null take no part, nor do those of another length than that of the smallest id.
Lengths that the parts don't divide give the first parts one component more; a part without components has code 0.  Rows
without an id come last in the order of ids; rows that share an id are ordered by their vectors, and each has a row of its own.
With fewer rows than entries the codebooks are smaller.  Errors beyond a long count as the largest long.  An empty table
gives no rows.  Columns beyond ``id`` and ``vec`` are kept by ``compress``; it replaces those named code and error.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut_lineage

LONG = 2**63 - 1
#: Rows whose distances a task computes at once.
STEP = 1_024


def _widest(numbers: np.ndarray) -> int:
    return max(int(numbers.max(initial=0)), -int(numbers.min(initial=0)))


class Codebooks:
    """Entries (integers) of each part position: arrays of entries x components."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.most = max((_widest(e) for e in entries), default=0)
        self.bounds = np.cumsum([0, *(e.shape[1] for e in entries)])

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and squared distances of each part; exact whatever the size of the numbers."""
        wide = max(self.most, _widest(rows))
        kind = np.int64 if 4 * rows.shape[1] * wide * wide <= LONG else object
        codes, errors = np.zeros((len(rows), len(self.entries)), np.int64), np.zeros((len(rows), len(self.entries)), kind)
        for p, (lo, hi) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            if lo == hi:
                continue
            x, c = rows[:, lo:hi].astype(kind), self.entries[p].astype(kind)
            far = (c * c).sum(axis=1) - 2 * (x @ c.T)  # |x|^2 is the same for all entries
            codes[:, p] = far.argmin(axis=1)
            errors[:, p] = far[np.arange(len(far)), codes[:, p]] + (x * x).sum(axis=1)
        return codes, errors

    def replaced(self, sums: dict[tuple[int, int], tuple[list[int], int]]) -> Codebooks:
        """Entries become floor(sum / count) of their parts; those without any stay."""
        made = [e.copy() for e in self.entries]
        for (p, k), (totals, n) in sums.items():
            made[p][k] = [t // n for t in totals]
        return Codebooks(made)

    def sha256(self) -> str:
        """Of the decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for x in e.ravel()).encode()).hexdigest()


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """Of the ``entries`` smallest ids; None for an empty table."""
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    if not rows:
        return None
    size = len(rows[0]["vec"])
    seeds = [r["vec"] for r in rows if len(r["vec"]) == size]
    seeds = np.array(seeds, np.int64).reshape(len(seeds), size)
    return Codebooks([np.ascontiguousarray(x) for x in np.array_split(seeds, parts, axis=1)])


def _matrix(column) -> np.ndarray:
    """Rows of lists of one length."""
    numbers = np.asarray(column.flatten(), np.int64)
    return numbers.reshape(len(column), len(numbers) // max(1, len(column)))


def _sums(shared):
    """vec -> part, entry, n, total (of each component) of what one task has assigned."""

    def run(batches):
        books = Codebooks(shared.value)
        totals = [np.zeros(e.shape, object) for e in books.entries]
        counts = np.zeros((len(books.entries), max(map(len, books.entries))), np.int64)
        for batch in batches:
            rows = _matrix(batch.column("vec"))
            for i in range(0, len(rows), STEP):
                step = rows[i : i + STEP]
                codes, _ = books.assign(step)
                for p, (lo, hi) in enumerate(zip(books.bounds[:-1], books.bounds[1:], strict=True)):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, at = np.unique(codes[order, p], return_index=True)
                    x = step[order, lo:hi].astype(np.int64 if _widest(step) <= LONG // STEP else object)
                    counts[p, used] += np.diff(np.append(at, len(order)))
                    if lo < hi:
                        totals[p][used] += np.add.reduceat(x, at, axis=0).astype(object)
        found = [(p, k, int(counts[p, k]), [Decimal(int(t)) for t in totals[p][k]]) for p, k in zip(*map(np.ndarray.tolist, counts.nonzero()), strict=True)]
        if found:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["part", "entry", "n", "total"])

    return run


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """vectors: id, vec (array of long, of one length).  None for an empty table."""
    books = first_codebooks(vectors, parts, entries)
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds if books else 0):
        shared = context.broadcast(books.entries)
        partial = vectors.select("vec").mapInArrow(_sums(shared), "part int, entry int, n long, total array<decimal(38,0)>")
        place = partial.select("part", "entry", "n", F.posexplode("total").alias("at", "total"))
        summed = place.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        sums: dict[tuple[int, int], tuple[list[int], int]] = {}
        for r in sorted(summed.collect()):  # one row for each component of the codebooks
            sums.setdefault((r["part"], r["entry"]), ([], r["n"]))[0].append(int(r["total"]))
        books = books.replaced(sums)
        shared.unpersist()
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vectors: vec and others.  Adds code (binary, one byte a part; two if a codebook has over 256 entries) and error (long)."""
    shared, kind = vectors.sparkSession.sparkContext.broadcast(books.entries), ">u1" if max(map(len, books.entries)) <= 256 else ">u2"
    kept = vectors.drop("code", "error")

    def run(batches):
        own = Codebooks(shared.value)
        for batch in batches:
            rows, codes, errors = _matrix(batch.column("vec")), [], []
            for i in range(0, len(rows), STEP):
                code, error = own.assign(rows[i : i + STEP])
                codes += [c.tobytes() for c in code.astype(kind)]
                errors += [min(int(e), LONG) for e in error.astype(object).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(errors, pa.int64())], [*batch.schema.names, "code", "error"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks | None]:
    """vectors: id, vec (array of long) and others.  The rows that take part with code and error, and the codebooks."""
    rows = vectors.drop("code", "error").where(F.col("vec").isNotNull() & ~F.exists("vec", F.isnull))
    rows = cut_lineage(rows.withColumns({"id": F.col("id").try_cast("long"), "vec": F.col("vec").cast("array<long>")}))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").select(F.size("vec").alias("size")).first()
    if first is None:
        return rows.withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("long")}), None
    rows = rows.where(F.size("vec") == first["size"])
    books = train(rows, parts, entries, rounds)
    return encode(rows, books), books


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """coded: code and others.  Adds approx, the vector that the code stands for."""
    shared, kind = coded.sparkSession.sparkContext.broadcast(books.entries), ">u1" if max(map(len, books.entries)) <= 256 else ">u2"
    kept = coded.drop("approx")

    def run(batches):
        for batch in batches:
            codes = [np.frombuffer(c, kind) for c in batch.column("code").to_pylist()]
            approx = [np.concatenate([e[k] for e, k in zip(shared.value, c, strict=True)]).tolist() for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(approx, pa.list_(pa.int64()))], [*batch.schema.names, "approx"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("approx", T.ArrayType(T.LongType()))]))
