"""Packing documents into token sequences by bounded-space online best-fit.

Texts are tokenised in tasks, an end id is added, and documents longer than a sequence are cut into whole sequences, the
first piece taking the remainder.  Pieces are dealt to packing tasks by a hash; a task takes its pieces online, in the
order of the documents whatever their lengths, and keeps a fixed number of open bins, far fewer than it has pieces.  A
bitset has a bit for every amount of free space for which a bin is open: the lowest set bit at or above the length of a
piece is the best fit.  Without a fit a new bin opens; if too many are open, the fullest closes first.

The bins still open at the end of a task are pieces of the next round, which has fewer tasks, and so on until one task is
left; a task of any round reads a bounded number of pieces.  Whole sequences need no packing.

Cases: a null text counts as empty: one end id.  Texts of any length are tokenised whole.  Repeated rows are packed each
for itself.  A null doc_id is carried along.  Order, task and bin numbers follow from the rows and their files, so a task that runs again packs the same way.
An empty table gives no rows.  Columns beyond those named are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage

#: Pieces per packing task (about), open bins per task, and how many tasks meet in one task of the next round.
TASK_PIECES, OPEN_BINS, FAN_IN = 65_536, 1_024, 16

#: White space with the run that follows: a boundary before white space is always one of tokens, and so is one between a
#: letter or digit and these marks.
SEGMENT = re.compile(r"\s*[A-Za-z0-9À-ÖØ-öø-ɏ]+(?=[.,;:!?\s]|\Z)|\s*\S+|\s+")


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes, by the tokenizer of a JSON file.

    Segments repeat, so their ids are remembered; the tokenizer's own special tokens inside a text stay one token each.
    """

    MOST, LONGEST = 1_200_000, 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.known = _Known(self.tokenizer)

    def __call__(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return b"".join(ids_of(self.tokenizer, x) if i % 2 else self.plain(x) for i, x in enumerate(self.special.split(text)))

    def plain(self, text: str) -> bytes:
        if len(self.known) > self.MOST:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, SEGMENT.findall(text)))


def ids_of(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Known(dict):
    """Ids by segment.  It doesn't point back to the encoder, so a task's vocabulary is freed at the task's end."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, segment: str) -> bytes:
        found = ids_of(self.tokenizer, segment)
        if len(segment) <= Encoder.LONGEST:
            self[segment] = found
        return found


def cut_lengths(n: int, most: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole sequences, the remainder first."""
    first = n % most
    return ([first] if first else []) + [most] * (n // most)


def tokenized_pieces(documents: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """documents: doc_id, text.  tokenizer: path of a JSON vocabulary.  Returns doc_id, piece, start, length, ids_crc32."""

    # A worker keeps its copy of a broadcast value: its tasks share one encoder and the ids that it remembers.
    shared = documents.sparkSession.sparkContext.broadcast({})

    def run(batches):
        held, end = shared.value, end_id.to_bytes(4, "little")
        encoder = held["encoder"] = held.get("encoder") or Encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, start = encoder(text or "") + end, 0
                for piece, length in enumerate(cut_lengths(len(ids) // 4, most)):
                    row = doc, piece, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start += length
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Bins of one task.  put() gives the number of the bin and the place in it."""

    def __init__(self, most: int, open_bins: int):
        self.most, self.open_bins = most, open_bins
        self.free: list[list[int]] = [[] for _ in range(most + 1)]  # open bins by free space
        self.bits, self.opened, self.n_open = 0, 0, 0

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self.free[space].pop()
            if not self.free[space]:
                self.bits &= ~(1 << space)
            self.n_open -= 1
        else:
            if self.n_open >= self.open_bins:  # the fullest closes first
                space = (self.bits & -self.bits).bit_length() - 1
                self.free[space].pop()
                if not self.free[space]:
                    self.bits &= ~(1 << space)
                self.n_open -= 1
            space, number = self.most, self.opened
            self.opened += 1
        left = space - length
        if left:  # a full bin is closed
            self.free[left].append(number)
            self.bits |= 1 << left
            self.n_open += 1
        return number, self.most - space

    def still_open(self) -> list[tuple[int, int]]:
        """(number, tokens in it) of the open bins."""
        return [(number, self.most - space) for space, numbers in enumerate(self.free) for number in numbers]


def _packed(most: int, open_bins: int, level: int):
    """item, length -> item, bin, offset of each; then bin, fill of the bins that stay open (item null)."""

    def run(batches):
        bins, base = BestFit(most, open_bins), (level << 56) + (TaskContext.get().partitionId() << 32)

        def batch_of(items, placed):
            return pa.RecordBatch.from_arrays(
                [items, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], ["item", "bin", "offset"]
            )

        for batch in batches:
            yield batch_of(batch.column("item"), [bins.put(n) for n in batch.column("length").to_pylist()])
        if rest := bins.still_open():
            yield batch_of(pa.nulls(len(rest), pa.int64()), rest)

    return run


def pack_pieces(pieces: DataFrame, most: int = 2048, task_pieces: int = TASK_PIECES, open_bins: int = OPEN_BINS) -> DataFrame:
    """pieces: item (long, unique, not negative), length (1 to most).  Returns item, sequence_id, offset.

    A bin's number holds its round, its task and a count; whole sequences get negative numbers.
    """
    whole = pieces.where(F.col("length") == most).select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.where(F.col("length") < most).select("item", "length")
    tasks, level, placed = max(1, -(-items.count() // task_pieces)), 0, None
    while True:
        ordered = items.repartition(tasks, "item").sortWithinPartitions("item")
        packed = cut_lineage(ordered.mapInArrow(_packed(most, open_bins, level), "item long, bin long, offset long"))
        here = packed.where("item IS NOT NULL")
        if placed is None:
            placed = here
        else:  # the items of this round are open bins of the round before
            moved = here.select(F.col("item").alias("old"), F.col("bin").alias("new"), F.col("offset").alias("base"))
            placed = placed.join(moved, F.col("bin") == F.col("old"), "left").select(
                "item", F.coalesce("new", "bin").alias("bin"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")
            )
        if tasks == 1:
            return placed.select("item", F.col("bin").alias("sequence_id"), "offset").unionByName(whole)
        items = packed.where("item IS NULL").select(F.col("bin").alias("item"), F.col("offset").alias("length"))
        tasks, level = -(-tasks // FAN_IN), level + 1


def pack_documents(documents: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    pieces = cut_lineage(tokenized_pieces(documents, tokenizer, most, end_id).withColumn("item", F.monotonically_increasing_id()))
    placed = pack_pieces(pieces.select("item", "length"), most, **options).withColumnRenamed("item", "i")
    return pieces.join(placed, F.col("item") == F.col("i")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
