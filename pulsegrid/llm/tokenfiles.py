"""Token ids in binary files: fixed-width bit packing in blocks with offsets.

A range partitioning sorts the texts by doc_id; the task of each range tokenises them and writes one file.  An id takes
as many bits as the largest id of the vocabulary needs; ids of all documents run on without gaps.  A file is

    header  magic, version, bits, ids per block (little-endian, 64 bytes with padding)
    blocks  each packs its ids from the lowest bit on and starts at a byte
    index   start of each block (uint64), doc_id of each document (int64; 0 where null), first id of each document (uint64)
    tail    ids, documents, documents without an id (they come first), blocks, start of the index, magic

A reader takes the tail, then the index; any range of ids needs the bytes of its blocks only, and numpy unpacks them at
once.  Files are named after the task attempt that wrote them, and the manifest, a Parquet table that Spark commits, names
those of the attempts that count: a task that ran twice, or was lost half-way, leaves at most a file that nothing names.
The folder must be one that tasks reach through pyarrow's file systems (a shared mount, HDFS, an object store).

Cases: a null text counts as empty: the end id alone.  Texts of any length are tokenised whole and may span blocks.  Null
doc_ids (and those that are no whole number) come first; rows that share a doc_id are written each, in the order of the
table.  An empty table gives files without ids, and no rows on reading.  Columns beyond those named are ignored.
"""

from __future__ import annotations

import re
import struct
import sys
import types
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import Encoder, ids_of

#: Ids of a block; documents of a file (about, at most); ids that a reading task unpacks at once.
BLOCK, FILE_DOCS, SPAN_IDS = 8_192, 1 << 18, 1 << 20

MAGIC, VERSION = b"PGTOKENS", 1
HEADER, TAIL = "<8sIII44x", "<QQQQQ8s"
HEAD_BYTES, TAIL_BYTES = struct.calcsize(HEADER), struct.calcsize(TAIL)


def bits_for(largest: int) -> int:
    """Bits that hold every id up to ``largest``."""
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, each in ``bits`` bits from its lowest on; the last byte is filled with zeros."""
    digits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(digits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data: each from the eight bytes at its first bit."""
    at = np.arange(n) * bits
    windows = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    return (windows[at >> 3] >> (at & 7).astype("<u8") & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    """Writes one file to a stream: put() the ids of each document in order, then close()."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_null = 0
        self.offsets, self.docs, self.starts = [], [], []
        stream.write(struct.pack(HEADER, MAGIC, VERSION, bits, block))
        self.at = HEAD_BYTES

    def put(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc or 0)
        self.starts.append(self.n_ids)
        self.n_null += doc is None
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._write(self.n_held - self.n_held % self.block)

    def _write(self, most: int) -> None:
        ids = np.concatenate(self.held)
        for i in range(0, most, self.block):
            packed = pack(ids[i : min(i + self.block, most)], self.bits)
            self.stream.write(packed)
            self.offsets.append(self.at)
            self.at += len(packed)
        self.held, self.n_held = [ids[most:]], self.n_held - most

    def close(self) -> tuple[int, int, int]:
        """Numbers of ids, documents and blocks."""
        if self.n_held:
            self._write(self.n_held)
        for values, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.starts, "<u8")):
            self.stream.write(np.array(values, kind).tobytes())
        self.stream.write(struct.pack(TAIL, self.n_ids, len(self.docs), self.n_null, len(self.offsets), self.at, MAGIC))
        self.stream.close()
        return self.n_ids, len(self.docs), len(self.offsets)


class Reader:
    """One file, by random access."""

    def __init__(self, path: str):
        system, place = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(place)
        magic, version, self.bits, self.block = struct.unpack(HEADER, self.file.read_at(HEAD_BYTES, 0))
        end = self.file.size()
        self.n_ids, n_docs, self.n_null, n_blocks, index, tail = struct.unpack(TAIL, self.file.read_at(TAIL_BYTES, end - TAIL_BYTES))
        if magic != MAGIC or tail != MAGIC or version != VERSION:
            raise ValueError(f"{path} is no token file of version {VERSION}")
        data = self.file.read_at(end - TAIL_BYTES - index, index)
        self.offsets = np.append(np.frombuffer(data, "<u8", n_blocks), np.uint64(index)).astype(np.int64)
        self.docs = np.frombuffer(data, "<i8", n_docs, 8 * n_blocks)
        self.starts = np.append(np.frombuffer(data, "<u8", n_docs, 8 * (n_blocks + n_docs)), np.uint64(self.n_ids)).astype(np.int64)

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from place ``first`` on, reading their blocks only."""
        n = max(0, min(n, self.n_ids - first))
        if not n:
            return np.empty(0, "<u4")
        b, e = first // self.block, (first + n - 1) // self.block + 1
        at, data = self.offsets[b], self.file.read_at(int(self.offsets[e] - self.offsets[b]), int(self.offsets[b]))
        found = [unpack(data[self.offsets[i] - at : self.offsets[i + 1] - at], self.bits, min(self.block, self.n_ids - i * self.block)) for i in range(b, e)]
        return np.concatenate(found)[first - b * self.block :][:n]

    def spans(self, most: int = SPAN_IDS) -> Iterator[tuple[int, int]]:
        """Ranges of documents with at most so many ids together; a longer document has one of its own."""
        lo = 0
        while lo < len(self.docs):
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + most, "right")) - 1)
            yield lo, hi
            lo = hi


class WordEncoder(Encoder):
    """Token ids by a vocabulary that lower-cases, drops white space and cuts texts as ``PIECE`` does.

    Texts of Latin-1 characters, which no normalisation changes, are cut here; pieces repeat, so that few of them reach the
    tokenizer's model.  Other texts go to the tokenizer word by word.  For vocabularies of another kind pass
    ``packing.Encoder``.
    """

    MOST = 200_000
    #: Contractions, runs of letters, single digits, runs of anything else but white space.  Of what Python
    #: takes for white space U+001C to U+001F are none.
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
    WIDE, SPACE = re.compile(r"[^\x00-\xff]"), re.compile(r"[^\S\x1c-\x1f]+")

    def __init__(self, path: str):
        super().__init__(path)
        self.pieces, self.words = _Pieces(self.tokenizer.model), _Words(self.tokenizer)

    def clear(self) -> None:
        self.pieces.clear()
        self.words.clear()

    def plain(self, text: str) -> bytes:
        if len(self.pieces) + len(self.words) > self.MOST:
            self.clear()
        if self.WIDE.search(text):
            return b"".join(map(self.words.__getitem__, filter(None, self.SPACE.split(text))))
        return b"".join(map(self.pieces.__getitem__, self.PIECE.findall(text.lower())))


def byte_characters() -> dict[int, str]:
    """What byte-level vocabularies write for a byte: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Pieces(dict):
    """Ids of a piece of Latin-1 characters, by the merges of its bytes."""

    def __init__(self, model):
        super().__init__()
        written = byte_characters()
        self.model, self.table = model, {c: "".join(written[b] for b in chr(c).encode()) for c in range(256)}

    def __missing__(self, piece: str) -> bytes:
        found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece.translate(self.table))])
        if len(piece) <= Encoder.LONGEST:
            self[piece] = found
        return found


class _Words(dict):
    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        found = ids_of(self.tokenizer, word)
        if len(word) <= Encoder.LONGEST:
            self[word] = found
        return found


def held_by_worker(key: str, make: Callable):
    """What a Python worker keeps between its tasks: made once, under a module name of its own."""
    kept = sys.modules.setdefault("_pulsegrid_worker", types.ModuleType("_pulsegrid_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def largest_id(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0)


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1, encoder: Callable = WordEncoder, block: int = BLOCK, file_docs: int = FILE_DOCS) -> None:
    """Writes the token files of documents (doc_id, text) and their manifest below ``path``, in the order of doc_id.

    There are as many files as the session has shuffle partitions, and more beyond ``file_docs`` documents for each.
    """
    spark = documents.sparkSession
    bits = bits_for(max(largest_id(tokenizer), end_id))
    n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents.count() // file_docs))
    folder = f"{path}/files"
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)

    def run(batches):
        task = TaskContext.get()
        encode, end = held_by_worker(f"{encoder.__name__} {tokenizer}", lambda: encoder(tokenizer)), end_id.to_bytes(4, "little")
        name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        system, place = fs.FileSystem.from_uri(folder)
        writer = Writer(system.open_output_stream(f"{place}/{name}"), bits, block)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                writer.put(doc, np.frombuffer(encode(text.as_py() or "") + end, "<u4"))
        if hasattr(encode, "clear"):  # the tokenizer stays, its ids by piece go
            encode.clear()
        pa.default_memory_pool().release_unused()
        counts = [[x] for x in (task.partitionId(), name, *writer.close())]
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(counts, kinds, strict=True)], ["part", "name", "ids", "docs", "blocks"])

    rows = documents.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(n_files, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    ordered.mapInArrow(run, "part int, name string, ids long, docs long, blocks long").write.mode("overwrite").parquet(f"{path}/manifest")


def token_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, first id and number of ids of each file, in order: as many as there are files."""
    parts = sorted((r["part"], r["name"], r["ids"]) for r in spark.read.parquet(f"{path}/manifest").collect())
    starts = accumulate((n for _, _, n in parts), initial=0)
    return [(f"{path}/files/{name}", start, n) for (_, name, n), start in zip(parts, starts)]  # noqa: B905


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32 bits each) of each document in the files."""

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = Reader(name)
                for lo, hi in file.spans():
                    at = file.starts[lo : hi + 1]
                    ids = memoryview(file.ids(int(at[0]), int(at[-1] - at[0])).tobytes())
                    docs = pa.array(file.docs[lo:hi], mask=np.arange(lo, hi) < file.n_null)
                    own = pa.array([ids[4 * a : 4 * b] for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([docs, pa.array(base + at[:-1]), pa.array(np.diff(at)), own], ["doc_id", "start", "n_tokens", "ids"])

    files = token_files(spark, path)
    rows = spark.createDataFrame([(i, name, start) for i, (name, start, _) in enumerate(files)], "part int, name string, base long")
    return rows.repartitionById(max(1, len(files)), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_range(files: list[tuple[str, int, int]], first: int, n: int) -> np.ndarray:
    """n ids from place ``first`` of the whole corpus on, over files as ``token_files`` gives them: what a trainer reads."""
    found = [np.empty(0, "<u4")]
    for path, start, size in files:
        if start < first + n and first < start + size:
            lo = max(first, start)
            found.append(Reader(path).ids(lo - start, min(first + n, start + size) - lo))
    return np.concatenate(found)
