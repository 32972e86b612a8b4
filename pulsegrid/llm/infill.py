"""Fill-in-the-middle documents on ropes.

A text becomes a rope: a balanced tree whose leaves hold at most ``LEAF`` code points each, and whose nodes cache the line
ends and code points below them.  Two cuts at unit ranks give prefix, middle and suffix as subtrees that share leaves; the
output is the concatenation of sentinel leaves and subtrees in another order.  The way back cuts the output's rope at the
ranks of its sentinels.  A cut walks one path of the tree, and part sizes come from the caches.

Units are lines: what a line feed ends, and the rest of the text, if any.  The cuts and the form follow from a SHA-256 of
seed and doc_id, so a task that runs again makes the same rows, and no shuffle is needed.

Cases: a null text counts as empty.  Empty texts, and texts that hold a sentinel, stay plain: the output is the text.  A
doc_id that is null or no whole number is hashed as an empty string and returned as null.  Repeated rows are formed each for itself;
with one doc_id they get the same hash.  Texts of any length are cut whole; one line may be a whole text.  An empty table gives no
rows.  Columns beyond those named are ignored by ``infill_documents`` and kept by ``restored``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points of a leaf, and of the texts that a task holds before it sends them on.
LEAF, HELD_CHARS = 4_096, 8_000_000

SENTINELS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (text) or a node (left, right), with the line ends and code points in it."""

    breaks: int
    chars: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    def __str__(self) -> str:
        found, open_nodes = [], [self]
        while open_nodes:
            node = open_nodes.pop()
            if node.left is None:
                found.append(node.text)
            else:
                open_nodes += (node.right, node.left)
        return "".join(found)


EMPTY = Rope(0, 0)


def leaf(text: str) -> Rope:
    return Rope(text.count("\n"), len(text), text)


def concat(*ropes: Rope) -> Rope:
    """The ropes one after the other, paired level by level."""
    row = [r for r in ropes if r.chars]
    while len(row) > 1:
        pairs = [Rope(a.breaks + b.breaks, a.chars + b.chars, "", a, b) for a, b in zip(row[::2], row[1::2])]  # noqa: B905
        row = pairs + row[2 * len(pairs) :]
    return row[0] if row else EMPTY


def rope_of(text: str, size: int = LEAF) -> Rope:
    return concat(*(leaf(text[i : i + size]) for i in range(0, len(text), size)))


def lines(rope: Rope) -> int:
    """Units of a text: its line ends, and one more if it goes on after the last."""
    last = rope
    while last.right is not None:
        last = last.right
    return rope.breaks + bool(last.text and last.text[-1] != "\n")


def cut_chars(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` code points, and the rest."""
    if rank <= 0 or rank >= rope.chars:
        return (EMPTY, rope) if rank <= 0 else (rope, EMPTY)
    if rope.left is None:
        return leaf(rope.text[:rank]), leaf(rope.text[rank:])
    if rank <= rope.left.chars:
        a, b = cut_chars(rope.left, rank)
        return a, concat(b, rope.right)
    a, b = cut_chars(rope.right, rank - rope.left.chars)
    return concat(rope.left, a), b


def cut_lines(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the rest."""
    if rank <= 0 or rank > rope.breaks:
        return (EMPTY, rope) if rank <= 0 else (rope, EMPTY)
    if rope.left is None:
        at = len(rope.text) - len(rope.text.split("\n", rank)[-1])
        return leaf(rope.text[:at]), leaf(rope.text[at:])
    if rank <= rope.left.breaks:
        a, b = cut_lines(rope.left, rank)
        return a, concat(b, rope.right)
    a, b = cut_lines(rope.right, rank - rope.left.breaks)
    return concat(rope.left, a), b


def infill(text: str, key: str, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS, size: int = LEAF):
    """units, form, code points of prefix and of middle (None if plain), output."""
    rope = rope_of(text, size)
    n, digest = lines(rope), hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = cut_lines(rope, last)
    prefix, middle = cut_lines(head, first)
    p, s, m = map(leaf, sentinels)
    made = concat(s, suffix, p, prefix, m, middle) if h4 % 100 < spm_rate else concat(p, prefix, s, suffix, m, middle)
    return n, "spm" if h4 % 100 < spm_rate else "psm", prefix.chars, middle.chars, str(made)


def restore(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS, size: int = LEAF) -> str:
    """The text again: the parts of a formed text hold no sentinel, so that each occurs once."""
    if form == "plain":
        return output
    p, s, m = sentinels
    rope, parts = rope_of(output, size), {}
    for mark in (m, p, s) if form == "spm" else (m, s, p):  # from the last to the first
        rope, part = cut_chars(rope, output.index(mark))
        parts[mark] = cut_chars(part, len(mark))[1]
    return str(concat(parts[p], parts[m], parts[s]))


def _sent(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def infill_documents(documents: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """documents: doc_id, text.  Returns doc_id, n (units), form, prefix_chars, middle_chars, output.

    rate and spm_rate are per cent: of documents to be formed, and of formed ones with the suffix first.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows.append((doc, *infill(text or "", f"{seed}:{'' if doc is None else doc}", rate, spm_rate, sentinels)))
                held += len(rows[-1][-1])
                if held > HELD_CHARS:
                    yield _sent(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _sent(rows, schema)

    rows = documents.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(outputs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """outputs: output, form.  Adds ``restored``, the text rebuilt from these two alone; a column of that name is replaced."""
    kept = outputs.drop("restored")

    def run(batches):
        for batch in batches:
            texts = [restore(o or "", f or "plain", sentinels) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "restored"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("restored", T.StringType())]))
