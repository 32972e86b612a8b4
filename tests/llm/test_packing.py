import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pulsegrid.llm import packing
from pulsegrid.llm.queries import byte_bpe
from tokenizers import Tokenizer

JSON = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
ENCODER = packing.Encoder(byte_bpe())


def ids_of(text):
    return [*JSON.encode(text, add_special_tokens=False).ids, 0]


@settings(max_examples=1500, deadline=None)
@given(st.text() | st.text(alphabet="ab '\t\n\r\x0b\x1c\x85\xa0 é1.!s<|>") | st.text(alphabet="aB9 \n\x1c.,;:!?'²ªßé日-_") | st.lists(st.sampled_from(["<|endoftext|>", " ", "  ", "\n", "a", "It's", "12", "　", "日本"])).map("".join))
def test_ids_are_those_of_the_tokenizer(text):
    assert np.frombuffer(ENCODER(text), "<u4").tolist() == ids_of(text)[:-1]


def check(rows, docs, most):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for d, text in docs:
        want[d].append(ids_of(text or ""))
    for d, lists in want.items():
        found = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[d])
        made = []
        for ids in lists:
            start = 0
            for k, n in enumerate(packing.cut_lengths(len(ids), most)):
                made.append((k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
                start += n
        assert found == sorted(made)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    return len(sequences)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, byte_bpe()).collect()
    n = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1  # online: the order of arrival is taken as it is


@pytest.mark.parametrize("options", [{}, {"task_pieces": 20, "open_bins": 3}])
def test_edge_cases_and_rounds(spark, options):
    rows = [(1, None, 1), (2, "", 1), (3, "a " * 70, 1), (3, "a " * 70, 1), (None, "x", 2)] + [(10 + i, "word " * (i % 37), i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item int")
    found = packing.pack_documents(docs, byte_bpe(), most=32, **options).collect()
    check(found, [(d, t) for d, t, _ in rows], 32)
    assert packing.pack_documents(docs.limit(0), byte_bpe()).count() == 0


def test_a_very_long_text(spark):
    docs = [(1, "lorem ipsum. " * 100_000), (2, "x")]
    check(packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), byte_bpe()).collect(), docs, 2048)


def test_best_fit_and_the_fullest_closes_first():
    bins = packing.BestFit(10, 2)
    assert [bins.put(n) for n in (7, 6, 3, 4, 9, 8, 1, 2)] == [(0, 0), (1, 0), (0, 7), (1, 6), (2, 0), (3, 0), (2, 9), (3, 8)]
    bins = packing.BestFit(10, 2)
    assert [bins.put(n) for n in (7, 6, 5, 4)] == [(0, 0), (1, 0), (2, 0), (1, 6)]  # bin 0, the fullest, was closed
    assert bins.still_open() == [(2, 5)]
