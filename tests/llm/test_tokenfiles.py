import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pulsegrid.llm import queries, tokenfiles
from pulsegrid.llm.queries import word_bpe
from tokenizers import Tokenizer

JSON = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
ENCODER = tokenfiles.WordEncoder(word_bpe())


def ids_of(text):
    return [*JSON.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=1500, deadline=None)
@given(st.text() | st.text(alphabet="aBİ .,'s\t\n\r\x0b\x1c\x1f\x85\xa0̸́é9") | st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", " ", "\n", "It's", "Straße.", "12,", "日本。", "x.\x1c.", "İ.", "a.b", "don't"])).map("".join))
def test_ids_are_those_of_the_tokenizer(text):
    assert np.frombuffer(ENCODER(text), "<u4").tolist() == ids_of(text)[:-1]


@settings(max_examples=300, deadline=None)
@given(st.data(), st.integers(1, 32))
def test_packing_and_back(data, bits):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=50)), "<u4")
    packed = tokenfiles.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert tokenfiles.unpack(packed, bits, len(ids)).tolist() == ids.tolist()
    assert sum(int(x) << bits * i for i, x in enumerate(ids)) == int.from_bytes(packed, "little")  # the lowest bits first


def test_a_file(tmp_path):
    docs = [(None, [5]), (None, []), (-3, [7] * 40), (2, list(range(100))), (2, [1])]
    with open(tmp_path / "x.bin", "wb") as f:
        writer = tokenfiles.Writer(f, 7, block=16)
        for doc, ids in docs:
            writer.put(doc, np.array(ids, "<u4"))
        assert writer.close() == (142, 5, 9)
    file, every = tokenfiles.Reader(str(tmp_path / "x.bin")), [x for _, ids in docs for x in ids]
    assert (file.bits, file.n_null, file.docs.tolist(), file.starts.tolist()) == (7, 2, [0, 0, -3, 2, 2], [0, 1, 1, 41, 141, 142])
    assert np.diff(file.offsets).tolist() == [14] * 8 + [13]
    for first in range(0, 143, 9):
        for n in (0, 1, 15, 16, 17, 200):
            assert file.ids(first, n).tolist() == every[first : first + n]
    assert list(file.spans(45)) == [(0, 3), (3, 4), (4, 5)]
    (tmp_path / "y.bin").write_bytes(bytes(200))
    with pytest.raises(ValueError, match="no token file"):
        tokenfiles.Reader(str(tmp_path / "y.bin"))


def wanted(rows):
    start, found = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):  # stable: repeated ids in the order of the table
        ids = ids_of(text)
        found.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = queries.op12_tokens(spark, "/root/testdata/sf0.01").select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, found.collect())) == sorted(wanted(map(tuple, docs.collect())))


def test_cases_and_random_access(spark, tmp_path):
    rows = [(3, "b"), (None, "null id"), (1, None), (3, "a a a"), (2, ""), (None, "another"), (9, "lorem ipsum, " * 30_000), (4, "x"), (3, "b")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, ids int, row int").coalesce(1)
    path = f"file://{tmp_path}/out"
    tokenfiles.write_tokens(docs, path, word_bpe(), block=64)
    found = sorted((tuple(r) for r in tokenfiles.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert [(d, s, n, zlib.crc32(bytes(ids))) for d, s, n, ids in found] == wanted(rows)
    every = np.concatenate([np.frombuffer(ids, "<u4") for *_, ids in found])
    files = tokenfiles.token_files(spark, path)
    assert len(files) == 4 and sum(n for *_, n in files) == len(every)
    for first, n in ((0, 10), (5, 3), (len(every) - 7, 100), (3, len(every)), (len(every), 5)):
        assert tokenfiles.read_range(files, first, n).tolist() == every[first : first + n].tolist()
    # A file that a lost attempt left is named nowhere and read by nobody.
    (tmp_path / "out/files/ids-000000-999999.bin").write_bytes(b"half a file")
    assert tokenfiles.read_tokens(spark, path).count() == len(rows)
    tokenfiles.write_tokens(docs.limit(0), f"{path}-none", word_bpe())
    assert tokenfiles.read_tokens(spark, f"{path}-none").collect() == []
