import corpus_pipeline
import numpy as np
import pytest
from pulsegrid.llm import packing, simhash
from pulsegrid.llm.queries import byte_bpe


def smallest_of_groups(docs):
    """By brute force: of all documents linked within six bits of either fingerprint of their weighted words, the smallest doc_id."""
    weights = simhash.word_weights(docs)
    rows = sorted((r["doc_id"], *simhash.word_fingerprints((r["text"] or "").encode(), weights)) for r in docs.select("doc_id", "text").collect())
    ids, one, two = [r[0] for r in rows], *(np.array([r[i] for r in rows], np.uint64) for i in (1, 2))
    least = np.arange(len(ids))
    while True:
        now = np.array([least[(np.bitwise_count(one ^ a) <= 6) | (np.bitwise_count(two ^ b) <= 6)].min() for a, b in zip(one, two, strict=True)])
        if (now == least).all():
            return {ids[i] for i in least}
        least = now


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "exact dedup", "near-dedup", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert dict(after.dtypes) == dict(before.dtypes)


def test_each_stage_takes_effect_on_what_is_left(spark, stages):
    ids = [{r["doc_id"] for r in after.select("doc_id").collect()} for _, _, after in stages]
    assert ids[0] > ids[1] > ids[2] >= ids[3] == ids[4]
    texts = {}
    for r in stages[0][2].collect():
        texts.setdefault(r["text"].lower() if r["text"].isascii() else r["text"], []).append(r["doc_id"])
    assert {max(v) for v in texts.values()} >= ids[1]
    assert ids[2] == smallest_of_groups(stages[1][2])
    encoder = packing.Encoder(byte_bpe())
    tokens = sum(len(encoder(r["text"] or "")) // 4 + 1 for r in stages[3][2].collect())
    assert sum(r["length"] for r in stages[4][2].collect()) == tokens


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got.collect())) == sorted(map(key, stages[4][2].collect()))


def test_odd_rows_pass_through_all_stages(spark):
    """Nulls in any column, repeated and null ids, empty and long texts, columns that clash."""
    words = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(words[(i * k + i * i) % 400] for i in range(60))
    rows = [(i, text(i), "en", "s" if i % 3 else "t", 1, "a", 2) for i in range(1, 40)]
    rows += [(2, text(50), "en", "s", 1, "a", 2), (None, text(51), None, None, None, None, None), (None, text(52), "en", "s", 1, "a", 2), (60, None, "en", "s", 0, "a", 2), (61, "", "en", None, 0, "a", 2)]
    rows += [(62, text(9), "en", "s", 1, "a", 2), (62, text(9), "en", "s", 1, "a", 2), (63, "long " * 50_000 + text(53), "en", "u", 1, "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size int")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
            before, docs = docs, spark.createDataFrame(out.collect(), docs.schema)
        if name == "exact dedup":  # the text of 9 and 62 stays once, both empty texts are one
            assert docs.count() == before.count() - 3
        if name == "near-dedup":
            assert {r["text"] for r in docs.collect()} >= {text(50), text(51), text(52), text(2)}
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
