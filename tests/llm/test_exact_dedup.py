import hashlib

from pulsegrid.llm import exact_dedup, shared
from pyspark.sql import Row
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, key int, kept string"
LONG = "Word " * 40_000
ROWS = [(1, "a b", 0, "x"), (2, "A B", 1, "y"), (3, None, 2, "z"), (4, "", 3, "w"), (4, "", 3, "w"), (5, LONG, 1, "v"), (6, LONG.upper(), 1, "v"), (7, "É", 1, "q"), (8, "é", 1, "q"), (None, "n", 1, "q"), (9, "N", 2, "q"), (None, "only", 1, "q")]


def brute(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(lower(t), []).append(d)
    out, used = [], set()
    for d, t, *_ in rows:
        n = lower(t)
        known = [x for x in groups[n] if x is not None]
        keep = max(known) if known else None
        out.append((d, keep, len(groups[n]), d == keep and (n, d) not in used, hashlib.sha256(n.encode()).hexdigest()))
        if d == keep:
            used.add((n, d))
    return sorted(map(repr, out))


def result(frame):
    return sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in frame.collect())


def test_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert result(exact_dedup.dedup_classes(docs)) == brute(ROWS)
    assert exact_dedup.dedup_classes(docs.limit(0)).count() == 0
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(Row(doc_id=d, text=t, key=k, kept=x)) for d, t, k, x in [ROWS[1], ROWS[3], ROWS[6], ROWS[7], ROWS[8], ROWS[10], ROWS[11]])
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0


def test_keep_one_is_what_the_classes_say(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    monkeypatch.setattr(exact_dedup, "HELD_BYTES", 20_000)
    want = {r["doc_id"] for r in exact_dedup.dedup_classes(docs).where("kept").collect()}
    kept = exact_dedup.keep_one(docs.repartition(7), capacity=10).collect()
    assert {r["doc_id"] for r in kept} == want and len(kept) == len(want)
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert all(texts[r["doc_id"]] == r for r in kept)


def test_the_index_is_kept_in_files(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    exact_dedup.write_index(docs, str(tmp_path / "index"), capacity=2)
    index = exact_dedup.read_index(spark, str(tmp_path / "index"))
    assert index.agg(F.sum("group_size")).first()[0] == len(ROWS)
    assert spark.read.parquet(str(tmp_path / "index" / "directory")).agg(F.sum("keys")).first()[0] == len(ROWS)


def test_hot_groups_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    rows = [(i % 3 if i % 2 else None, "hot text") for i in range(200)] + [(None, "no id")] * 50 + [(i, f"t {i}") for i in range(30)]
    assert result(exact_dedup.dedup_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_buckets_split_and_cover_all_slots(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key")).unionByName(spark.range(500).select(F.lit(7).cast("long").alias("key")))
    buckets = exact_dedup.directory(keys, capacity=100, max_depth=8)
    assert sum(2 ** (8 - d) for _, d, _ in buckets) == 256
    slots = sorted(s for p, d, _ in buckets for s in range(p << 8 - d, (p + 1) << 8 - d))
    assert slots == list(range(256))
    assert max(d for _, d, _ in buckets) == 8  # the hot key's bucket cannot split further
    assert exact_dedup.directory(keys.limit(0)) == [(0, 0, 0)]
    assert sum(n for *_, n in buckets) == 3500


def test_many_buckets_and_flushes_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    monkeypatch.setattr(exact_dedup, "HELD_BYTES", 2_000)
    assert result(exact_dedup.dedup_classes(docs.repartition(5), capacity=3, max_depth=10)) == want


def test_colliding_keys_are_told_apart_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"key": [1, 1, 1, 2], "text": [b"a", b"b", b"a", b"a"], "n": [1, 2, 3, 4], "last": [5, None, 4, 9]})
    rows = [tuple(r.values()) for b in exact_dedup._owned([batch]) for r in b.to_pylist()]
    sha = lambda t: hashlib.sha256(t).digest()
    assert rows == [(1, sha(b"a"), 5, 4), (1, sha(b"b"), None, 2), (2, sha(b"a"), 9, 4)]


def test_a_hot_text_does_not_keep_its_batches():
    import gc

    import pyarrow as pa

    hot, kinds = "copy " * 1_000, [("doc_id", pa.int64()), ("text", pa.string())]
    most = 0

    def batches():
        nonlocal most
        for n in range(60):
            texts = [hot] * 1_999 + [f"single {n}"]
            docs = pa.StructArray.from_arrays([pa.array(range(n * 2_000, (n + 1) * 2_000)), pa.array(texts)], ["doc_id", "text"])
            yield pa.RecordBatch.from_arrays([docs.field(0), docs], ["doc_id", "doc"])
            gc.collect()
            most = max(most, pa.total_allocated_bytes())

    before = pa.total_allocated_bytes()
    rows = [r for b in exact_dedup._firsts(1)(batches()) for r in b.to_pylist()]
    assert len(rows) == 61 and max(r["doc_id"] for r in rows if r["doc"]["text"] == hot) == 60 * 2_000 - 2
    assert most - before < 60_000_000  # a batch has 10 MB
