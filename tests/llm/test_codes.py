import numpy as np
from pulsegrid.llm import codes
from pulsegrid.llm.queries import op13_codes


def plain_codes(rows, parts, entries, rounds):
    """rows: (id, vector) in the order of ids.  Loops over rows, parts and entries with Python's integers."""
    size = len(rows[0][1])
    cut = np.array_split(range(size), parts)
    books = [[[v[i] for i in at] for _, v in rows[:entries]] for at in cut]

    def assigned(v):
        found = []
        for book, at in zip(books, cut, strict=True):
            far = [sum((v[i] - c) ** 2 for i, c in zip(at, e, strict=True)) for e in book]
            found.append((far.index(min(far)), min(far)))
        return found

    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            for p, (k, _) in enumerate(assigned(v)):
                groups.setdefault((p, k), []).append([v[i] for i in cut[p]])
        for (p, k), members in groups.items():
            books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    last = [(i, assigned(v)) for i, v in rows]
    return [(i, bytes(k for k, _ in a), sum(d for _, d in a)) for i, a in last], books


def compared(spark, rows, schema="id long, vec array<long>", parts=3, entries=4, rounds=2):
    coded, books = codes.compress(spark.createDataFrame(rows, schema), parts, entries, rounds)
    found = sorted(((r["id"], bytes(r["code"]), r["error"]) for r in coded.collect()), key=repr)
    want, entries = plain_codes(sorted((r[:2] for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])), parts, entries, rounds)
    assert found == sorted(want, key=repr)
    assert [e.tolist() for e in books.entries] == entries
    return coded, books


def test_against_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.integers(-9, 9, 7).tolist()) for i in rng.permutation(300)]
    coded, books = compared(spark, rows)
    for r in codes.decode(coded, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(r["vec"], r["approx"], strict=True)) == r["error"]
    assert sum(r["error"] for r in coded.collect()) < sum(r["error"] for r in codes.compress(spark.createDataFrame(rows, "id long, vec array<long>"), 3, 4, 0)[0].collect())


def test_ties_repeats_null_ids_and_small_tables(spark):
    compared(spark, [(1, [0, 0, 0]), (2, [2, 2, 2]), (3, [1, 1, 1])], entries=2)  # 1 is as near to 0 as to 2
    compared(spark, [(1, [5, 5, 5])] * 6 + [(1, [1, 2, 3]), (None, [9, 9, 9]), (None, [0, 0, 0])])
    compared(spark, [(7, [1, -1])], parts=3)  # a part without components
    compared(spark, [(1, []), (2, [])])


def test_unused_entries_stay(spark):
    _, books = compared(spark, [(1, [0]), (2, [0]), (3, [100])], parts=1, entries=2, rounds=1)
    assert books.entries[0].tolist() == [[33], [0]]  # floor(100 / 3); entry 1 is never first


def test_numbers_beyond_64_bits(spark):
    big = 2**62
    coded, _ = compared(spark, [(1, [0, 3, 5]), (2, [2**31, -(2**31), 1]), (3, [2**30, 7, -(2**31)])], entries=2)
    rows = [(1, [0, 0, 0]), (2, [big, -big, 1]), (3, [-(2**63), 2**63 - 1, 0])]
    coded, _ = codes.compress(spark.createDataFrame(rows, "id long, vec array<long>"), 3, 1, 1)
    assert max(r["error"] for r in coded.collect()) == 2**63 - 1


def test_rows_that_take_no_part_and_other_columns(spark):
    rows = [(1, [1, 2], "a", "b"), (2, None, "a", "b"), (3, [1, None], "a", "b"), (4, [1, 2, 3], "a", "b"), (5, [4, 4], None, "b")]
    coded, _ = codes.compress(spark.createDataFrame(rows, "id long, vec array<long>, code string, n string"), 2, 4, 2)
    assert sorted((r["id"], r["n"], bytes(r["code"]), r["error"]) for r in coded.collect()) == [(1, "b", b"\0\0", 0), (5, "b", b"\1\1", 0)]
    coded, books = codes.compress(spark.createDataFrame([], "id long, vec array<long>"))
    assert books is None and coded.collect() == []


def test_query_on_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    vec = [0.25 * i for i in range(64)]
    rows = [(1, vec, 1), (2, None, 1), (3, [nan, *vec[1:]], 1), (4, [inf, *vec[1:]], None), (5, [None, *vec[1:]], 2), (6, [-0.001, *vec[1:]], None), (6, vec, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = op13_codes(spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["error"], r["label_error"]) for r in found) == [(1, 0, 0), (6, 0, 0), (6, 0, 0)]
    assert {len(r["code"]) for r in found} == {32} and len({r["codebooks_sha256"] for r in found}) == 1
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op13_codes(spark, f"{tmp_path}/none").collect() == []
