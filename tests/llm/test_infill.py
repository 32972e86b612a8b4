import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pulsegrid.llm import infill

TEXT = st.text(alphabet="ab\n\r é日<PSM>", max_size=60)


def plain_infill(text, key, rate=100, spm_rate=50):
    """The rule by lists of lines."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < spm_rate
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=1500, deadline=None)
@given(TEXT, st.integers(0, 500), st.integers(1, 9), st.sampled_from([0, 30, 100]))
def test_ropes_agree_with_lists_of_lines(text, doc, size, rate):
    made = infill.infill(text, f"7:{doc}", rate, size=size)
    assert made == plain_infill(text, f"7:{doc}", rate)
    assert infill.restore(made[-1], made[1], size=size) == text


@settings(max_examples=500, deadline=None)
@given(TEXT, st.integers(0, 70), st.integers(1, 9))
def test_cuts(text, rank, size):
    rope = infill.rope_of(text, size)
    a, b = infill.cut_chars(rope, rank)
    assert (str(a), str(b)) == (text[:rank], text[rank:])
    a, b = infill.cut_lines(rope, rank)
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert (str(a), str(b)) == ("".join(units[:rank]), "".join(units[rank:]))
    assert infill.lines(rope) == len(units)
    for part in (a, b):
        assert (part.chars, part.breaks) == (len(str(part)), str(part).count("\n"))


def test_trees_stay_flat():
    rope = infill.rope_of("line\n" * 200_000, 64)

    def depth(r):
        return 0 if r.left is None else 1 + max(depth(r.left), depth(r.right))

    assert depth(rope) == 14
    head, tail = infill.cut_lines(rope, 77_777)
    assert depth(infill.concat(tail, infill.leaf("<M>"), head)) <= 2 * 14 + 3
    assert str(head) + str(tail) == "line\n" * 200_000


def test_table(spark):
    long = "".join(f"row {i} é日\n" for i in range(60_000)) + "x" * 300_000
    rows = [(1, "a\nb\nc\n", "k"), (2, None, "k"), (3, "", None), (None, "x\ny", "k"), (4, "has <P> in it\n", "k"), (5, long, "k"), (6, "\n", "k"), (6, "\n", "k"), (7, "a\n<", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").selectExpr("*", "1 AS n", "'x' AS form", "'r' AS restored")
    made = infill.restored(infill.infill_documents(docs)).collect()
    found = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, *r[1:]) for r in made), key=lambda r: r[:2])
    want = sorted(((d is not None, d or 0, *plain_infill(t or "", f"7:{'' if d is None else d}"), t or "") for d, t, _ in rows), key=lambda r: r[:2])
    assert found == want
    assert {r[3] for r in found} == {"plain", "psm", "spm"}
    assert infill.infill_documents(docs, rate=0).where("form <> 'plain'").count() == 0
    assert infill.restored(infill.infill_documents(docs.limit(0))).collect() == []
    odd = spark.createDataFrame([("7", "a\nb\n"), ("no number", "a\nb\n")], "doc_id string, text string")
    assert {r["doc_id"] for r in infill.infill_documents(odd).collect()} == {7, None}
