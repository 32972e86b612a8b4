from pulsegrid.llm import chat
from pyspark.sql import functions as F


def read(frame):
    out = frame.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))}).collect()
    return {(r["tree"], r["leaf"]): ([(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in out}


def test_trees_cycles_and_ranks(spark):
    rows = [
        (1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "good", 3.0), (1, 2, 0, "assistant", "bad", 1.0), (1, 3, 1, "user", "more", 0.0), (1, 4, 3, "assistant", "end", 2.0),
        (2, 0, None, "user", "alone", None), (2, 9, 77, "user", "orphan", 0.0), (3, 0, 1, "user", "c", 0.0), (3, 1, 0, "user", "d", 0.0), (3, 2, 1, "assistant", "below a cycle", 0.0),
        (None, 0, None, "user", None, 0.0), (None, 1, 0, None, "no role", 0.0),
    ]
    nodes = spark.createDataFrame([(*r, "x") for r in rows], "tree long, node long, parent long, role string, text string, score double, formatted string").drop("formatted")
    got = read(chat.format_branches(nodes, best=None))
    assert got == {
        (1, 4): ([("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")], "goodend"), (1, 2): ([("user", "q"), ("assistant", "bad")], "bad"),
        (2, 0): ([("user", "alone")], ""), (2, 9): ([("user", "orphan")], ""), (None, 1): ([("user", ""), ("", "no role")], ""),
    }
    assert set(read(chat.format_branches(nodes, best=1))) == {(1, 4), (2, 0), (None, 1)}
    assert chat.format_branches(nodes.limit(0)).count() == 0


def test_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "\\b \\\\b \\l<|user|>\n", "<s>\\", "\\\\", "", "é[日]本\r\n</s>\n", None, "a\\</s>\n<|assistant|>\n[", "x" * 100_000 + "<"]
    rows = [(1, i, "assistant" if i % 2 else "us<er|>", t) for i, t in enumerate(texts)] + [(2, 5, "user", "same turn b"), (2, 5, "user", "same turn a"), (2, None, "system", "no turn")]
    conv = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int")
    made = chat.format_branches(chat.linear_nodes(conv), best=None)
    got = read(made)
    turns, loss = got[(1, len(texts) - 1)]
    assert turns == [("assistant" if i % 2 else "us<er|>", t or "") for i, t in enumerate(texts)]
    assert loss == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert got[(2, 2)][0] == [("system", "no turn"), ("user", "same turn a"), ("user", "same turn b")]
    for r in made.collect():
        for s in r["loss_spans"]:
            assert r["formatted"][s["end"] : s["end"] + 5] == "</s>\n"
            assert r["formatted"][: s["start"]].endswith("|>\n")


def test_long_chains(spark):
    conv = spark.createDataFrame([(1, i, "user", str(i)) for i in range(150)], "conv_id long, turn long, role string, text string")
    assert [t for _, t in read(chat.format_branches(chat.linear_nodes(conv)))[(1, 149)][0]] == [str(i) for i in range(150)]
