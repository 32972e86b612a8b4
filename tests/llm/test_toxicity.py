import random
import zlib

import numpy as np
import pytest
from pulsegrid.llm import toxicity
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def scored(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(d, l).join(l.select("doc_id", "toxic"), "doc_id").toPandas()
    return rows


def test_held_out_accuracy(scored):
    assert (scored["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in scored["doc_id"]]).all()
    rows = scored[scored["held_out"]]
    hit = (rows["predicted"] == 1) & (rows["toxic"] == 1)
    assert hit.sum() >= 0.85 * (rows["toxic"] == 1).sum()
    assert hit.sum() >= 0.97 * (rows["predicted"] == 1).sum()
    assert rows["score"].between(0, 1).all()


def test_label_model_finds_good_and_bad_and_repeated_voters():
    rng = np.random.default_rng(5)
    y = (rng.random(4000) < 0.2).astype(int)
    flip = lambda p: np.where(rng.random(4000) < p, y, 1 - y)
    noise = (rng.random(4000) < 0.3).astype(int)
    votes = np.column_stack([flip(0.9), flip(0.85), noise, noise, noise, np.where(rng.random(4000) < 0.5, -1, flip(0.8))]).astype(np.int8)
    gold = np.where(rng.random(4000) < 0.95, y, 1 - y)
    post = toxicity.label_model(votes, gold)
    assert ((post > 0.5) == y).mean() > 0.96
    assert ((post > 0.5) == y).mean() >= (gold == y).mean()


def test_edge_cases(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=20) + [["stupid"], ["moron"], ["moron", "stupid"]][i % 3] * (i % 4 == 0)), 1, "x") for i in range(400)] + [(1000, None, 1, "x"), (1001, "", 1, "x"), (1002, "moron " * 50_000, 1, "x"), (None, "stupid moron", 1, "x"), (3, "again", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 5) for i in range(400)] + [(0, 0, 5), (None, 1, 5), (2000, None, 5)], "doc_id long, toxic int, held_out int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[1000] == score[1001] < 0.5 < score[1002]
    assert {r["doc_id"]: r["held_out"] for r in got}[None] is True
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    none = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}


def test_held_out_labels_do_not_move_scores(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    other = l.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert other.where("toxic = 1").count() != l.where("toxic = 1").count()
    assert sorted(toxicity.score_toxicity(d, l).collect()) == sorted(toxicity.score_toxicity(d, other).collect())


def test_label_model_does_without_most_labels_and_moves_off_wrong_ones():
    rng = np.random.default_rng(6)
    y = (rng.random(6000) < 0.2).astype(int)
    flip = lambda p: np.where(rng.random(6000) < p, y, 1 - y)
    votes = np.column_stack([flip(0.95), flip(0.93), flip(0.9), flip(0.85)]).astype(np.int8)
    gold = np.where(rng.random(6000) < 0.2, np.where(rng.random(6000) < 0.85, y, 1 - y), -1)
    post = toxicity.label_model(votes, gold)
    assert ((post > 0.5) == y)[gold < 0].mean() > 0.96
    wrong = (gold >= 0) & (gold != y)
    assert ((post > 0.5) == y)[wrong].mean() > 0.6
