"""Toxicity by weak supervision.

1. Training rows are sampled up to a bound for each kind (toxic, other, without a label), and near copies among them are
   reduced to one row, so that a much copied text doesn't make its words look toxic.
2. Words and word beginnings that are significantly more frequent in toxic rows are the lexicon; it is counted by Spark
   over the sample, and its entries are binned by kind and log-odds.
3. Voters give 1 (toxic), 0 (not) or abstain: one per bin of the lexicon, thresholds on how many and how dense hits are,
   patterns of the text (capitals, exclamation marks, masked letters, symbols), and the label as one more, fallible voter,
   which abstains on rows without a label.
4. A generative label model starts from what the voters say and estimates, by expectation maximisation, each voter's
   accuracies in both classes, the label's included, and the correlations between voters that remain inside the classes;
   a voter's evidence is divided by one plus its positive correlations, so voters that repeat each other don't count
   twice.  It gives posterior labels to all sampled rows, labelled or not.
5. A linear (logistic) classifier on counts by bin and pattern measures is trained on the posterior labels and scores
   every whole text.

Training rows are those whose crc32(doc_id as text) mod 3 is not 1; no count, weight or word comes from the labels of the
others.  Labels, language, source and doc_id are no inputs of a score.

Cases: a null text counts as empty and gets a score like others.  Texts of any length are read whole.  Of repeated labels
of a doc_id the largest counts; null labels count as none.  A row without doc_id is held out.  Without toxic or without
other training rows all scores are ``NO_MODEL``.  Repeated rows get the same score.  Empty tables give no rows.  Columns
beyond those named are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut_lineage

#: Training rows sampled of each kind (about): the bound of what the model is fitted on.
TOXIC_ROWS, OTHER_ROWS, UNLABELLED_ROWS = 8_000, 16_000, 4_000
NO_MODEL = 0.0
UNLABELLED = -1
BINS = 6
PREFIXES = range(4, 10)
LETTERS = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"\w[*@#$]+\w")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def text_tokens(text: str) -> set[str]:
    """Distinct words, and their beginnings marked by a star."""
    words = set(LETTERS.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}


def near_key(text: str) -> int:
    """Smallest hash of the pairs of neighbouring words: equal for most near copies."""
    words = LETTERS.findall(text.lower())
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:])} or {text}
    return min(xxhash.xxh64_intdigest(p) for p in pairs) - 2**63


def training_sample(
    documents: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS, unlabelled_rows: int = UNLABELLED_ROWS
) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, text, toxic (-1: no label) of the sampled training rows, one of each group of near copies of a kind; and
    how many training rows a sampled row of each kind stands for."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut_lineage(known)
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    training = documents.where(~held_out(F.col("doc_id")))
    n[UNLABELLED] = training.select("doc_id").count()
    most = {1: toxic_rows, 0: other_rows, UNLABELLED: unlabelled_rows}
    share = {kind: math.ceil(1e6 * min(1.0, most[kind] / rows)) if rows else 0 for kind, rows in n.items()}
    million = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    chosen = F.lit(False)
    for label in (0, 1):
        chosen = chosen | ((F.col("toxic") == label) & (million < share.get(label, 0)))
    side = known.where(chosen | (million < share[UNLABELLED]))  # about toxic_rows + other_rows + unlabelled_rows rows at most
    side = side.select(F.col("doc_id").alias("of"), "toxic", chosen.alias("chosen"))
    rows = training.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(side), F.col("doc_id") == F.col("of"), "left")
    rows = rows.where(F.col("chosen") | (F.col("of").isNull() & (million < share[UNLABELLED])))

    def keyed(batches):
        for batch in batches:
            keys = [near_key(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "near"])

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("toxic", F.lit(UNLABELLED)).alias("toxic"))
    rows = rows.mapInArrow(keyed, "doc_id long, text string, toxic int, near long")
    first = F.row_number().over(Window.partitionBy("near", "toxic").orderBy("doc_id", "text"))
    sample = cut_lineage(rows.withColumn("first", first).where("first = 1").select("doc_id", "text", "toxic"))
    return sample, {kind: 1e6 / part for kind, part in share.items() if part}


def mined_lexicon(sample: DataFrame, n_toxic: int, n_other: int) -> list[tuple[str, float]]:
    """(token, log-odds) of tokens of labelled rows more frequent in toxic ones than chance among all tokens allows."""

    def counted(batches):
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def sent():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts)), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["token", "pos", "neg"]
            )

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for token in text_tokens(text):
                    counts[token][toxic] += 1
            if len(counts) > 200_000:
                yield sent()
                counts.clear()
        if counts:
            yield sent()

    tokens = sample.where(F.col("toxic") != UNLABELLED).mapInArrow(counted, "token string, pos long, neg long").groupBy("token").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 2")
    tokens = cut_lineage(tokens)
    tested = tokens.count()
    a, b = F.col("pos"), F.col("neg")
    part = n_toxic / (n_toxic + n_other)
    # Likelihood ratio of the token's rows against the share of toxic rows.
    gain = 2 * (a * F.log(a / ((a + b) * part)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - part)))).otherwise(0))
    odds = F.log((a + 0.5) / (n_toxic - a + 0.5)) - F.log((b + 0.5) / (n_other - b + 0.5))
    kept = tokens.withColumns({"gain": gain, "odds": odds}).where((F.col("odds") > math.log(3)) & (F.col("gain") > 2 * math.log(max(tested, 2)) + 2))
    return [(r["token"], r["odds"]) for r in kept.orderBy(F.desc("gain"), "token").collect()]  # words of the sampled toxic rows


class Measures:
    """Counts and pattern measures of a text, given the lexicon."""

    def __init__(self, lexicon: list[tuple[str, float]], bins: int = BINS):
        self.bin_of: dict[str, int] = {}
        for kind, own in enumerate(([t for t in lexicon if not t[0].endswith("*")], [t for t in lexicon if t[0].endswith("*")])):
            for i, (token, _) in enumerate(sorted(own, key=lambda t: (-t[1], t[0]))):
                self.bin_of[token] = kind * bins + i * bins // len(own)
        self.n_bins = 2 * bins
        self.words: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = [b for t in (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)) if (b := self.bin_of.get(t)) is not None]
        if len(self.words) > 400_000:
            self.words.clear()
        self.words[word] = found = tuple(sorted(set(found)))
        return found

    def __call__(self, text: str) -> np.ndarray:
        """By bin: hits.  Then words, words with a hit, distinct words with a hit, capitals, exclamations, masked, symbols."""
        out = np.zeros(self.n_bins + 7)
        words = LETTERS.findall(text.lower())
        known, of_word, hits = self.words, self.of_word, []
        for w in words:
            bins = known.get(w)
            if bins is None:
                bins = of_word(w)
            if bins:
                hits.append(w)
                for b in bins:
                    out[b] += 1
        n = self.n_bins
        size = max(len(text), 1)
        capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        out[n:] = len(words), len(hits), len(set(hits)), capitals / size, text.count("!") / size, len(MASKED.findall(text)), sum(map(text.count, "#$%&*@")) / size
        return out


def features(m: np.ndarray, n_bins: int) -> np.ndarray:
    """Inputs of the linear classifier, one row per text."""
    words, hits, distinct = m[:, n_bins], m[:, n_bins + 1], m[:, n_bins + 2]
    density = 100 * hits / np.maximum(words, 1)
    return np.column_stack([
        np.log1p(m[:, :n_bins]), m[:, :n_bins] > 0, np.log1p(hits), np.log1p(distinct), hits > 0, distinct > 1, np.log1p(density), np.sqrt(density),
        np.log1p(words) / 10, m[:, n_bins + 3], m[:, n_bins + 4] * 10, np.log1p(m[:, n_bins + 5]), m[:, n_bins + 6], np.ones(len(m)),
    ])


#: Inputs beyond the hits, at the end of a row of features: they may speak for or against.
FREE_INPUTS = 6


def votes(m: np.ndarray, n_bins: int) -> np.ndarray:
    """Voters by column: 1, 0, or -1 (abstains)."""
    words, hits, distinct = m[:, n_bins], m[:, n_bins + 1], m[:, n_bins + 2]
    out = [m[:, b] > 0 for b in range(n_bins)]
    out += [hits > 0, hits > 1, distinct > 1, distinct > 2, hits > words / 200, hits > words / 50]
    out += [m[:, n_bins + 3] > 0.3, m[:, n_bins + 4] > 0.01, m[:, n_bins + 5] > 0, m[:, n_bins + 6] > 0.02]
    out = np.column_stack(out).astype(np.int8)
    out[words == 0] = -1
    return out


#: Where the label model starts: a voter's chance to vote 1 in class 0 and in class 1; the label's chance to be right.
START, LABEL_RIGHT = (0.05, 0.5), 0.9


def label_model(v: np.ndarray, gold: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior probability of label 1 from votes and (fallible) labels; gold is -1 where there is none.

    Each voter has a probability for each vote in either class; what correlation is left between two voters inside the
    classes divides their evidence.  All start from the same rates, the label as a better voter than others; those count
    as ten rows, so the accuracies, the label's too, follow from the data.
    """
    v = np.column_stack([v, gold.astype(np.int8)])
    n, k = v.shape
    kinds = np.stack([v == a for a in (0, 1, -1)], axis=2).astype(float)  # rows, voters, votes
    prior = np.empty((k, 2, 3))
    for c, one in enumerate(START):
        prior[:, c] = [1 - one, one, 0.1]
    prior[-1] = [[LABEL_RIGHT, 1 - LABEL_RIGHT, 0.1], [1 - LABEL_RIGHT, LABEL_RIGHT, 0.1]]
    chance = prior / prior.sum(axis=2, keepdims=True)
    ratio = np.log(chance[:, 1] / chance[:, 0])
    some = gold >= 0
    share = min(max(float((gold[some] == 1).mean()) if some.any() else 0.5, 1e-4), 1 - 1e-4)
    # At first the voters beside the label speak with one voice: the mean of their evidence.
    logit = math.log(share / (1 - share)) + np.einsum("nkv,kv->n", kinds[:, :-1], ratio[:-1]) / math.sqrt(k) + kinds[:, -1] @ ratio[-1]
    post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    prior *= 10
    signal = np.where(v == 1, 1.0, np.where(v == 0, -1.0, 0.0))
    for _ in range(rounds):
        both = np.stack([1 - post, post])
        chance = np.einsum("cn,nkv->kcv", both, kinds) + prior
        chance /= chance.sum(axis=2, keepdims=True)
        rest = np.zeros((k, k))
        for c in both:
            centred = (signal - (c @ signal) / max(c.sum(), 1e-9)) * np.sqrt(c)[:, None]
            rest += centred.T @ centred
        spread = np.sqrt(np.maximum(np.diag(rest), 1e-9))
        related = np.clip(rest / spread[:, None] / spread[None, :], 0, 1)
        np.fill_diagonal(related, 0)
        related[-1], related[:, -1] = 0, 0  # the labels are no copy of another voter
        weight = 1 / (1 + related.sum(axis=1))
        ratio = np.log(chance[:, 1] / chance[:, 0])  # voters, votes
        share = min(max(post.mean(), 1e-4), 1 - 1e-4)
        logit = math.log(share / (1 - share)) + np.einsum("nkv,kv,k->n", kinds, ratio, weight)
        now = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(now - post).max() < 1e-4:
            return now
        post = now
    return post


def linear_classifier(x: np.ndarray, soft: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25, free: int = FREE_INPUTS) -> np.ndarray:
    """Coefficients of a logistic regression on soft labels, by Newton steps.

    Inputs that count hits may not lower a score: those that would are left out and the rest is fitted again.
    """
    used = np.ones(x.shape[1], bool)
    while True:
        own, beta = x[:, used], np.zeros(int(used.sum()))
        penalty = ridge * np.eye(len(beta))
        penalty[-1, -1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(own @ beta, -30, 30)))
            step = np.linalg.solve((own * (weight * p * (1 - p))[:, None]).T @ own + penalty, own.T @ (weight * (soft - p)) - penalty @ beta)
            beta += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
        out = np.zeros(x.shape[1])
        out[used] = beta
        against = out < 0
        against[-free:] = False
        if not against.any():
            return out
        used &= ~against


def fit(documents: DataFrame, labels: DataFrame, **bounds) -> tuple[list[tuple[str, float]], np.ndarray] | None:
    """The lexicon and the coefficients, or None without rows of both classes."""
    sample, stands_for = training_sample(documents, labels, **bounds)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    lexicon = mined_lexicon(sample, n[1], n[0])
    width = 2 * BINS + 7

    def measured(batches):
        measures = Measures(lexicon)
        for batch in batches:
            rows = [measures(x).tolist() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "toxic", "m"])

    rows = sample.mapInArrow(measured, "doc_id long, toxic int, m array<double>").orderBy("doc_id", "toxic", "m").toPandas()  # bounded by the sample
    m, gold = np.array(rows["m"].tolist()).reshape(-1, width), rows["toxic"].to_numpy()
    posterior = label_model(votes(m, 2 * BINS), gold)
    # A row weighs as many rows as it stands for.
    weight = np.array([stands_for[kind] for kind in gold.tolist()]) / stands_for[1]
    return lexicon, linear_classifier(features(m, 2 * BINS), posterior, weight)


def score_toxicity(documents: DataFrame, labels: DataFrame, at_least: float = 0.7, **bounds) -> DataFrame:
    """documents: doc_id, text.  labels: doc_id, toxic.  Returns doc_id, held_out, score, predicted, one row per document."""
    rows = documents.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    model = fit(documents, labels, **bounds)
    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(NO_MODEL).alias("score"))
    else:
        scored = rows.select("doc_id", "held_out", scorer(*model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= at_least).cast("int"))


def scorer(lexicon, beta):
    """Arrow function from a column of texts to their scores."""

    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        measures = Measures(lexicon)
        for texts in parts:
            m = np.array([measures(x) for x in texts.to_pylist()]).reshape(len(texts), -1)
            yield pa.array(1 / (1 + np.exp(-np.clip(features(m, 2 * BINS) @ beta, -30, 30))))

    return F.arrow_udf(score, "double")


def without_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model = fit(documents, labels, **{k: v for k, v in options.items() if k != "at_least"})
    if model is None:
        return documents
    return documents.where(scorer(*model)(F.coalesce("text", F.lit(""))) < options.get("at_least", 0.7))
