"""Operator 7: a quality classifier from positive and unlabelled documents.

Positives are training documents labelled 1; unlabelled documents are drawn from the
whole corpus and their labels never read. A small network minimises the
non-negative unbiased risk of Kiryo et al. (2017) with the logistic loss, so its
output is a probability. The class prior is estimated over all documents: the least
ratio of their share above a threshold to the positives' share, under classifiers that
tell positives from unlabelled documents, each on the half that it wasn't fitted to.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import CLASSES, class_counts, repeated_lines, repeated_words, shares
from .shared import STOP_WORDS, held_out, in_train, slices, table, text_bytes

#: Bounds of the training sample, in documents.
POSITIVES, UNLABELLED = 8000, 16000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 512, 0.01, 1e-4
#: Ways to halve the documents, for the class prior.
HALVES = 6
NAMES = (
    [f"class{k}" for k in range(CLASSES)]
    + "stop long_words word_length log_words repeated lines_repeated runs distinct top_word marked shouted ended line_length".split()
)
STOP = {w.encode() for words in STOP_WORDS.values() for w in words}


def features(text: bytes) -> np.ndarray:
    """Numbers that describe a whole text; all 0 without words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(len(NAMES))
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    plain = sum(w.isalpha() or not w.isascii() for w in words)
    return np.concatenate((
        shares(class_counts(text)),
        [
            sum(w in STOP for w in text.lower().split()) / n,
            (lengths > 12).mean(),
            min(lengths.mean(), 40) / 10,
            np.log1p(n) / 10,
            repeated_words(words) / n,
            repeated_lines(text) / len(lines),
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            len(counts) / n,
            max(counts.values()) / n,
            1 - plain / n,
            sum(w.isupper() for w in words) / n,
            sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
            np.log1p(n / len(lines)) / 10,
        ],
    ))


@dataclass
class Net:
    """Standardises features (and their squares), then one hidden layer."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    @classmethod
    def start(cls, x: np.ndarray, rng: np.random.Generator) -> Net:
        scale = np.maximum(x.std(axis=0), 1e-3)
        d = x.shape[1]
        return cls(x.mean(axis=0), scale, [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b, v, c = self.layers
        hidden = np.tanh(z @ w + b)
        return hidden, hidden @ v + c[0]

    def backward(self, z: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Gradients for the slopes of the risk by each row's output."""
        inner = slope[:, None] * self.layers[2] * (1 - hidden**2)
        return [z.T @ inner, inner.sum(axis=0), hidden.T @ slope, np.array([slope.sum()])]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.scaled(x))[1], -30, 30)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def fit_net(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 0, epochs: int = EPOCHS) -> Net:
    """prior None: tells positives from unlabelled; else minimises the non-negative risk.

    Risk: prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]). Where the second
    part of a batch is negative, the step goes up that part instead.
    """
    rng = np.random.default_rng(seed)
    net = Net.start(np.concatenate((positive, unlabelled)), rng)
    zp, zu = net.scaled(positive), net.scaled(unlabelled)
    first, second, step = [np.zeros_like(x) for x in net.layers], [np.zeros_like(x) for x in net.layers], 0
    steps = max(1, len(zu) // BATCH)
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
        for _ in range(steps):
            p, u = zp[rng.integers(0, len(zp), BATCH)], zu[rng.integers(0, len(zu), BATCH)]
            z = np.concatenate((p, u))
            hidden, out = net.forward(z)
            sp, su = sigmoid(out[:BATCH]), sigmoid(out[BATCH:])
            if prior is None:
                slope = np.concatenate(((sp - 1) / BATCH, su / BATCH))
            elif softplus(out[BATCH:]).mean() - prior * softplus(out[:BATCH]).mean() >= 0:
                slope = np.concatenate((prior * (sp - 1) / BATCH - prior * sp / BATCH, su / BATCH))
            else:
                slope = np.concatenate((prior * sp / BATCH, -su / BATCH))
            step += 1
            for k, g in enumerate(net.backward(z, hidden, slope)):
                g = g + DECAY * net.layers[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.layers[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


@dataclass
class Halving:
    """A classifier fitted to one half of the sample, and thresholds with the share of the other half's positives above each."""

    net: Net
    cuts: np.ndarray
    positive_share: np.ndarray


def halvings(positive: np.ndarray, in_positive: np.ndarray, unlabelled: np.ndarray, in_unlabelled: np.ndarray, seed: int = 0) -> list[Halving]:
    """in_...: a column for each way to halve, True for the half to fit to. Thresholds keep at least a fifth of the positives."""
    out = []
    for k in range(in_positive.shape[1]):
        p, q, u = positive[in_positive[:, k]], positive[~in_positive[:, k]], unlabelled[in_unlabelled[:, k]]
        if len(p) and len(q) and len(u):
            net = fit_net(p, u, None, seed + k, epochs=20)
            q = np.sort(net.probability(q))
            cuts = np.quantile(q, np.linspace(0, 0.8, 81))
            out.append(Halving(net, cuts, 1 - np.searchsorted(q, cuts, "left") / len(q)))
    return out


def class_prior(found: list[Halving], shares_above: list[np.ndarray]) -> float:
    """Share of positives among all documents, from the documents' shares above each halving's thresholds: the mean of the least ratios."""
    ratios = [(share / h.positive_share).min() for h, share in zip(found, shares_above, strict=True)]
    return float(np.clip(np.mean(ratios), 0.05, 0.99)) if ratios else 0.5


def fitted_half(key) -> object:
    """array<boolean>: for each way to halve, whether a document is in the half that classifiers are fitted to."""
    return F.array(*[F.xxhash64(F.lit(f"half{k}"), key) % 2 == 0 for k in range(HALVES)])


def shares_above(docs: DataFrame, found: list[Halving], text: str, key: str) -> list[np.ndarray]:
    """Of all documents in the half not fitted to, the share above each threshold: one pass that counts in the tasks and sends a row each."""
    shared = docs.sparkSession.sparkContext.broadcast(found)
    size = sum(len(h.cuts) + 1 for h in found)
    source = docs.select(F.col(text).alias("text"), fitted_half(F.col(key)).alias("half"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = shared.value, np.zeros(size, np.int64)
        for whole in batches:
            for batch in slices(whole, 0):
                x = np.array([features(t) for t in text_bytes(batch.column(0))])
                half = np.array(batch.column(1).to_pylist(), bool)
                counts = []
                for k, h in enumerate(found):
                    own = np.sort(h.net.probability(x[~half[:, k]]))
                    counts += [[len(own)], len(own) - np.searchsorted(own, h.cuts, "left")]
                total += np.concatenate(counts).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "n"])

    totals = np.zeros(size)
    for r in source.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        totals[r["at"]] = r["n"]
    out, at = [], 0
    for h in found:
        out.append(totals[at + 1 : at + 1 + len(h.cuts)] / max(totals[at], 1))
        at += len(h.cuts) + 1
    return out


def rows_of(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """keep and features (array<double>) of each whole text; one pass."""
    source = docs.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or b"") for t in batch.column(len(keep)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], [*keep, "features"])

    return source.mapInArrow(run, ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", features array<double>")


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and halves of trusted positives, then of unlabelled documents: the least by hash of their ids."""
    trusted = labels.where(in_train(F.col(key)) & (F.col("quality") == 1)).select(F.col(key).alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(POSITIVES).withColumn("positive", F.lit(True))
    narrow = docs.where(in_train(F.col(key))).select(F.col(key).alias("k"), F.col(text).alias("text"))
    corpus = narrow.select("k").distinct().orderBy(F.xxhash64(F.lit("unlabelled"), "k"), "k").limit(UNLABELLED).withColumn("positive", F.lit(False))
    chosen = F.broadcast(trusted.unionByName(corpus).groupBy("k").agg(F.max("positive").alias("p"), F.max(~F.col("positive")).alias("u")))
    joined = narrow.join(chosen, "k").withColumn("half", fitted_half(F.col("k")))
    found = rows_of(joined, "text", ("k", "p", "u", "half")).dropDuplicates(["k"]).collect()
    found.sort(key=lambda r: r.k)
    own = [[r for r in found if r[c]] for c in ("p", "u")]
    return [(np.array([r.features for r in rows], float).reshape(-1, len(NAMES)), np.array([r.half for r in rows], bool).reshape(-1, HALVES)) for rows in own]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Net | None:
    """None without positives or unlabelled documents."""
    (positive, in_positive), (unlabelled, in_unlabelled) = sample(docs, labels, text, key)
    if len(positive) < 2 or len(unlabelled) < 2:
        return None
    found = halvings(positive, in_positive, unlabelled, in_unlabelled)
    prior = class_prior(found, shares_above(docs, found, text, key)) if found else 0.5
    rng = np.random.default_rng(1)
    return fit_net(rng.permutation(positive), rng.permutation(unlabelled), prior)


def score(docs: DataFrame, net: Net | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and the score of each whole text. One row per row, repeated
    rows included; null and empty texts are scored as texts without words; all scores
    are 0.5 without a trained net. Other columns aren't read. One pass without a shuffle."""
    source = docs.select(*keep, text)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            if net is None:
                out = np.full(batch.num_rows, 0.5)
            else:
                out = net.probability(np.array([features(t or b"") for t in batch.column(len(keep)).cast(pa.binary()).to_pylist()]).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out)], [*keep, "score"])

    return source.mapInArrow(run, ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", score double")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
