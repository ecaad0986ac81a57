"""Operator 6: toxic spans by a linear-chain conditional random field.

Labels are of documents, so tokens are labelled first: a token of a toxic training
document is toxic if its word or one of its prefixes occurs in toxic training
documents and hardly ever in others. The field (labels: toxic, other) is fitted to
those tokens; forward-backward marginals give spans, and a logistic fit of their
largest and their sum gives the document score. Chains are sentences, of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, in_train, materialise, slices, table

#: Bounds of the training sample: documents of either label, and bytes of all of their whole texts together.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1500, 3000, 64 << 20
#: A word or prefix marks toxic tokens if in this many toxic documents, and this many times as frequent there as in others.
SUPPORT, LIFT = 5, 50
PREFIXES = (3, 4, 5, 6)
BITS, MEMORY = 18, 400_000
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
FINAL = (".", "!", "?", "…", "。")


def core(token: str) -> str:
    return EDGE.sub("", token.lower())


def own_features(token: str) -> list[int]:
    """Hashed features of a token itself."""
    w = core(token)
    shape = "A" if token.isupper() else "a" if token.islower() else "x"
    names = [f"w={w}", f"s={w[-3:]}", f"c={shape}", f"n={min(len(w), 12)}", *(f"p{k}={w[:k]}" for k in PREFIXES if len(w) >= k)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) >> (32 - BITS) for n in names]


def near_feature(token: str, side: str) -> int:
    """Hashed feature that a token gives its neighbour on a side."""
    return zlib.crc32(f"{side}={core(token)[:5]}".encode("utf-8", "surrogatepass")) >> (32 - BITS)


def markers(texts: list[str], toxic: np.ndarray) -> set[str]:
    """Words (with a leading =) and prefixes that mark toxic tokens."""
    seen = {True: Counter(), False: Counter()}
    for t, y in zip(texts, toxic, strict=True):
        words = {core(x) for x in set(t.split())} - {""}
        seen[bool(y)].update({f"={w}" for w in words} | {w[:k] for w in words for k in PREFIXES if len(w) >= k})
    n_toxic, n_clean = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    return {m for m, a in seen[True].items() if a >= SUPPORT and a / n_toxic >= LIFT * (seen[False][m] + 0.5) / n_clean}


def chains(ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where chains begin among the tokens of texts of given sizes. ends: the token ends a sentence."""
    begins = np.zeros(len(ends) + 1, bool)
    begins[0] = True
    begins[np.cumsum(sizes)] = True
    begins[1:][ends] = True
    return np.flatnonzero(begins[: len(ends)])


@dataclass
class Field:
    """Weights for toxic against other; moves[a][b]: log weight of label b after a (1: toxic)."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    fold: np.ndarray  # of the document score: constant, log odds of the largest marginal, log of 1 + their sum

    def messages(self, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios toxic : other of the forward and backward messages. odds: chains x tokens."""
        (oo, ot), (to, tt) = np.exp(self.moves).tolist()
        if len(odds) < 4:  # a chain alone: plain numbers are faster than arrays of one
            pairs = [self._messages(x, oo, ot, to, tt) for x in odds.tolist()]
            return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        forward, backward = np.empty_like(odds), np.empty_like(odds)
        forward[:, 0], backward[:, -1] = odds[:, 0], 1
        for k in range(1, odds.shape[1]):
            r = forward[:, k - 1]
            forward[:, k] = odds[:, k] * (r * tt + ot) / (r * to + oo)
        for k in range(odds.shape[1] - 2, -1, -1):
            q = odds[:, k + 1] * backward[:, k + 1]
            backward[:, k] = (tt * q + to) / (ot * q + oo)
        return forward, backward

    @staticmethod
    def _messages(odds: list[float], oo: float, ot: float, to: float, tt: float) -> tuple[list[float], list[float]]:
        r, forward = odds[0], [odds[0]]
        for x in odds[1:]:
            r = x * (r * tt + ot) / (r * to + oo)
            forward.append(r)
        b, backward = 1.0, [1.0]
        for x in reversed(odds[1:]):
            q = x * b
            b = (tt * q + to) / (ot * q + oo)
            backward.append(b)
        return forward, backward[::-1]

    def marginals(self, scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of toxic for each token of chains that lie one after another."""
        out = np.empty(len(scores))
        sizes = np.diff(np.append(starts, len(scores)))
        odds = np.exp(np.clip(scores, -30, 30))
        for size in np.unique(sizes):
            at = starts[sizes == size][:, None] + np.arange(size)
            forward, backward = self.messages(odds[at])
            out[at] = forward * backward / (1 + forward * backward)
        return out

    def documents(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The two numbers of each document that its score folds."""
        out = np.zeros((len(sizes), 2))
        some = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some]
        top = np.zeros(len(sizes))
        if len(some):
            top[some] = np.maximum.reduceat(p, starts)
            out[some, 1] = np.log1p(np.add.reduceat(np.where(p > 0.05, p, 0), starts))
        top = np.clip(top, 1e-4, 1 - 1e-4)
        out[:, 0] = np.log(top / (1 - top))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.fold[0] + features @ self.fold[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Constant and weights by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w)), slope)
    return w


def fit(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 0.3, decay: float = 1e-6, seed: int = 0) -> Field:
    """Adagrad on the chains' conditional likelihood. Chains without a toxic token are thinned to five for each with one, 2,000 at least."""
    toxic = np.array(labels, bool)
    field = Field(np.zeros(1 << BITS), -4.0, np.zeros((2, 2)), np.array([-4.0, 1.0, 0.0]))
    if not toxic.any() or toxic.all():
        return field
    marks, rng = markers(texts, toxic), np.random.default_rng(seed)
    hit_memory: dict[str, bool] = {}

    def marked(token: str) -> bool:
        if token not in hit_memory:
            w = core(token)
            hit_memory[token] = bool(w) and (f"={w}" in marks or any(len(w) >= k and w[:k] in marks for k in PREFIXES))
        return hit_memory[token]

    yes, no = [], []
    for n, (t, y) in enumerate(zip(texts, toxic, strict=True)):
        tokens = t.split()
        if not tokens:
            continue
        starts = chains(np.array([x.endswith(FINAL) for x in tokens]), np.array([len(tokens)])).tolist()
        for a, b in zip(starts, [*starts[1:], len(tokens)], strict=True):
            (yes if y and any(map(marked, tokens[a:b])) else no).append((n, a, b))
    chosen = sorted(yes + [no[k] for k in rng.permutation(len(no))[: max(2000, 5 * len(yes))].tolist()])
    data, tokens, last = [], [], -1
    for n, a, b in chosen:
        if n != last:
            tokens, last = texts[n].split(), n
        rows = [own_features(x) for x in tokens[a:b]]
        for k in range(b - a):
            rows[k] += ([near_feature(tokens[a + k - 1], "before")] if k else []) + ([near_feature(tokens[a + k + 1], "after")] if a + k + 1 < b else [])
        sizes = np.fromiter(map(len, rows), np.int16, len(rows))
        data.append((np.fromiter(chain.from_iterable(rows), np.int32), sizes, np.array([toxic[n] and marked(x) for x in tokens[a:b]], float)))
    by_size: dict[int, list] = {}
    for one in data:
        by_size.setdefault(len(one[1]), []).append(one)
    packed = []
    for size, own in by_size.items():
        for k in range(0, len(own), 256):
            part = own[k : k + 256]
            of = np.repeat(np.arange(len(part) * size), np.concatenate([x[1] for x in part]))
            packed.append((size, np.concatenate([x[0] for x in part]), of, np.array([x[2] for x in part])))
    seen_w, seen_b, seen_m = np.full(1 << BITS, 1e-2), 1e-2, np.full((2, 2), 1e-2)
    for _ in range(epochs):
        for k in rng.permutation(len(packed)).tolist():
            size, flat, of, truth = packed[k]
            scores = field.bias + np.bincount(of, field.weights[flat], minlength=truth.size).reshape(truth.shape)
            odds = np.exp(np.clip(scores, -30, 30))
            forward, backward = field.messages(odds)
            p = forward * backward / (1 + forward * backward)
            gap = (p - truth) / len(truth)
            touched, back = np.unique(flat, return_inverse=True)
            slope = np.bincount(back, gap.ravel()[of]) + decay * field.weights[touched]
            seen_w[touched] += slope**2
            field.weights[touched] -= rate * slope / np.sqrt(seen_w[touched])
            slope = gap.sum()
            seen_b += slope**2
            field.bias -= rate * slope / np.sqrt(seen_b)
            if size > 1:  # pair marginals: forward(a) * move(a, b) * odds(b) * backward(b)
                move = np.exp(field.moves)
                left = np.stack((np.ones_like(forward[:, :-1]), forward[:, :-1]), -1)
                right = np.stack((np.ones_like(odds[:, 1:]), odds[:, 1:] * backward[:, 1:]), -1)
                pair = left[..., :, None] * move * right[..., None, :]
                pair /= pair.sum(axis=(-1, -2), keepdims=True)
                is_t = np.stack((1 - truth, truth), -1)
                slope = (pair - is_t[:, :-1, :, None] * is_t[:, 1:, None, :]).sum(axis=(0, 1)) / len(truth) + 1e-3 * field.moves
                seen_m += slope**2
                field.moves -= rate * slope / np.sqrt(seen_m)
    scorer = Scorer(field)
    features = np.concatenate([scorer.measures(texts[k : k + 200])[0] for k in range(0, len(texts), 200)])
    # The sample has more toxic documents than the corpus, which only moves the constant; scores are split at one half.
    field.fold = logistic(features, toxic.astype(float))
    return field


class Scorer:
    """Scores texts; remembers what each distinct token adds, which its memory's size bounds."""

    def __init__(self, field: Field):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.empty((0, 4))

    def learn(self, tokens: list[str]) -> None:
        weights, base = self.field.weights, len(self.at)
        rows = np.empty((len(tokens), 4))
        for k, t in enumerate(tokens):
            self.at[t] = base + k
            rows[k] = weights[own_features(t)].sum(), weights[near_feature(t, "before")], weights[near_feature(t, "after")], t.endswith(FINAL)
        self.rows = np.concatenate((self.rows, rows))

    def measures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What documents() gives, all tokens' marginals, and the tokens of each text."""
        if len(self.at) > MEMORY:
            self.clear()
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        self.learn([t for t in dict.fromkeys(flat) if t not in self.at])
        rows = self.rows[np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))]
        if not len(rows):
            return self.field.documents(np.empty(0), sizes), np.empty(0), sizes
        starts = chains(rows[:, 3] > 0, sizes)
        first = np.zeros(len(rows), bool)
        first[starts] = True
        scores = self.field.bias + rows[:, 0]
        scores[1:] += np.where(first[1:], 0, rows[:-1, 1])
        scores[:-1] += np.where(first[1:], 0, rows[1:, 2])
        p = self.field.marginals(scores, starts)
        return self.field.documents(p, sizes), p, sizes


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Start, end (in characters) and marginal of runs of tokens with a marginal of at least least."""
    out: list[dict] = []
    hot = np.flatnonzero(p >= least)
    if not len(hot):
        return out
    wanted, last = {*hot.tolist()}, -2
    for k, m in enumerate(re.finditer(r"\S+", text)) if "\x1c" > max(text, default="") or not re.search("[\x1c-\x1f\x85]", text) else enumerate(re.finditer(r"[^\s\x1c-\x1f\x85]+", text)):
        if k in wanted:
            if last == k - 1:
                out[-1] |= {"stop": m.end(), "p": max(out[-1]["p"], float(p[k]))}
            else:
                out.append({"start": m.start(), "stop": m.end(), "p": float(p[k])})
            last = k
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, yes: int, no: int, most: int, text: str = "text", key: str = "doc_id") -> list:
    """Whole texts of at most yes and no training documents of either label, the least by
    hash of their ids, as many of them in that order as hold at most so many bytes."""
    known = labels.where(in_train(F.col(key))).where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64(key), key).limit(n) for y, n in ((1, yes), (0, no))]
    chosen = materialise(parts[0].unionByName(parts[1]), "toxicity-sample")
    own = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = own.join(F.broadcast(chosen), key).groupBy(key, "label").agg(F.max(F.octet_length("text")).alias("size"), F.xxhash64(key).alias("order")).collect()
    held, fitting = 0, []
    for r in sorted(sizes, key=lambda r: (r.order, r[key])):
        held += r["size"]
        if held <= most:
            fitting.append((r[key],))
        else:
            held -= r["size"]
    if not fitting:
        return []
    taken = docs.sparkSession.createDataFrame(fitting, chosen.select(key).schema)
    rows = own.join(F.broadcast(taken), key).join(F.broadcast(chosen), key).dropDuplicates([key]).collect()
    return sorted(rows, key=lambda r: r[key])


def score(docs: DataFrame, field: Field, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, score and spans (start, stop, p) of each whole text. One row per
    row, repeated rows included; null and empty texts get the score of a text without a
    toxic token. Other columns aren't read. One pass without a shuffle."""
    source = docs.select(*keep, text)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole, len(keep), rows=200):
                texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
                features, p, sizes = scorer.measures(texts)
                ends = np.cumsum(sizes)
                found = [spans(t, p[b - n : b]) for t, b, n in zip(texts, ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scorer.field.score(features)), pa.array(found, kind)], [*keep, "score", "spans"])

    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", score double, spans array<struct<start:int,stop:int,p:double>>"
    return source.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Field:
    rows = sample(docs, labels, "toxic", SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES, text, key)
    return fit([r.text for r in rows], [r.label for r in rows])


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans of every document."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
