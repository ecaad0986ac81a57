"""Operator 12: scores of a word bigram model with interpolated modified Kneser-Ney smoothing.

Counting is two grouped sums. Tasks count what they read, pack sorted keys and counts,
and send each shard of keys its part; the shard's task adds the parts up. The model
is what these tasks write: files of sorted 64-bit keys and their counts, hashes of
words first, then pairs of word numbers (a word's number is its hash's place). Workers
map the files into memory and look up a batch's distinct keys in key order; they
compute probabilities from counts, so that nothing about a text has to be shuffled.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, slices, table, text_bytes

#: Distinct keys that a task holds before it sends them on; training tokens per shard of pairs; words whose hash a worker remembers.
HELD, SHARD, MEMORY = 1_000_000, 2_000_000, 100_000
#: The end of a text is the hash of no bytes, which no word has. A word's number takes 32 bits.
END = xxhash.xxh64_intdigest(b"")
MOST_WORDS = (1 << 32) - 2
#: Fixed value: Knuth's multiplier, spreads pairs over shards.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def held_out(key) -> object:
    """True where crc32 of the id as text, modulo 7, is 2; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 7 == 2


class Hashes(dict):
    """Words by their hash, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def tokens(texts: list[bytes], memory: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, an end behind each text's, and the places behind the ends."""
    words = [t.lower().split() for t in texts]  # on bytes: A-Z, and the six ASCII white-space characters
    stops = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
    out = np.full(int(stops[-1]) if len(stops) else 0, END, np.uint64)
    begin = 0
    for own, stop in zip(words, stops.tolist(), strict=True):
        out[begin : stop - 1] = np.fromiter(map(memory.__getitem__, own), np.uint64, len(own))
        begin = stop
    return out, stops


def planes(values: np.ndarray) -> bytes:
    """Eight bytes of each value, all first bytes first, compressed: small numbers take little room."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def values_of(data: bytes, n: int) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(data, 8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and, for each, the sums of the columns of counts."""
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts, axis=1)
    order = np.argsort(all_keys, kind="stable")
    all_keys = all_keys[order]
    first = np.flatnonzero(np.concatenate(([True], all_keys[1:] != all_keys[:-1]))) if len(all_keys) else np.empty(0, np.int64)
    return all_keys[first], np.add.reduceat(all_counts[:, order], first, axis=1) if len(first) else all_counts


class Sums:
    """Counts by key, added up whenever many parts are held."""

    def __init__(self, columns: int = 1):
        self.keys: list[np.ndarray] = [np.empty(0, np.uint64)]
        self.counts: list[np.ndarray] = [np.empty((columns, 0), np.int64)]
        self.held = self.distinct = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.distinct + HELD:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = added(self.keys, self.counts)
        self.keys, self.counts, self.held, self.distinct = [keys], [counts], len(keys), len(keys)
        return keys, counts


def stretches(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Where each distinct value begins and stops; none of no values."""
    cuts = np.flatnonzero(np.diff(sorted_values, prepend=-1))
    return list(zip(cuts.tolist(), np.append(cuts[1:], len(sorted_values))[: len(cuts)].tolist(), strict=True))


PACKED = "shard int, n int, keys binary, counts binary"


def packed(sums: Sums, shard_of) -> Iterator[pa.RecordBatch]:
    """A row for each shard that has keys: differences of its sorted keys, and counts, column by column."""
    keys, counts = sums.fold()
    shards = shard_of(keys)
    order = np.argsort(shards, kind="stable")
    for begin, stop in stretches(shards[order]):
        own = order[begin:stop]
        row = [[int(shards[own[0]])], [len(own)], [planes(np.diff(keys[own], prepend=np.uint64(0)))], [planes(counts[:, own].ravel())]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "n", "keys", "counts"])


def summed(parts: DataFrame, shards: int, columns: int, finish, numbers: list[str]) -> DataFrame:
    """One row for each shard: finish(keys, counts) gives its bytes and numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shard = Sums(columns), None
        for batch in batches:
            for shard, n, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.add(np.cumsum(values_of(keys, n), dtype=np.uint64), values_of(counts, columns * n).view(np.int64).reshape(columns, n))
        if shard is not None:
            data, *rest = finish(shard, *sums.fold())
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary()), *[pa.array([int(x)], pa.int64()) for x in rest]], ["shard", "data", *numbers])

    return parts.repartitionById(shards, "shard").mapInArrow(run, ", ".join(["shard int", "data binary", *[f"{x} bigint" for x in numbers]]))


def save(rows: DataFrame, path: str) -> list[dict]:
    """Writes a file for each row, its bytes and a line end; the file's folders hold its numbers. Gives numbers and uri by shard."""
    spark, names = rows.sparkSession, [c for c in rows.columns if c != "data"]
    rows.withColumn("data", F.col("data").cast("string")).write.partitionBy(*names).text(path)
    found = []
    for uri in spark.read.schema("value string").text(path).inputFiles():
        found.append({k: int(v) for k, v in re.findall(r"/(\w+)=(\d+)(?=/)", uri)} | {"uri": uri})
        if not uri.startswith("file:"):
            spark.sparkContext.addFile(uri)
    return sorted(found, key=lambda x: x["shard"])


def mapped(uri: str) -> np.memmap:
    """A file in a shared folder is mapped where it is; from other stores Spark has brought it to this machine."""
    return np.memmap(unquote(urlparse(uri).path) if uri.startswith("file:") else SparkFiles.get(os.path.basename(uri)), np.uint8, "r")


def of_range(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def of_pair(pairs: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return of_range(pairs * SPREAD, shards)


def found_in(wanted: np.ndarray, shard_of, shards: list, place) -> np.ndarray:
    """For sorted distinct keys place(shard, index) of those that are there, else -1; shards: the sorted keys of each."""
    out = np.full(len(wanted), -1, np.float64)
    own = shard_of(wanted)
    order = np.argsort(own, kind="stable")
    for begin, stop in stretches(own[order]):
        at = order[begin:stop]
        k = int(own[at[0]])
        if (keys := shards[k]) is not None and len(keys):
            index = np.minimum(np.searchsorted(keys, wanted[at]), len(keys) - 1)
            there = keys[index] == wanted[at]
            out[at[there]] = place(k, index[there])
    return out


@dataclass(frozen=True)
class Vocabulary:
    """Files of words: sorted hashes, then their counts. A word's number is its place among all."""

    shards: int
    files: tuple
    tokens: int
    words: int

    @property
    def starts(self) -> list[int]:
        sizes = {f["shard"]: f["size"] for f in map(dict, self.files)}
        return np.concatenate(([0], np.cumsum([sizes.get(k, 0) for k in range(self.shards)]))).astype(np.int64).tolist()

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Of sorted distinct hashes; -1 for those of no word."""
        keys, starts = hash_arrays(self)[0], self.starts
        return found_in(hashes, lambda h: of_range(h, self.shards), keys, lambda k, index: starts[k] + index).astype(np.int64)


@lru_cache(maxsize=4)
def hash_arrays(vocabulary: Vocabulary) -> tuple[list, list]:
    """By shard the hashes and counts, or None."""
    keys, counts = [None] * vocabulary.shards, [None] * vocabulary.shards
    for f in map(dict, vocabulary.files):
        raw, m = mapped(f["uri"]), f["size"]
        keys[f["shard"]], counts[f["shard"]] = raw[: 8 * m].view(np.uint64), raw[8 * m : 16 * m].view(np.int64)
    return keys, counts


@dataclass(frozen=True)
class Model:
    """The vocabulary and the files of pairs and of what is known of each word as a context and a follower."""

    vocabulary: Vocabulary
    shards: int
    pairs: tuple
    words: tuple
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    followers: int  # distinct pairs
    rare: tuple[int, int]  # words that follow one other, and two


@lru_cache(maxsize=4)
def pair_arrays(model: Model) -> tuple[list, list]:
    keys, counts = [None] * model.shards, [None] * model.shards
    for f in map(dict, model.pairs):
        raw, m = mapped(f["uri"]), f["size"]
        keys[f["shard"]], counts[f["shard"]] = raw[: 8 * m].view(np.uint64), raw[8 * m : 12 * m].view(np.float32)
    return keys, counts


@lru_cache(maxsize=4)
def word_arrays(model: Model) -> list:
    """By shard of words, the start of a text last: rows (words before, pairs counted once, twice, more often) or None."""
    out = [None] * (model.vocabulary.shards + 1)
    for f in map(dict, model.words):
        out[f["shard"]] = mapped(f["uri"])[: 32 * f["size"]].view(np.int64).reshape(4, f["size"])
    return out


def fixed(rows: list[dict]) -> tuple:
    return tuple(tuple(sorted(r.items())) for r in rows)


def count_words(train: DataFrame, text: str, path: str) -> Vocabulary:
    """One pass: hashes of words with their counts, sorted over all shards."""
    shards = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, sums = Hashes(), Sums()
        for whole in batches:
            for batch in slices(whole, 0, most=1 << 20):
                keys, counts = np.unique(tokens(text_bytes(batch.column(0)), memory)[0], return_counts=True)
                sums.add(keys, counts[None])
                if sums.distinct > HELD:
                    yield from packed(sums, lambda h: of_range(h, shards))
                    sums = Sums()
        yield from packed(sums, lambda h: of_range(h, shards))

    parts = train.select(text).mapInArrow(run, PACKED)
    files = save(summed(parts, shards, 1, lambda shard, keys, counts: (keys.tobytes() + counts[0].tobytes(), len(keys), counts.sum()), ["size", "total"]), path)
    n = sum(f["size"] for f in files)
    if n > MOST_WORDS:
        raise ValueError(f"{n} distinct words: a word's number takes 32 bits")
    return Vocabulary(shards, fixed(files), sum(f["total"] for f in files), n)


def pair_keys(vocabulary: Vocabulary, hashes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's number, that of the token before it (behind all words' numbers: the start of a text), -1 if unknown, and the number's place among those of the batch."""
    distinct, place = np.unique(hashes, return_inverse=True)
    own = vocabulary.numbers(distinct)[place]
    before = np.concatenate(([vocabulary.words], own[:-1])) if len(own) else own
    before[stops[:-1]] = vocabulary.words
    return own, before, place


def count_pairs(train: DataFrame, text: str, vocabulary: Vocabulary, shards: int, path: str) -> list[dict]:
    """A second pass: pairs of a token and the one before it, with their counts, in the shards that they spread to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, sums = Hashes(), Sums()
        for whole in batches:
            for batch in slices(whole, 0, most=1 << 20):
                own, before, _ = pair_keys(vocabulary, *tokens(text_bytes(batch.column(0)), memory))
                keys, counts = np.unique(before.astype(np.uint64) << np.uint64(32) | own.astype(np.uint64), return_counts=True)
                sums.add(keys, counts[None])
                if sums.distinct > HELD:
                    yield from packed(sums, lambda p: of_pair(p, shards))
                    sums = Sums()
        yield from packed(sums, lambda p: of_pair(p, shards))

    def finish(shard: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
        return keys.tobytes() + counts[0].astype(np.float32).tobytes(), len(keys), *[(counts == k).sum() for k in (1, 2, 3, 4)]

    return save(summed(train.select(text).mapInArrow(run, PACKED), shards, 1, finish, ["size", "c1", "c2", "c3", "c4"]), path)


def count_neighbours(spark: SparkSession, vocabulary: Vocabulary, pairs: list[dict], path: str) -> list[dict]:
    """From the pairs, by word: different words before it, and pairs that it begins counted once, twice, more often."""
    starts = np.array(vocabulary.starts)
    shard_of = lambda numbers: np.searchsorted(starts, numbers.astype(np.int64), side="right") - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, m in zip(batch.column("uri").to_pylist(), batch.column("size").to_pylist(), strict=True):
                raw, sums = mapped(uri), Sums(4)
                for k in range(0, m, HELD):
                    stop = min(m, k + HELD)
                    keys, counts = raw[8 * k : 8 * stop].view(np.uint64), raw[8 * m + 4 * k : 8 * m + 4 * stop].view(np.float32)
                    own, before = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)
                    one = np.zeros((4, len(keys)), np.int64)
                    one[0] = 1
                    sums.add(own, one)
                    sums.add(before, np.stack([np.zeros(len(keys), bool), counts == 1, counts == 2, counts > 2]).astype(np.int64))
                yield from packed(sums, shard_of)

    def finish(shard: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
        first = int(starts[shard]) if shard < vocabulary.shards else vocabulary.words
        dense = np.zeros((4, int(starts[shard + 1]) - first if shard < vocabulary.shards else 1), np.int64)
        dense[:, keys.astype(np.int64) - first] = counts
        return dense.tobytes(), dense.shape[1], counts[0].sum(), *[(counts[0] == k).sum() for k in (1, 2, 3, 4)]

    todo = spark.createDataFrame([(f["uri"], f["size"], k) for k, f in enumerate(pairs)], "uri string, size long, k int")
    parts = todo.repartitionById(max(1, len(pairs)), "k").mapInArrow(run, PACKED)
    return save(summed(parts, vocabulary.shards + 1, 4, finish, ["size", "total", "c1", "c2", "c3", "c4"]), path)


def discounts(c1: int, c2: int, c3: int, c4: int) -> tuple[float, float, float]:
    """What counts of one, two and more give up, from how many counts are 1 to 4.

    Too few counts for an estimate in bounds: a half, one and one and a half.
    """
    if min(c1, c2, c3, c4) > 0:
        y = c1 / (c1 + 2 * c2)
        found = 1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3
        if all(0 < d < k for k, d in enumerate(found, 1)):
            return found
    return 0.5, 1.0, 1.5


def train(docs: DataFrame, text: str = "text") -> Model:
    """The model of all rows, in files of the shared folder. Null and empty texts are an end alone; repeated rows count as often."""
    spark = docs.sparkSession
    path = new_path(spark, "language-model")
    vocabulary = count_words(docs, text, f"{path}/words")
    shards = -(-vocabulary.tokens // SHARD) or 1
    pairs = count_pairs(docs, text, vocabulary, shards, f"{path}/pairs") if vocabulary.words else []
    words = count_neighbours(spark, vocabulary, pairs, f"{path}/neighbours") if pairs else []
    over = lambda rows, *names: [sum(r[n] for r in rows) for n in names]
    # Nothing stands before the start of a text, so it adds nothing to the words' sums.
    return Model(vocabulary, shards, fixed(pairs), fixed(words), discounts(*over(pairs, "c1", "c2", "c3", "c4")), discounts(*over(words, "c1", "c2", "c3", "c4")), *over(words, "total"), tuple(over(words, "c1", "c2")))


@dataclass(frozen=True)
class Known:
    """What the model has of some words, by number; -1 is no word."""

    count: np.ndarray
    before: np.ndarray
    begun: np.ndarray  # three rows


def known(model: Model, numbers: np.ndarray) -> Known:
    """numbers: sorted and distinct."""
    starts = np.array([*model.vocabulary.starts, model.vocabulary.words + 1])
    counts, rows = hash_arrays(model.vocabulary)[1], word_arrays(model)
    out = np.zeros((5, len(numbers)), np.int64)
    shard = np.searchsorted(starts, numbers, side="right") - 1
    # Empty shards have the start of the next one, so the last of equal starts is taken.
    for k in np.unique(shard[numbers >= 0]).tolist():
        at = np.flatnonzero((shard == k) & (numbers >= 0))
        inside = numbers[at] - starts[k]
        if k < model.vocabulary.shards:
            out[0, at] = counts[k][inside]
        if rows[k] is not None:
            out[1:, at] = rows[k][:, inside]
    return Known(out[0], out[1], out[2:])


def less(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    """Counts without their discounts; 0 stays 0."""
    return counts - np.array([0.0, *by])[np.minimum(counts, 3).astype(np.int64)]


def log_probabilities(model: Model, hashes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its count in training and log10 of its probability behind the token before it."""
    vocabulary = model.vocabulary
    if not vocabulary.words:
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes))
    own, before, _ = pair_keys(vocabulary, hashes, stops)
    numbers = np.unique(np.concatenate((own, before)))
    about = known(model, numbers)
    at, at_before = np.searchsorted(numbers, own), np.searchsorted(numbers, before)
    seen_once, seen_twice = model.rare
    left = np.dot(model.word_discounts, (seen_once, seen_twice, vocabulary.words - seen_once - seen_twice))
    alone = ((less(about.before, model.word_discounts) + left / (vocabulary.words + 1)) / model.followers)[at]
    # A text's start has come as often as its end.
    end = known(model, vocabulary.numbers(np.array([END], np.uint64))).count[0]
    times = np.where(numbers == vocabulary.words, end, about.count)
    share = np.dot(model.pair_discounts, about.begun) / np.maximum(times, 1)
    both = np.flatnonzero((own >= 0) & (before >= 0))
    pairs, place = np.unique(before[both].astype(np.uint64) << np.uint64(32) | own[both].astype(np.uint64), return_inverse=True)
    keys, counts = pair_arrays(model)
    found = found_in(pairs, lambda p: of_pair(p, model.shards), keys, lambda k, index: counts[k][index])
    high = np.zeros(len(own))
    high[both] = less(np.maximum(found, 0), model.pair_discounts)[place] / times[at_before[both]]
    # Behind a token that training lacks, or that only ever ended it, the word alone counts.
    weight = np.where(before >= 0, share[at_before], 1.0)
    return about.count[at], np.log10(high + weight * alone)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and n_tokens, n_known, base_score, score of each row's whole text; null counts as empty.

    One pass without a shuffle. Without training tokens every probability is 1.
    """
    source = docs.select(*keep, text)
    names = [*keep, "n_tokens", "n_known", "base_score", "score"]
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens bigint", "n_known bigint", "base_score double", "score double"])
    all_tokens = model.vocabulary.tokens + model.vocabulary.words + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Hashes()
        for whole in batches:
            for batch in slices(whole, len(keep), most=1 << 20):
                hashes, stops = tokens(text_bytes(batch.column(len(keep))), memory)
                counts, own = log_probabilities(model, hashes, stops)
                starts = np.concatenate(([0], stops[:-1]))
                base = np.log10((counts + 1) / all_tokens)
                columns = [stops - starts, np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(own, starts)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, columns)], names)

    return source.mapInArrow(run, schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds the perplexity of a token, 10 to the power of the mean loss."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def scores(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learning from those not held out."""
    model = train(docs.where(~held_out(F.col(key))), text)
    out = score(docs, model, text, (key,))
    return out.select(key, held_out(F.col(key)).alias("held_out"), "n_tokens", "n_known", F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op12_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return scores(table(spark, sf_dir, "documents"))
