"""Operator 8: SimHash near-duplicate detection with BK-trees.

Each distinct fingerprint goes to six shards, one for each two of its four 16-bit
blocks: two fingerprints that differ in at most 2 bits agree in at least two
blocks, so they meet in a shard. A shard's BK-tree has children keyed by their
Hamming distance to the parent; a search follows only edges within the radius.
A shard is as large as the number of distinct fingerprints with 32 equal bits, and
its tree is built where its queries are. A tree over all fingerprints would grow
with the corpus and may therefore not be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_ids, components, materialise, sorted_groups, table

SHINGLE, RADIUS, SEED = 3, 2, 42


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 majority bits of the shingles' XXH64, repeats included; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - shingle + 1, 1)
    stops = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts[:last].tolist(), stops.tolist(), strict=True)], np.uint64, last)
    ones = np.zeros(64, np.int64)
    for k in range(0, last, 65536):  # bounds the memory for very long texts
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): fp is the fingerprint's bits as a signed long. One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter([fingerprint(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp bigint")


class BkTree:
    """Nodes in arrays; a node's children by their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        values, children = self.values, self.children
        values.append(value)
        children.append({})
        at, new = 0, len(values) - 1
        while new:
            d = (values[at] ^ value).bit_count()
            if (child := children[at].get(d)) is None:
                children[at][d] = new
                break
            at = child
        return new

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found


def shard_links(values: list[int], radius: int) -> list[int]:
    """For each value the index of the first value of its local component."""
    tree, root = BkTree(), list(range(len(values)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = find(j), find(k)
            root[max(a, b)] = min(a, b)
        tree.add(v)
    return [find(k) for k in range(len(values))]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints as all pairs within the radius do.

    A shard emits one edge from each fingerprint to the first of its local
    component, so a group of n costs n rows, not n * n.
    """
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree for a radius of 0 to 2 only")
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = F.array(*[F.lit(n << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for n, (i, j) in enumerate(combinations(range(4), 2))])
    shards = fps.select("fp", F.explode(keys).alias("shard")).repartition("shard").sortWithinPartitions("shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in sorted_groups(batches, "shard"):
            signed = group.column("fp").to_pylist()
            for k, j in enumerate(shard_links([v & 0xFFFFFFFFFFFFFFFF for v in signed], radius)):
                if j != k:
                    a.append(signed[k])
                    b.append(signed[j])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return shards.mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id): the least key that links reach, its own included.

    Null and empty texts have fingerprint 0 and are linked like any other. A null
    key never becomes a component's id unless all its keys are null. Repeated rows
    give a row each. Other columns aren't read. The join of documents with
    components has one row per fingerprint on one side; adaptive execution splits
    a fingerprint with very many documents.
    """
    own = materialise(fingerprints(docs, text, key), "simhash")
    least = materialise(own.groupBy("fp").agg(F.min(key).alias("least")), "simhash-fp")
    linked = components(links(least.select("fp"), radius), "simhash-links")
    rooted = least.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    merged = rooted.where("root <> fp").select("root", "least").unionByName(rooted.where("root = fp").select("root", "least")).groupBy("root").agg(F.min("least").alias("component_id"))
    per_fp = rooted.join(merged, "root").select("fp", "component_id")
    return own.join(per_fp, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The documents without those that are not their group's least key.

    Of rows that have that key and its text in common one stays. Rows with a null key
    stay: no key tells them apart.
    """
    keyed = docs.where(F.col(key).isNotNull())
    gone = groups(keyed, text, key, radius).where(F.col("component_id") < F.col(key)).select(key)
    kept = by_ids(docs, materialise(gone, "simhash-gone"), key, "left_anti")
    several = materialise(kept.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "simhash-several")
    return by_ids(kept, several, key, "left_anti").unionByName(by_ids(kept, several, key, "left_semi").dropDuplicates([key, text]))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
