import re

import pytest
import xxhash

from idlattice.llm import simhash

from ..conftest import SMALL


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_groups(fps):
    """Least key reachable, by comparing all pairs of distinct fingerprints."""
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for key, f in fps:
        least[find(f)] = min(key, least.get(find(f), key))
    return {key: least[find(f)] for key, f in fps}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    expected = {(k, f"{f:016x}", g) for (k, f), g in zip(fps, plain_groups(fps).values(), strict=True)}
    assert {tuple(r) for r in simhash.op8_simhash(spark, SMALL).collect()} == expected


@pytest.mark.parametrize("seed", range(3))
def test_links_of_close_fingerprints(spark, seed):
    import random

    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(300):
        values.append(rng.choice(values) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    fps = [(k, v) for k, v in enumerate(values)]
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(set(values))]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    roots = {r.node & (1 << 64) - 1: r.root for r in simhash.components(edges, "t").collect()}
    groups = plain_groups(fps)
    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            assert (roots.get(a, a) == roots.get(b, b)) == (groups[i] == groups[j])


def test_edges_of_the_input(spark):
    schema = "text string, doc_id long, fp string, component_id string, shard string"
    rows = [(None, 5), ("", 3), (" \n", 9), ("one", 4), ("ONE", 2), ("one two", 7), (None, 5), ("x " * 60000, 11), ("y z w", None), ("Y Z W", 12)]
    docs = spark.createDataFrame([(t, k, "f", "c", "s") for t, k in rows], schema)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.groups(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (4, 2), (2, 2), (7, 7), (5, 3), (11, 11), (None, 12), (12, 12)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 2, 7, 11, None, 12], key=str)
    assert simhash.groups(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0
