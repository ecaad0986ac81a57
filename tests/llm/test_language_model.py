import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from idlattice.llm import language_model as lm

from ..conftest import TINY


def plain_tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lowered), None]


def plain_discounts(counts):
    c = Counter(counts)
    if all(c[k] for k in (1, 2, 3, 4)):
        y = c[1] / (c[1] + 2 * c[2])
        d = [k - (k + 1) * y * c[k + 1] / c[k] for k in (1, 2, 3)]
        if all(0 < x < k for k, x in enumerate(d, 1)):
            return d
    return [0.5, 1.0, 1.5]


class Plain:
    """The model over dictionaries."""

    def __init__(self, texts):
        self.count, self.pairs = Counter(), Counter()
        for text in texts:
            words = plain_tokens(text)
            self.count.update(words)
            self.pairs.update(zip(["<s>", *words], words))  # noqa: B905
        self.context, self.before, self.begun = Counter(), Counter(), defaultdict(Counter)
        for (a, b), n in self.pairs.items():
            self.context[a] += n
            self.before[b] += 1
            self.begun[a][min(n, 3)] += 1
        self.d1, self.d2 = plain_discounts(self.before.values()), plain_discounts(self.pairs.values())
        self.n, self.v = self.count.total(), len(self.count)
        self.given, self.followers = sum(self.d1[min(n, 3) - 1] for n in self.before.values()), self.before.total()

    def probability(self, a, b):
        less = lambda n, d: n - d[min(n, 3) - 1] if n else 0.0
        alone = (less(self.before[b], self.d1) + self.given / (self.v + 1)) / self.followers
        if a not in self.context:
            return alone
        share = sum(self.d2[k - 1] * n for k, n in self.begun[a].items()) / self.context[a]
        return less(self.pairs[a, b], self.d2) / self.context[a] + share * alone

    def row(self, text):
        words = plain_tokens(text)
        base = sum(math.log10((self.count[w] + 1) / (self.n + self.v + 1)) for w in words)
        own = sum(math.log10(self.probability(a, b)) for a, b in zip(["<s>", *words], words)) if self.v else 0.0  # noqa: B905
        return len(words), sum(w in self.count for w in words), base, own


def same(got, expected):
    assert got[:2] == expected[:2]
    assert got[2:] == pytest.approx(expected[2:], rel=1e-9, abs=1e-9)


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()}
    held = {k for k in docs if zlib.crc32(str(k).encode()) % 7 == 2}
    plain = Plain([t for k, t in docs.items() if k not in held])
    rows = lm.op12_lm_scoring(spark, TINY).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.held_out, r.train_tokens) == (r.doc_id in held, plain.n)
        same((r.n_tokens, r.n_known, r.base_score, r.score), plain.row(docs[r.doc_id]))
    # The model is better than single words on texts that it hasn't seen.
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_probabilities_add_up_to_one():
    plain = Plain(["a b a c", "a b", "b b c d a b", "c", "a a b d"])
    for a in ["<s>", "a", "b", "c", "d", "new"]:
        total = sum(plain.probability(a, b) for b in [*plain.count, "new"])
        assert total == pytest.approx(1)


def test_many_shards_and_small_parts(spark, monkeypatch):
    """Parts are folded and dealt often; the result is the same."""
    texts = [f"w{k % 7} w{k % 11} common w{k % 3}" for k in range(200)] + ["common " * 500]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    plain = Plain(texts)
    monkeypatch.setattr(lm, "SHARD", 50)
    model = lm.train(docs)
    assert model.shards > 10 and model.vocabulary.tokens == plain.n
    for r in lm.perplexity(lm.score(docs, model)).collect():
        expected = plain.row(texts[r.doc_id])
        same((r.n_tokens, r.n_known, r.base_score, r.score), expected)
        assert r.perplexity == pytest.approx(10 ** (-expected[3] / expected[0]))


def test_sums_fold(monkeypatch):
    monkeypatch.setattr(lm, "HELD", 10)
    sums, expected, rng = lm.Sums(2), Counter(), np.random.default_rng(1)
    for _ in range(50):
        keys = np.unique(rng.integers(0, 1 << 63, 3).astype(np.uint64) % np.uint64(40))
        sums.add(keys, np.ones((2, len(keys)), np.int64))
        expected.update(keys.tolist())
    parts = list(lm.packed(sums, lambda k: (k % np.uint64(3)).astype(np.int64)))
    got = {}
    for p in parts:
        shard, n, keys, counts = (c[0].as_py() for c in p.columns)
        values = lm.values_of(counts, 2 * n).view(np.int64).reshape(2, n)
        for k, a, b in zip(np.cumsum(lm.values_of(keys, n), dtype=np.uint64).tolist(), *values.tolist(), strict=True):
            assert k % 3 == shard and a == b
            got[k] = a
    assert got == expected


def test_edges_of_the_input(spark):
    schema = "text string, doc_id long, score string, shard int"
    texts = [(None, 1), ("", 2), ("  \n", None), ("A a Ä a", 4), ("A a Ä a", 4), ("x " * 100_000, 5)]
    docs = spark.createDataFrame([(t, k, "s", 9) for t, k in texts], schema)
    held = [zlib.crc32(str("" if k is None else k).encode()) % 7 == 2 for _, k in texts]
    plain = Plain([t for (t, _), h in zip(texts, held, strict=True) if not h])
    rows = lm.scores(docs).collect()
    expected = sorted((str(k), *plain.row(t)) for t, k in texts)
    for r, e in zip(sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in rows), expected, strict=True):
        assert r[0] == e[0]
        same(r[1:], e[1:])
    assert lm.scores(docs.limit(0)).count() == 0
    # Nothing to learn from: probability 1 for everything.
    untrained = lm.score(docs, lm.train(docs.limit(0))).where("doc_id = 4").first()
    assert (untrained.n_tokens, untrained.n_known, untrained.base_score, untrained.score) == (5, 0, 0.0, 0.0)
