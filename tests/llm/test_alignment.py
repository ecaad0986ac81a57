import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from idlattice.llm import alignment

from ..conftest import TINY

PATHS = alignment.vocabularies()
A, B = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
A.encode_special_tokens = True
BYTE = alignment.byte_level()


def plain_tokens(text):
    """(id, bytes) of both sides by the libraries, on the whole text."""
    a = A.encode(" " + text, add_special_tokens=False).ids if text else []
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in a]
    b = [(i, B.id_to_piece(i)) for i in B.encode(text)] if text else []
    b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for i, p in b]
    whole = (" " + text).encode()
    return (a, b) if text and all(b"".join(x for _, x in side) == whole for side in (a, b)) else ([], [])


def plain(rows):
    """Groups by walking along both sides, links by all pairs of a group."""
    seen, held = [], Counter()
    for key, text in rows:
        a, b = plain_tokens(text or "")
        groups, own, at = [], ([], []), [0, 0]
        left = [list(reversed(a)), list(reversed(b))]
        while left[0] or left[1]:
            side = 0 if (at[0] <= at[1] and left[0]) or not left[1] else 1
            token, data = left[side].pop()
            own[side].append(token)
            at[side] += len(data)
            if at[0] == at[1]:
                groups.append(own)
                own = ([], [])
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        held.update(set(links))
        seen.append((key, a, b, groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for key, a, b, groups, links in seen:
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        best = sum(n for p, n in links.items() if held[p] == most[p[0]])
        out.append((key, len(a), len(b), len(groups), links.total(), best, sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


ODD = [None, "", " ", "a", "  two  spaces ", "\tTab\n\nline   x", "<|endoftext|> <s> </s> <unk>", "▁mark", "naïve 北京 한국어 🙂🙂", "á e\x00f \x1c g", "x" * 3000, "=" * 999, "e e e e e", "aaa aaa aaa"]


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in alignment.op13_alignment(spark, TINY).collect()), key=str) == plain(docs)


@pytest.mark.parametrize(("broadcast_rows", "many"), [(0, 256), (5, 2), (10**6, 1)])
def test_either_way_to_the_counts(spark, monkeypatch, broadcast_rows, many):
    """Counts by a broadcast, a shuffle or both; groups by all pairs or by distinct ids."""
    monkeypatch.setattr(alignment, "MANY", many)
    rng = random.Random(broadcast_rows)
    words = ["the", "cat", "Zwölf", "zzzz", "=====", "résumé", "北京", "12345678", "don't"]
    rows = list(enumerate([*ODD, *[" ".join(rng.choices(words, k=30)) for _ in range(20)]]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.digests(docs, *PATHS, broadcast_rows=broadcast_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_units_give_the_libraries_tokens(text):
    found, numbers = alignment.sides(*PATHS).units([text])
    a, b = (np.frombuffer(b"".join(found[u][side] for u in numbers[0]), np.int32).tolist() for side in (0, 1))
    assert (a, b) == tuple([i for i, _ in side] for side in plain_tokens(text))


def test_edges_of_the_input(spark):
    schema = "text string, doc_id long, a string, links string, row int, pair int, n_a string"
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "a"), (None, "a cat"), (9, "long text " * 30_000)]
    docs = spark.createDataFrame([(t, k, "a", "l", 1, 2, "n") for k, t in rows], schema)
    got = alignment.digests(docs, *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    assert alignment.digests(docs.limit(0), *PATHS).count() == 0


def test_distinct_groups_are_sent_once(spark):
    """Texts of thousands of different units made of few groups: Spark builds links and texts of these few."""
    rng = random.Random(1)
    made = [" ".join("".join(rng.choices(["tion", "er", "ing", "ber", "qu"], k=rng.randint(1, 7))) for _ in range(500)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").coalesce(1)
    rows = alignment.tokenise(docs, *PATHS).collect()
    groups = [(tuple(r.a[i:j]), tuple(r.b[k:m])) for r in rows for i, j, k, m in zip(r.a_stops, r.a_stops[1:], r.b_stops, r.b_stops[1:], strict=False)]
    n_units = len(set(" ".join(made).split()))
    assert len(rows) == 1 and len(groups) == len(set(groups)) < n_units / 4
    assert {d.key: (d.n_a, d.n_b) for d in rows[0].docs} == {k: tuple(map(len, plain_tokens(t))) for k, t in enumerate(made)}


@pytest.mark.parametrize(("memory", "group_bytes"), [(3, 64 << 20), (40, 64 << 20), (400_000, 0)])
def test_forgetting_changes_no_group(monkeypatch, memory, group_bytes):
    for name, value in (("MEMORY", memory), ("GROUP_BYTES", group_bytes), ("AT_ONCE", 2), ("LONGEST", 5)):
        monkeypatch.setattr(alignment, name, value)
    both, rng = alignment.Sides(*PATHS), random.Random(memory)
    words = ["the", "cat", "Zwölf", "zzzz", "résumé\n", "北京", "12345678", "don't", "\x00", "\tx", ""]
    for _ in range(20):
        texts = [t or "" for t in [*rng.sample(ODD, 3), *(" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(5))]]
        found, numbers = both.units(texts)
        got = [tuple([i for n in own for i in np.frombuffer(found[n][side], np.int32).tolist()] for side in (0, 1)) for own in numbers]
        assert got == [tuple([i for i, _ in side] for side in plain_tokens(t)) for t in texts]
