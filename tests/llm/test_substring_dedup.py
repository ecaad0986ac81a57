import random
import re

import numpy as np
import pytest

from idlattice.llm import substring_dedup as S
from idlattice.llm import words as W

from ..conftest import SMALL, TINY

WHITE = "\x20\x09-\x0d"


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_words(text):
    return re.findall(f"[^{WHITE}]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_lines(text):
    return [tuple(w) for line in (text or "").split("\n") if (w := plain_words(line))]


def brute_clusters(docs, similarity=0.8):
    """(cluster of each line, first document of each cluster, occurrences) by comparing all pairs."""
    own = {}
    for key, text in docs:
        for p in plain_lines(text):
            own.setdefault(p, []).append(key)
    root = {p: p for p in own}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    long = [(p, shingles(p)) for p in own if len(p) >= 5]
    by = {}
    for i, (_, s) in enumerate(long):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, (p, s) in enumerate(long):
        for j in {j for x in s for j in by[x] if j < i}:
            q, t = long[j]
            if len(s & t) >= similarity * len(s | t):
                root[find(p)] = find(q)
    first, n = {}, {}
    for p, keys in own.items():
        r = find(p)
        first[r], n[r] = min([*keys, *([first[r]] if r in first else [])]), n.get(r, 0) + len(keys)
    return {p: find(p) for p in own}, first, n


def plain_seeds(words):
    """Places and hashes of the seeds taken, by looking at each window of places."""
    values = [int(W.Words.read([" ".join(words[i : i + 16]).encode()]).seeds()[2].view(np.uint64)[0]) for i in range(len(words) - 15)]
    if not values:
        return []
    good = [i for i, v in enumerate(values) if v not in values[i + 1 : i + 5]]
    taken = sorted({min(own, key=lambda i: (values[i] >> 32, i)) for s in range(max(len(values) - 19, 1)) if (own := [i for i in good if s <= i < s + 20])})
    out = []
    for n, i in enumerate(taken):
        if n and values[taken[n - 1]] == values[i] and i - out[-1][0] < 16:
            continue
        out.append((i, values[i]))
    return out


def plain_passages(docs):
    """{key: [(start, stop, again)]}: seeds, their keepers, chains of them, and extension word by word."""
    words = {k: plain_words(t) for k, t in docs}
    seeds = {k: plain_seeds(w) for k, w in words.items()}
    places = {}
    for k in sorted(seeds):
        for i, h in seeds[k]:
            places.setdefault(h, []).append((k, i))
    out = {k: [] for k in words}
    for k, own in seeds.items():
        found = []
        for i, h in own:
            kk, ki = places[h][0]
            if len(places[h]) < 2 or (kk == k and i - ki < 16):
                continue
            last = found[-1] if found else None
            if last and last[0] == kk and i - last[2] == ki - last[4] and i - last[2] <= 20:
                last[2], last[4] = i, ki
            else:
                found.append([kk, i, i, ki, ki])
        for kk, start, last, kstart, klast in found:
            stop, kstop, left, right, w, v = last + 16, klast + 16, 0, 0, words[k], words[kk]
            while left < 19 and start > left and kstart > left and w[start - left - 1] == v[kstart - left - 1]:
                left += 1
            while right < 19 and stop + right < len(w) and kstop + right < len(v) and w[stop + right] == v[kstop + right]:
                right += 1
            out[k].append((start - left, stop + right, True))
            out[kk].append((kstart - left, kstop + right, False))
    return out


def plain_drop(text, line_of, spans, run_words=S.RUN_WORDS):
    """A flag for each word. line_of: for each line whether it repeats."""
    rows = plain_lines(text)
    number = [k for k, w in enumerate(rows) for _ in w]
    marks = [any(a <= i < b for a, b in spans) or (line_of[k] and len(rows[k]) >= 5) for i, k in enumerate(number)]
    begins = [number.index(k) for k in range(len(rows))]
    k = 0
    while k < len(rows):
        j = k
        while j < len(rows) and line_of[j] and len(rows[j]) < 5:
            j += 1
        if j > k and begins[k] and j < len(rows) and marks[begins[k] - 1] and marks[begins[j]]:
            marks[begins[k] : begins[j]] = [True] * (begins[j] - begins[k])
        k = max(j, k + 1)
    found, i = [], 0
    while i < len(marks):
        j = i
        while j < len(marks) and marks[j]:
            j += 1
        if j > i:
            found.append((i, j, max(j - i - 4, 0)))
        i = max(j, i + 1)
    joined = []
    for a, b, n in found:
        if joined and a - joined[-1][1] < 5:
            x, y, both = joined[-1]
            whole = b - x - 4
            lines = {number[i] for i in range(y, a)}
            covered = any(begins[k] >= y and begins[k] + len(rows[k]) <= a for k in lines)
            if both + n >= 0.8 * (2 * whole - both - n) and not covered:
                joined[-1] = (x, b, both + n)
                continue
        joined.append((a, b, n))
    drop = [False] * len(marks)
    for a, b, _ in joined:
        if b - a >= run_words:
            drop[a:b] = [True] * (b - a)
    return drop


def plain_cut(text, drop):
    kept, at, strip = [], 0, "".join(map(chr, [32, *range(9, 14)]))
    for line in text.split("\n"):
        words = list(re.finditer(f"[^{WHITE}]+[{WHITE}]*", line))
        own = drop[at : at + len(words)]
        at += len(words)
        if not any(own):
            kept.append(line)
        elif not all(own):
            rest = line[: words[0].start()] + "".join(m[0] for m, gone in zip(words, own, strict=True) if not gone)
            kept.append(rest.rstrip(strip) if own[-1] else rest)
    return "\n".join(kept)


def brute(docs):
    """{key: (text, words cut, words in shared passages)}."""
    cluster, first, n = brute_clusters(docs)
    spans = plain_passages(docs)
    out = {}
    for key, text in docs:
        if text is None:
            out[key] = (None, 0, 0)
            continue
        again, shared, seen = [], [], set()
        for p in plain_lines(text):
            r = cluster[p]
            shared.append(n[r] > 1)
            again.append(n[r] > 1 and (first[r] != key or r in seen))
            seen.add(r)
        drop = plain_drop(text, again, [(a, b) for a, b, x in spans[key] if x])
        both = plain_drop(text, shared, [(a, b) for a, b, _ in spans[key]])
        out[key] = (plain_cut(text, drop), sum(drop), sum(x or y for x, y in zip(drop, both, strict=True)))
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    want = brute(docs)
    got = S.op10_substring_dedup(spark, TINY).collect()
    assert len(got) == len(docs) and sum(r.n_words_removed for r in got) > 1000
    for r in got:
        assert (r.text, r.n_words_removed, r.n_words_shared) == want[r.doc_id]


def test_recall_and_precision_on_the_tables(spark):
    """No window of 50 words is left that a lesser document has; every word cut is in 16 words or a line that occur elsewhere or before."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in S.op10_substring_dedup(spark, SMALL).collect()}
    seen, again, left = set(), 0, 0
    for k in sorted(docs):
        before, after = (plain_words(t) for t in (docs[k], got[k].text))
        own = {tuple(after[i : i + 50]) for i in range(len(after) - 49)}
        again += sum(tuple(before[i : i + 50]) in seen for i in range(len(before) - 49))
        left += len(own & seen)
        seen |= own
    assert again > 10_000 and left == 0
    places = {}
    for k, t in docs.items():
        w = plain_words(t)
        for i in range(len(w) - 15):
            places[tuple(w[i : i + 16])] = places.get(tuple(w[i : i + 16]), 0) + 1
    alone = [k for k, t in docs.items() if (w := plain_words(t)) and not any(places[tuple(w[i : i + 16])] > 1 for i in range(len(w) - 15))]
    assert len(alone) > 300 and all(got[k].text == docs[k] and got[k].n_words_shared == 0 for k in alone)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(4)
    passage, short = sentence(rng, 60), sentence(rng, 12)
    near = passage.split()
    near[30] = "changed"
    run = "\n".join(sentence(rng, 9) for _ in range(6))
    rows = [(k, f"{sentence(rng, 20)}\n{passage if k % 2 else ' '.join(near)}\n{sentence(rng, 20)}\n{short}") for k in range(1, 9)]
    rows += [(k, f"{sentence(rng, 20)}\n{run}\n{sentence(rng, 20)}\n{short}") for k in range(20, 24)]
    rows += [(k, f"{sentence(rng, 70)}\n{short}") for k in range(30, 34)]
    docs = spark.createDataFrame([(k, t, "a", "b") for k, t in rows], "doc_id long, text string, n_words string, ph string")
    cut = {r.doc_id: r.text for r in S.dedup(docs).collect()}
    assert S.dedup(docs).columns == docs.columns
    for k, t in rows:
        if k in (1, 20) or k >= 30:
            assert cut[k] == t  # the first place of a passage, and clean documents with a short common line
        elif k < 20:
            assert cut[k].split("\n") == [t.split("\n")[i] for i in (0, 2, 3)]
        else:
            assert run not in cut[k] and cut[k].split("\n")[0] == t.split("\n")[0] and cut[k].endswith(short)


@pytest.mark.parametrize("block", [2, 3, 50])
def test_blocks_lose_no_pair(spark, block):
    rng = random.Random(5)
    base = sentence(rng, 60).split()
    texts = [" ".join([*base[:k], "x" + str(k), *base[k + 1 :]]) for k in range(0, 60, 7)]
    found = S.occurrences(spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc long, th int, text string")).where("place is null").withColumnRenamed("h", "ph")
    sets = {}
    for r in S.buckets(found, block).collect():
        sets.setdefault(r.bucket, set()).add(r.ph)
    assert all(len(s) <= 2 * block for s in sets.values())
    together = {frozenset((a, b)) for s in sets.values() for a in s for b in s}
    whole = {r.ph for r in S.buckets(found).collect()}
    share = {}
    for r in found.collect():
        for k in S.KEYS:
            share.setdefault(r[k], set()).add(r.ph)
    assert all(frozenset((a, b)) in together for s in share.values() if len(s) > 1 for a in s & whole for b in s & whole)


def test_recall_at_the_limit():
    """Pairs just above the limit meet in a band."""
    rng, met, n = random.Random(6), 0, 0
    for _ in range(400):
        a = sentence(rng, 104).split()
        b = [*a[:47], "other", *a[48:58], "words", *a[59:]]
        if len(shingles(a) & shingles(b)) < 0.8 * len(shingles(a) | shingles(b)):
            continue
        n += 1
        found = W.Words.read([" ".join(a).encode(), " ".join(b).encode()])
        keys = S.sketches(*found.shingles(np.arange(2)))
        met += bool((keys[0] == keys[1]).any())
    assert n > 100 and met / n > 0.99


def test_edges_of_the_input(spark):
    long = sentence(random.Random(7), 40)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, f"{long}\n{long}"), (None, long), (6, long), (6, long), (7, "w " * 200_000), (8, "a\nb\na")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in S.dedup(docs).collect()), key=str)
    want = [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, ""), (None, long), (6, ""), (6, ""), (7, "w " * 200_000), (8, "a\nb\na")]
    assert got == sorted(want, key=str)
    assert S.dedup(docs.limit(0)).count() == 0


def wrapped(words, n):
    return "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))


def test_passages_inside_lines(spark):
    """Mid-line, in texts of one line, broken otherwise, and with a changed word, a passage goes to the word."""
    rng = random.Random(8)
    passage = sentence(rng, 55).split()
    near = [*passage[:27], "changed", *passage[28:]]
    around = {k: (sentence(rng, 40), sentence(rng, 33)) for k in range(1, 9)}
    form = {1: " ".join(passage), 2: " ".join(passage), 3: wrapped(passage, 7), 4: wrapped(passage, 11).upper(), 5: " ".join(near), 6: wrapped(near, 9), 7: " ".join(passage[:19]), 8: f"{' '.join(passage)} {' '.join(passage)}"}
    rows = [(k, f"{around[k][0]} {form[k]} {around[k][1]}") for k in form]
    once = sentence(rng, 45)
    rows += [(20, f"{once} {sentence(rng, 5)} {once}"), (21, "one two three " * 40), (22, " ".join([sentence(rng, 12)] * 9))]
    got = {r.doc_id: r for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string"), report=True).collect()}
    for k, t in rows:
        if k in (1, 7, 21):
            assert got[k].text == t and got[k].n_words_removed == 0
        elif k < 20:
            assert " ".join(got[k].text.split()) == " ".join(around[k])
    assert got[2].n_words_removed == 55 and got[8].n_words_removed == 110
    assert got[20].text.split() == rows[8][1].split()[:50] and len(got[22].text.split()) < 50


def test_shared_runs_share_a_seed():
    """Any 35 words in a row that two texts share hold a seed that both take, at the same place."""
    rng = random.Random(9)
    for _ in range(60):
        passage, cuts = sentence(rng, 35).split(), (rng.randrange(30), rng.randrange(30))
        texts = [" ".join([*sentence(rng, c).split(), *passage, *sentence(rng, rng.randrange(30)).split()]).encode() for c in cuts]
        of, place, h = W.Words.read(texts).seeds()
        inside = [{(p - cuts[k], x) for o, p, x in zip(of.tolist(), place.tolist(), h.tolist(), strict=True) if o == k and cuts[k] <= p <= cuts[k] + 19} for k in range(2)]
        assert inside[0] & inside[1]


def test_one_key_with_many_rows(spark):
    """Equal rows count as one document; other texts of the same key are cut at their own places."""
    rng = random.Random(10)
    passage = sentence(rng, 60)
    rows = [(1, passage), *[(2, f"{sentence(random.Random(1), 29)} {passage}")] * 30, (2, f"{sentence(rng, 50)} {passage} {sentence(rng, 3)}")]
    got = [r.text for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 2").collect()]
    assert len(got) == 31 and not any(passage[:200] in t for t in got) and sum(len(t.split()) == 29 for t in got) == 30 and sum(len(t.split()) == 53 for t in got) == 1
