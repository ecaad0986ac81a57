"""Operator 10: removal of repeated passages by paragraph MinHash banding.

Paragraphs are of two kinds. Lines are sketched by MinHash over five-word shingles;
distinct lines that share a band meet, exact Jaccard similarity decides, and connected
components of similar lines are clusters. All occurrences of a cluster but the first
are repeats. Blocks of words that don't depend on line breaks, at places that the words
themselves choose, are compared exactly and extended word by word (passages.py). Runs
of repeated words, from either kind, are cut out of the documents if they are long enough.

Bands: with 2 rows in 8 bands a pair at similarity 0.8 is missed with probability
(1 - 0.8 ** 2) ** 8, less than 3 in 10,000. A passage inside a line is found for certain
if 35 words in a row are equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import passages
from .shared import by_ids, components, discard, materialise, slices, sorted_groups, table, text_bytes
from .words import GOLDEN, SHINGLE, Words, mixed, odd_numbers

SIMILARITY = 0.8
ROWS, BANDS = 2, 8
#: Words of a run of repeats that is cut out, at least.
RUN_WORDS = 40
#: Lines of a bucket compared in one task are twice this at most; larger buckets are compared block by block.
BLOCK = 250
WHITE = b" \t\n\r\x0b\x0c"
WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")
KEYS = [f"k{b}" for b in range(BANDS)]
PERM, SALT = odd_numbers(2, ROWS * BANDS), odd_numbers(3, ROWS * BANDS)


def sketches(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Band keys (lines x BANDS) of MinHash signatures; shingles of lines one after another, sizes of each."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sizes), b + 1, np.uint64)
        for p in range(b * ROWS, (b + 1) * ROWS):
            low = np.minimum.reduceat(mixed((shingles ^ SALT[p]) * PERM[p]), starts)
            key = mixed(key * GOLDEN ^ low)
        out[:, b] = key
    return out.view(np.int64)


def occurrences(docs: DataFrame) -> DataFrame:
    """Of docs (doc, th, text): (doc, th, place, h, k0...), a row for each line with a word and for each seed taken.

    Lines have no place; their h is their identity and k0... their band keys, null
    below SHINGLE words. One pass over the texts, in bounded parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                words = Words.read(text_bytes(batch.column(2)))
                long = np.flatnonzero(words.lines >= SHINGLE)
                n = len(words.lines)
                of, place, h = words.seeds()
                keys = np.zeros((n + len(of), BANDS), np.int64)
                if len(long):
                    keys[long] = sketches(*words.shingles(long))
                none = np.ones(n + len(of), bool)
                none[long] = False
                rows = pa.array(np.concatenate((words.of, of)))
                at = pa.array(np.concatenate((np.zeros(n, np.int32), place.astype(np.int32))), mask=np.arange(n + len(of)) < n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), at, pa.array(np.concatenate((words.line_ids(), h))), *[pa.array(keys[:, b], mask=none) for b in range(BANDS)]], ["doc", "th", "place", "h", *KEYS])

    schema = f"doc {docs.schema['doc'].dataType.simpleString()}, th int, place int, h bigint, " + ", ".join(f"{k} bigint" for k in KEYS)
    return docs.mapInArrow(run, schema)


def buckets(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(bucket, ph): distinct lines that share a band, each set of them once.

    A band of more than block lines is numbered by blocks as it streams by, and given as
    all pairs of its blocks, which go to different tasks: no task holds more than two
    blocks of texts, and no pair is left out.
    """
    distinct = lines.where(F.col(KEYS[0]).isNotNull()).groupBy("ph").agg(*[F.first(k).alias(k) for k in KEYS])
    banded = distinct.select("ph", F.explode(F.array(*KEYS)).alias("band")).repartition("band").sortWithinPartitions("band", "ph")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int | None, np.ndarray]] = []
        band, held, parts = None, np.empty(0, np.int64), 0  # of the group that is not yet over

        def close() -> None:
            if not parts and 2 <= len(held) <= block:  # equal sets of several bands get one name
                done.append((xxhash.xxh3_64_intdigest(held.tobytes()) - (1 << 63), None, held))
            elif parts or len(held) > block:
                done.extend((band, parts + k, held[k * block : (k + 1) * block]) for k in range(-(-len(held) // block)))

        def out() -> pa.RecordBatch:
            sizes = [len(x[2]) for x in done]
            names = np.repeat(np.array([x[0] for x in done], np.int64), sizes)
            part = np.repeat(np.array([-1 if x[1] is None else x[1] for x in done], np.int32), sizes)
            rows = pa.RecordBatch.from_arrays([pa.array(names), pa.array(part, mask=part < 0), pa.array(np.concatenate([np.empty(0, np.int64), *(x[2] for x in done)]))], ["bucket", "part", "ph"])
            done.clear()
            return rows

        for batch in batches:
            if not batch.num_rows:
                continue
            bands, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(bands[1:] != bands[:-1]) + 1, [len(bands)]))
            for k in sorted({0, *np.flatnonzero(np.diff(cuts) > 1).tolist(), len(cuts) - 2}):
                a, b = int(cuts[k]), int(cuts[k + 1])
                if bands[a] != band:
                    close()
                    band, held, parts = int(bands[a]), np.empty(0, np.int64), 0
                held = np.concatenate((held, ids[a:b]))
                while len(held) > 2 * block:
                    done.append((band, parts, held[:block]))
                    held, parts = held[block:], parts + 1
            if sum(len(x[2]) for x in done) > 50_000:
                yield out()
        close()
        yield out()

    sets = materialise(banded.select("band", "ph").mapInArrow(run, "bucket bigint, part int, ph bigint").distinct(), "dedup-sets")
    # All pairs of a large band's blocks.
    last = sets.where("part is not null").groupBy("bucket").agg(F.max("part").alias("last"))
    large = sets.where("part is not null").join(last, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).where("other <> part")
    pair = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
    out = materialise(sets.where("part is null").select("bucket", "ph").unionByName(large.select(pair.alias("bucket"), "ph")), "dedup-buckets")
    discard(sets)
    return out


def similar(texts: list[bytes], similarity: float = SIMILARITY) -> list[int]:
    """For each text the first text of its component under exact shingle Jaccard of at least similarity.

    Grows one component at a time: a text is compared with all texts that no component has yet.
    """
    words = Words.read(texts)
    shingles, counts = words.shingles(np.arange(len(texts)))
    ends = np.cumsum(counts)
    sets = [np.unique(shingles[b - n : b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    root, free, most = list(range(len(texts))), np.ones(len(texts), bool), int(flat.max()) + 1
    for k in range(len(texts)):
        if not free[k]:
            continue
        free[k] = False
        todo = [k]
        while todo and free.any():
            j = todo.pop()
            mark = np.zeros(most, bool)
            mark[flat[starts[j] : starts[j] + sizes[j]]] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            near = np.flatnonzero(free & (both >= similarity * (sizes + sizes[j] - both) - 1e-9))
            free[near] = False
            for i in near.tolist():
                root[i] = k
            todo += near.tolist()
    return root


def links(docs: DataFrame, met: DataFrame, wanted: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between lines of a bucket whose components under exact similarity are one. wanted: the lines that are in buckets."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                texts = [b"\n".join(w for line in t.lower().split(b"\n") if len(w := b" ".join(line.split()).strip()) > 2 * SHINGLE - 2) for t in text_bytes(batch.column(0))]
                lines = [x for t in texts for x in t.split(b"\n") if x]
                found = dict(zip(Words.read(lines).line_ids().tolist(), lines, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], ["ph", "words"])

    texts = by_ids(docs.select("text").mapInArrow(own, "ph bigint, words binary"), wanted, "ph", "left_semi").dropDuplicates(["ph"])
    grouped = met.join(texts, "ph").repartition("bucket").sortWithinPartitions("bucket")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in sorted_groups(batches, "bucket"):
            ids = group.column("ph").to_pylist()
            for k, j in enumerate(similar(group.column("words").to_pylist(), similarity)):
                if j != k:
                    a.append(ids[k])
                    b.append(ids[j])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return grouped.mapInArrow(verify, "a bigint, b bigint")


def repeats(docs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, lines): for each document with such lines the set of (ph, cluster, first).

    cluster: the least identity of similar lines; first: whether the document has
    the least key of all with the cluster. Clusters of one occurrence are left out.
    """
    met = buckets(lines)
    wanted = materialise(met.select("ph").distinct(), "dedup-wanted")
    joined = components(links(docs, met, wanted, similarity), "dedup-links").withColumnsRenamed({"node": "ph", "root": "cluster"})
    each = lines.groupBy("ph").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    of = materialise(each.join(joined, "ph", "left").withColumn("joined", F.col("cluster").isNotNull()).withColumn("cluster", F.coalesce("cluster", "ph")).where("joined or n > 1"), "dedup-clusters")
    # Aggregates are written first: only a join whose two sides are plain shuffles can be split at a hub.
    first = materialise(of.groupBy("cluster").agg(F.min("least").alias("least")), "dedup-firsts")
    known = materialise(of.select("ph", "cluster").join(first, "cluster"), "dedup-known")
    discard(met, wanted, of, first)
    rows = lines.select("doc", "ph").join(known, "ph")
    return rows.groupBy("doc").agg(F.collect_set(F.struct("ph", "cluster", (F.col("doc") == F.col("least")).alias("first"))).alias("lines"))


def runs(marks: np.ndarray, starts: np.ndarray, run_words: int, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Runs of marked words, of run_words at least.

    A gap shorter than a shingle is bridged if the run's shingles keep the similarity
    (a changed word inside a passage) and no whole line lies in it.
    starts: the first word of each line.
    """
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    out: list[list[int]] = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        same = max(b - a - SHINGLE + 1, 0)
        if out and a - out[-1][1] < SHINGLE:
            whole, both = b - out[-1][0] - SHINGLE + 1, out[-1][2] + same
            in_gap = np.searchsorted(starts, [out[-1][1], a], "left")
            inside = in_gap[1] - in_gap[0] + (in_gap[1] < len(starts) and starts[in_gap[1]] == a)
            if both >= similarity * (2 * whole - both) and inside < 2:
                out[-1][1:] = [b, both]
                continue
        out.append([a, b, same])
    return [(a, b) for a, b, _ in out if b - a >= run_words]


def repeated_words(words: Words, known: dict[int, tuple[int, bool]], spans: list[tuple[int, int, bool]], run_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words of one text go, and which are in a passage that occurs elsewhere or goes.

    known: cluster and first of its lines that are repeats; spans: start, stop, again of
    its passages. Of a document's own lines of a cluster the first place stays. Repeated
    lines shorter than a shingle only bridge a run, they neither begin nor end it.
    """
    n = int(words.texts[0])
    ends = np.cumsum(words.lines)
    starts = ends - words.lines
    kinds: tuple[list, list] = ([], [])  # "r" a repeat, "s" a short one, "-" none; once for what goes, once for what is shared
    seen = set()
    for h, size in zip(words.line_ids().tolist(), words.lines.tolist(), strict=True):
        hit = known.get(h)
        kind = "r" if size >= SHINGLE else "s"
        again = hit is not None and (not hit[1] or hit[0] in seen)
        kinds[0].append(kind if again else "-")
        kinds[1].append(kind if hit is not None else "-")
        if hit is not None:
            seen.add(hit[0])
    out = []
    for k, own in enumerate(kinds):
        marks = np.zeros(n, bool)
        for a, b, again in spans:
            if again or k:
                marks[a:b] = True
        for j, kind in enumerate(own):
            if kind == "r":
                marks[starts[j] : ends[j]] = True
        j = 0
        while j < len(own):
            if own[j] != "s":
                j += 1
                continue
            end = j
            while end < len(own) and own[end] == "s":
                end += 1
            if starts[j] and ends[end - 1] < n and marks[starts[j] - 1] and marks[ends[end - 1]]:
                marks[starts[j] : ends[end - 1]] = True
            j = end
        drop = np.zeros(n, bool)
        for a, b in runs(marks, starts, run_words):
            drop[a:b] = True
        out.append(drop)
    return out[0], out[0] | out[1]


def cut(text: bytes, drop: np.ndarray) -> tuple[bytes, int]:
    """The text without some of its words, and how many lines went whole: those that lose all their words."""
    kept, gone, at = [], 0, 0
    for line in text.split(b"\n"):
        n = len(line.split())
        own = drop[at : at + n]
        at += n
        if n and own.all():
            gone += 1
        elif own.any():
            places = [m.start() for m in WORD.finditer(line)] + [len(line)]
            pieces = [line[: places[0]]] + [line[places[j] : places[j + 1]] for j in range(n) if not own[j]]
            kept.append(b"".join(pieces).rstrip(WHITE) if own[-1] else b"".join(pieces))
        else:
            kept.append(line)
    return b"\n".join(kept), gone


REPORT = {"n_words": pa.int64(), "n_lines_removed": pa.int64(), "n_words_removed": pa.int64(), "n_words_shared": pa.int64()}


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, run_words: int = RUN_WORDS, report: bool = False) -> DataFrame:
    """The documents with repeated passages cut out of text; other columns stay as they are.

    Spans of words are cut, lines that lose all their words go. The first document in the
    order of keys keeps a passage, the first place in it if it has several.

    report: also n_words, n_lines_removed, n_words_removed and n_words_shared (words in
    passages that occur elsewhere, cut or kept), in place of columns of those names. Null
    texts stay null. Rows with a null key stay as they are and repeat nothing; equal rows
    are taken for one document.
    """
    if report:
        docs = docs.drop(*REPORT)
    plain = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.hash(text).alias("th"), F.col(text).alias("text"))
    found = materialise(occurrences(plain), "dedup-paragraphs")
    lines = found.where("place is null").select("doc", F.col("h").alias("ph"), *KEYS)
    seeds = found.where("place is not null").select("doc", "th", "place", "h")
    lists = materialise(repeats(plain, lines, similarity), "dedup-lists")
    shared = passages(plain, seeds)
    spans = shared.groupBy("doc").agg(F.collect_set(F.struct("th", "start", "stop", "again")).alias("spans"))
    marked = materialise(lists.join(spans, "doc", "full").select("doc", "lines", "spans"), "dedup-marked")
    discard(found, lists, shared)
    own = "_" + "".join(docs.columns)  # clashes with no column
    both = marked.select(F.col("doc").alias(own + "k"), F.col("lines").alias(own + "l"), F.col("spans").alias(own + "s"))
    joined = docs.join(both, F.col(key) == F.col(own + "k"), "left").drop(own + "k").withColumn(own + "h", F.hash(text))
    fields, at = docs.schema.fields, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                texts, rest = [], []
                raw = batch.column(at).cast(pa.binary()).to_pylist()
                for t, known, places, th in zip(raw, *(batch.column(len(fields) + k).to_pylist() for k in range(3)), strict=True):
                    if t is None or (not known and not places):
                        texts.append(t)
                        rest.append((len((t or b"").split()), 0, 0, 0))
                        continue
                    words = Words.read([t])
                    drop, shared = repeated_words(words, {x["ph"]: (x["cluster"], x["first"]) for x in known or ()}, [(x["start"], x["stop"], x["again"]) for x in places or () if x["th"] == th], run_words)
                    new, gone = cut(t, drop) if drop.any() else (t, 0)
                    texts.append(new)
                    rest.append((len(drop), gone, int(drop.sum()), int(shared.sum())))
                columns = list(batch.columns[: len(fields)])
                columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
                if report:
                    columns += [pa.array([r[k] for r in rest], kind) for k, kind in enumerate(REPORT.values())]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields] + (list(REPORT) if report else []))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + (", " + ", ".join(f"{c} bigint" for c in REPORT) if report else "")
    return joined.mapInArrow(run, schema)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated passages, and what was cut, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, report=True)
