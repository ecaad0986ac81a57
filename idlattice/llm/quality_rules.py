"""Operator 4: quality rules by distribution divergence.

Two histograms of a text, of character classes and of common words, are compared
with those of each language by Jensen-Shannon distance; the nearest language
counts. Languages, their common words and their histograms come from a grouped
aggregation over all documents. A guard by length keeps a short text from failing
on chance alone.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, slices, table, text_bytes

#: Characters that n_symbols counts.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
PUNCTUATION = b".,;:!?'\"()-"
#: Classes of a text's characters, by their first UTF-8 byte; CONTINUED bytes begin no character.
LOWER, UPPER, DIGIT, SPACE, POINT, SYMBOL, OTHER, CONTROL, BEYOND, CONTINUED = range(10)
CLASSES = CONTINUED
#: Words that a task holds of a language's sums before it passes them on.
HELD = 100_000


def class_table() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[:32] = kinds[127] = CONTROL
    for chars, kind in ((bytes(range(97, 123)), LOWER), (bytes(range(65, 91)), UPPER), (b"0123456789", DIGIT), (PUNCTUATION, POINT), (SYMBOLS, SYMBOL), (WHITE, SPACE)):
        kinds[list(chars)] = kind
    kinds[0x80:0xC0], kinds[0xC0:] = CONTINUED, BEYOND
    return kinds


KINDS = class_table()


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. A distance fails above limit + slack / sqrt(words)."""

    least_words: int = 50
    repeat_percent: int = 50
    class_limit: float = 0.21
    class_slack: float = 0.5
    class_words: int = 50  # guard: fewer words, no comparison of character classes
    word_limit: float = 0.215
    word_slack: float = 1.0
    word_words: int = 50  # guard: fewer words, no comparison of common words
    common_share: float = 0.003  # mean share of a language's words from which a word is common
    least_documents: int = 20  # documents from which a language has a reference


@dataclass(frozen=True)
class References:
    """Languages, the bin of each common word of any of them, and a row of mean shares for each language."""

    languages: list[str]
    bins: dict[bytes, int]
    classes: np.ndarray
    words: np.ndarray


NO_REFERENCES = References([], {}, np.zeros((0, CLASSES)), np.zeros((0, 1)))


@dataclass(frozen=True)
class Measures:
    """Counts of one text: they stay small, however long it is."""

    n_words: int
    n_repeat_words: int
    classes: np.ndarray
    bins: np.ndarray

    def base_failed(self, rules: Rules) -> bool:
        return self.n_words < rules.least_words or 100 * self.n_repeat_words > rules.repeat_percent * self.n_words


def class_counts(text: bytes) -> np.ndarray:
    classes = np.zeros(CLASSES + 1, np.int64)
    for k in range(0, len(text), 1 << 20):
        classes += np.bincount(KINDS[np.frombuffer(text[k : k + (1 << 20)], np.uint8)], minlength=CLASSES + 1)
    return classes[:CLASSES]


def measure(text: bytes, bins: dict[bytes, int]) -> Measures:
    """bins: the bin of each common word, lower-cased; the last bin is for all others."""
    again = repeated_words(text.split())  # on bytes: the six ASCII white-space characters
    lowered = text.lower().split()
    found = np.fromiter(map(bins.get, lowered, repeat(len(bins))), np.int64, len(lowered))
    return Measures(len(lowered), again, class_counts(text), np.bincount(found, minlength=len(bins) + 1))


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words inside windows of n that occur twice or more, the first occurrence included."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    number = dict(zip(dict.fromkeys(words), count(), strict=False))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    windows = ids[:m]
    for k in range(1, n):
        if (int(windows.max()) + 1) * len(number) >= 1 << 62:
            windows = np.unique(windows, return_inverse=True)[1]
        windows = windows * len(number) + ids[k : k + m]
    order = np.argsort(windows, kind="stable")
    equal = windows[order[1:]] == windows[order[:-1]]
    if not equal.any():
        return 0
    inside = np.zeros(len(words), bool)
    at = order[np.concatenate((equal, [False])) | np.concatenate(([False], equal))]
    for k in range(n):
        inside[at + k] = True
    return int(inside.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, of each row of p to the row q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


def references(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> References:
    """Mean shares of character classes and of common words of every language of the documents.

    Over all documents of a language that pass the base rules; each counts once,
    whatever its length. Tasks pass on sums by language and word, and Spark adds
    them up; a word is common with a mean share of common_share or more in any
    language, so the driver gets 1 / common_share words of a language at most. A language of fewer than
    least_documents such documents has none. Null languages and texts don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, dict] = defaultdict(lambda: defaultdict(float))
        kinds: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES + 1))

        def rows(x: str, names: list[bytes], values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x] * len(names), pa.string()), pa.array(names, pa.binary()), pa.array(values, pa.float64())], ["lang", "word", "value"])

        for whole in batches:
            for batch in slices(whole, 1):
                for x, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                    if x is None or len(t) < 2 * rules.least_words - 1:
                        continue
                    lowered = t.lower().split()
                    n = len(lowered)
                    if n < rules.least_words or 100 * repeated_words(t.split()) > rules.repeat_percent * n:
                        continue
                    own = words[x]
                    for w, c in Counter(lowered).items():
                        own[w] += c / n
                    kinds[x] += [*shares(class_counts(t)), 1]
                    if len(own) > HELD:
                        yield rows(x, list(own), list(own.values()))
                        own.clear()
        for x, own in words.items():
            yield rows(x, [*own, *(b" %d" % k for k in range(CLASSES + 1))], [*own.values(), *kinds[x]])

    sums = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, word binary, value double")
    # A space begins the names of character classes and, after them, of the number of documents; no word has one.
    sums = materialise(sums.groupBy("lang", "word").agg(F.sum("value").alias("value")), "quality-words")
    total = F.broadcast(sums.where(F.col("word") == F.lit(b" %d" % CLASSES)).where(F.col("value") >= rules.least_documents - 0.5).select("lang", F.col("value").alias("n")))
    special = F.substring("word", 1, 1) == F.lit(b" ")
    common = F.broadcast(sums.where(~special).join(total, "lang").where(F.col("value") >= rules.common_share * F.col("n")).select("word").distinct())
    found = [(r.lang, bytes(r.word), r.value / r.n) for r in sums.where(~special).join(common, "word").unionByName(sums.where(special)).join(total, "lang").collect()]
    languages = sorted({x for x, _, _ in found})
    if not languages:
        return NO_REFERENCES
    bins = {w: k for k, w in enumerate(sorted({w for _, w, _ in found if w[:1] != b" "}))}
    classes, words = np.zeros((len(languages), CLASSES)), np.zeros((len(languages), len(bins) + 1))
    for x, w, value in found:
        if w in bins:
            words[languages.index(x), bins[w]] = value
        elif int(w) < CLASSES:
            classes[languages.index(x), int(w)] = value
    words[:, -1] = 1 - words[:, :-1].sum(axis=1)
    return References(languages, bins, classes, words)


def judge(measures: list[Measures], known: References, rules: Rules) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest language, its two distances, and whether the distances pass, of each text.

    Nearest by the sum of both distances, the first language on a tie. Without
    references every text passes and has no language.
    """
    n = np.array([m.n_words for m in measures])
    if not known.languages or not measures:
        return [None] * len(measures), np.full(len(n), np.nan), np.full(len(n), np.nan), np.ones(len(n), bool)
    classes, bins = shares(np.array([m.classes for m in measures])), shares(np.array([m.bins for m in measures]))
    by_class = np.array([js_distance(classes, c) for c in known.classes])
    by_word = np.array([js_distance(bins, b) for b in known.words])
    best = (by_class + by_word).argmin(axis=0)
    at = np.arange(len(n))
    one, two = by_class[best, at], by_word[best, at]
    root = np.sqrt(np.maximum(n, 1))
    fails = (n >= rules.class_words) & (one > rules.class_limit + rules.class_slack / root) | (n >= rules.word_words) & (two > rules.word_limit + rules.word_slack / root)
    return [known.languages[k] for k in best.tolist()], one, two, ~fails


def verdicts(docs: DataFrame, known: References, text: str = "text", key: str = "doc_id", lang: str | None = "lang", rules: Rules = Rules()) -> DataFrame:
    """One row per row: the base counts, the nearest language, both distances and the verdict.

    A text whose own language (column lang, if named) has no reference passes the
    comparison, since it can be near none. Null and empty texts have no words and
    fail; repeated rows give a row each; other columns aren't read. One pass without
    a shuffle.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    source = docs.select(F.col(key).alias(key), F.col(text).alias("_text"), (F.col(lang).cast("string") if lang else F.lit(None).cast("string")).alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                texts = text_bytes(batch.column(1))
                found = [measure(t, known.bins) for t in texts]
                failed = np.array([m.base_failed(rules) for m in found], bool)
                language, one, two, passes = judge(found, known, rules)
                passes |= unknown(batch.column(2), known)
                columns = [
                    batch.column(0),
                    np.array([m.n_words for m in found], np.int64),
                    np.array([m.classes.sum() - m.classes[SPACE] for m in found], np.int64),
                    np.array([m.classes[SYMBOL] for m in found], np.int64),
                    np.array([repeated_lines(t) for t in texts], np.int64),
                    np.array([m.n_repeat_words for m in found], np.int64),
                    failed, ~failed & passes, pa.array(language, pa.string()), one, two,
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [key, *counts, "base_failed", "kept", "language", "class_distance", "word_distance"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in counts) + ", base_failed boolean, kept boolean, language string, class_distance double, word_distance double"
    return source.mapInArrow(run, schema)


def unknown(column: pa.Array, known: References) -> np.ndarray:
    """True where a language is given and has no reference."""
    return np.array([x is not None and x not in known.languages for x in column.to_pylist()], bool)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The rows whose text is kept, as they are. Two passes, no shuffle of texts."""
    known, at, of = references(docs, text, lang, rules), docs.columns.index(text), docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                found = [measure(t, known.bins) for t in text_bytes(batch.column(at))]
                good = judge(found, known, rules)[3] | unknown(batch.column(of).cast(pa.string()), known)
                yield batch.filter(pa.array(good & ~np.array([m.base_failed(rules) for m in found], bool)))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The base counts and the verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return verdicts(docs, references(docs))
