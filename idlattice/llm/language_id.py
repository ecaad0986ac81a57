"""Operator 1: language identification by Bayesian evidence fusion.

log P(language | record) = trust * text likelihood + log P(declared | language)
+ log prior(language | host), where a host's prior is its other records' mean,
smoothed towards that of its address suffix, and that towards the corpus. The text
model counts hashed byte trigrams by label; priors and the reliability of declared
languages are grouped aggregations of the text-only posteriors of all records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_text import main_text
from .shared import in_train, materialise, slices, table

BITS = 15
#: A text model takes 128 KB; with more labels than this an error asks to join variants of labels first, none is dropped.
MOST_LANGUAGES = 2000
#: Weight of a trigram's log likelihood, and trigrams after which a longer text counts no more than its mean.
TRUST, ENOUGH = 0.3, 400
#: Records that a smoothing prior counts for.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 5.0, 20.0, 10.0
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)
LETTERS = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in bytes(range(256)).lower()], np.uint32)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of texts one after another, and how many each has. Case, digits and punctuation don't count."""
    codes = LETTERS[np.frombuffer(b"".join([b" " + t + b" " for t in texts]), np.uint8)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    hashed = ((codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA6B)) ^ (codes[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)
    ends = np.cumsum(sizes + 2)[:-1]
    inside = np.ones(len(hashed), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return hashed[inside], sizes


def in_parts(texts: list[bytes], most: int = 4 << 20) -> Iterator[list[bytes]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held > most:
            yield part
            part, held = [], 0
    if part:
        yield part


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram | language), from all training documents with a label.

    Each document counts once, whatever its length. Every label gets a model. The driver
    gets at most MOST_LANGUAGES x 2 ** BITS sums; more labels are an error.
    """
    labelled = docs.where(in_train(F.col(key)) & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    languages = sorted(r.lang for r in labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} language labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {x: np.zeros(1 << BITS) for x in languages}
        for batch in batches:
            for x, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if t and x in sums:
                    found, _ = trigrams([t])
                    sums[x] += np.bincount(found, minlength=1 << BITS) / len(found)
        for x, values in sums.items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(values[at])], ["lang", "bucket", "n"])

    model = np.zeros((len(languages), 1 << BITS))
    for r in labelled.mapInArrow(run, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        model[languages.index(r.lang), r.bucket] = r.n
    model = (model + 1e-4) / (model + 1e-4).sum(axis=1, keepdims=True) if len(languages) else model
    return languages, np.log(model).astype(np.float32)


def text_scores(rows: DataFrame, model: np.ndarray, keep: list[str], text: str, html: bool = False) -> DataFrame:
    """keep, the scores array<double> (weighted log likelihood of each language, 0 without text) and, for html, declared."""
    source = rows.select(*keep, text)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, len(keep)):
                raw = batch.column(len(keep)).to_pylist()
                declared = [m[1].lower() if h and (m := DECLARED.search(h)) else None for h in raw] if html else []
                texts = [(main_text(t) if html else t or "").encode() if t else b"" for t in raw]
                out = []
                for part in in_parts(texts):
                    found, sizes = trigrams(part)
                    totals = np.zeros((len(part), len(model)))
                    some = np.flatnonzero(sizes)
                    if len(some):
                        starts = (np.cumsum(sizes) - sizes)[some]
                        for x in range(len(model)):
                            totals[some, x] = np.add.reduceat(model[x][found], starts, dtype=np.float64) / sizes[some]
                    out.append(totals * np.minimum(sizes, ENOUGH)[:, None] * TRUST)
                scores = np.concatenate(out) if out else np.zeros((0, len(model)))
                columns = [*batch.columns[: len(keep)], pa.array(list(scores), pa.list_(pa.float64()))] + ([pa.array(declared, pa.string())] if html else [])
                yield pa.RecordBatch.from_arrays(columns, [*keep, "scores", *(["declared"] if html else [])])

    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", scores array<double>" + (", declared string" if html else "")
    return source.mapInArrow(run, schema)


def address(url: Column) -> tuple[Column, Column]:
    """Host, and suffix: the host's last label with a first path segment of two letters, if there is one."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    return host, F.concat_ws("/", F.regexp_extract(host, r"([^.]*)$", 1), path)


def softmax(logits: Column) -> Column:
    top = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(top, lambda x: x / F.aggregate(top, F.lit(0.0), lambda a, b: a + b))


def fuse(scored: DataFrame, languages: list[str]) -> DataFrame:
    """Adds language, confidence and text_language to records with host, suffix, declared and scores.

    Without languages all three are null. Ties go to the language that comes first.
    """
    n = len(languages)
    if not n:
        return scored.select("*", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_language"))
    scored = scored.withColumn("own", softmax(F.col("scores")))
    sums = [F.sum(F.get("own", F.lit(k))).alias(f"s{k}") for k in range(n)]
    total = [F.sum(f"s{k}").alias(f"s{k}") for k in range(n)]
    hosts = materialise(scored.groupBy("suffix", "host").agg(*sums), "language-hosts")
    corpus = hosts.agg(*total).first()
    everything = [(corpus[k] or 0.0) + 1.0 for k in range(n)]
    base = F.array(*[F.lit(x / sum(everything)) for x in everything])

    def smoothed(own: Column, prior: Column, weight: float) -> Column:
        size = F.aggregate(own, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(own, prior, lambda a, b: (F.greatest(a, F.lit(0.0)) + weight * b) / (size + weight))

    vector = F.array(*[F.col(f"s{k}") for k in range(n)])
    suffixes = hosts.groupBy("suffix").agg(*total).select("suffix", smoothed(vector, base, SUFFIX_WEIGHT).alias("suffix_prior"))
    known = hosts.select("suffix", "host", vector.alias("host_sums")).join(suffixes, "suffix")
    told = scored.where(F.col("declared").isin(languages)).groupBy("declared").agg(*sums).collect()
    by_true = np.full((n, n), DECLARED_WEIGHT / n)  # declared, true
    for r in told:
        by_true[languages.index(r.declared)] += [r[f"s{k}"] or 0.0 for k in range(n)]
    likelihood = np.log(by_true / by_true.sum(axis=0))
    reliability = scored.sparkSession.createDataFrame([(x, [float(v) for v in row]) for x, row in zip(languages, likelihood, strict=True)], "declared string, said array<double>")
    said = F.coalesce("said", F.array_repeat(F.lit(0.0), n))

    joined = scored.join(known, ["suffix", "host"]).join(F.broadcast(reliability), "declared", "left")
    others = F.zip_with("host_sums", "own", lambda a, b: a - b)
    prior = smoothed(others, F.col("suffix_prior"), HOST_WEIGHT)
    logits = F.zip_with(F.zip_with("scores", said, lambda a, b: a + b), prior, lambda a, b: a + F.log(b))
    fused = joined.withColumn("logits", logits).withColumn("posterior", softmax(F.col("logits")))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.get(names, F.array_position(c, F.array_max(c)).cast("int") - 1)
    has_text = F.exists("scores", lambda x: x != 0)
    return fused.select(
        *[c for c in scored.columns if c not in ("own", "scores")],
        best(F.col("posterior")).alias("language"), F.array_max("posterior").alias("confidence"), F.when(has_text, best(F.col("own"))).alias("text_language"),
    )


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document and per page: kind, doc_id, page_id, host, suffix, declared, language, confidence, text_language.

    A document's host is its source; it has no suffix and declares no language, its lang
    column serves only as a label, and only in training documents. Null texts, addresses
    and labels are absent evidence; repeated rows give a row each.
    """
    languages, model = fit(docs)
    own = text_scores(docs.withColumn("_host", F.concat(F.lit("source:"), F.coalesce(F.col("source"), F.lit("")))), model, ["doc_id", "_host"], "text")
    own = own.select(F.lit("document").alias("kind"), "doc_id", F.lit(None).cast("long").alias("page_id"), F.col("_host").alias("host"), F.lit("").alias("suffix"), F.lit(None).cast("string").alias("declared"), "scores")
    web = text_scores(pages, model, ["page_id", "url"], "html", html=True)
    host, suffix = address(F.col("url"))
    web = web.select(F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "page_id", host.alias("host"), suffix.alias("suffix"), "declared", "scores")
    return fuse(materialise(own.unionByName(web), "language"), languages)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document and page, with its evidence."""
    return identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
