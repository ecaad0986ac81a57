"""Operator 5: benchmark decontamination, in DataFrame operations only.

The benchmark's n-grams form a broadcast hash set, looked up by each n-gram's
anchor (its longest word). Document words that are anchors name the windows to
verify, word for word; a window without its anchor cannot be in the set, so every
window of every text is covered. One scan and one shuffle of small rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_ids, materialise, table

N = 10
#: Words of a part of a text; a row of the scan carries one part.
PART = 200
#: n-grams that are broadcast, and anchors that are put into the scan's filter, at most; beyond, windows and n-grams are joined by a shuffle.
MOST_GRAMS, MOST_ANCHORS = 200_000, 50_000
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: The same before lower-casing.
RAW_SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII non-alphanumerics, A-Z lower-cased. Null has none."""
    return F.filter(F.split(lowered(text), f"[{SEPARATORS}]+"), lambda w: w != "")


def grams(benchmark: DataFrame, text: str = "text", key: str = "item_id", n: int = N) -> DataFrame:
    """(gram, items): n consecutive words, or all words of an item with fewer, and the items they are in.

    Items without words give none; null item ids aren't listed, but their n-grams count.
    """
    split = benchmark.select(F.col(key).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    return split.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i") + 1, n).alias("gram")).groupBy("gram").agg(F.collect_set("item").alias("items"))


def with_anchor(gram_table: DataFrame) -> DataFrame:
    """Adds the anchor, the first of the longest words, and its offset."""
    longest = F.array_max(F.transform("gram", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"))))
    return gram_table.withColumn("offset", -longest["i"]).withColumn("anchor", F.get("gram", F.col("offset")))


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", n: int = N, most_grams: int = MOST_GRAMS, most_anchors: int = MOST_ANCHORS) -> DataFrame:
    """(key, text_hash, n_words, n_rows, spans, items) for each distinct pair of key and text, of which there are n_rows.

    spans: the (start, length) in words of each window found; items: the sorted ids
    of the items with such windows. Both empty for clean, empty and null texts.
    Columns other than key and text aren't read.
    """
    known = materialise(with_anchor(grams(benchmark, n=n, key=item_key)), "grams")
    base = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("w"))
    small = known.limit(most_grams + 1).count() <= most_grams
    anchors = [r.anchor for r in known.select("anchor").distinct().limit(most_anchors + 1).collect()] if small else []
    if small and len(anchors) <= most_anchors:
        found = _by_anchor(base, known, anchors, n)
    else:
        found = _by_shuffle(base, known)
    return found.select(
        F.col("doc").alias(key), "text_hash", "n_words", "n_rows",
        F.array_sort(F.col("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    )


def _folded(rows: DataFrame) -> DataFrame:
    """One row per document from rows with a hit or a null each, and how many equal rows of the input it stands for."""
    return rows.groupBy("doc", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.sum("first").alias("n_rows"),
        F.collect_set(F.when(F.col("hit"), F.struct("start", "length"))).alias("spans"),
        F.collect_set(F.when(F.col("hit"), F.col("items"))).alias("items"),
    )


def _by_anchor(base: DataFrame, known: DataFrame, anchors: list[str], n: int) -> DataFrame:
    """Texts are cut into parts of PART words with the n - 1 words around them, so that an
    anchor's row carries one part of the text and the work is linear in its length."""
    begins = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(PART))
    near = F.transform(begins, lambda b: F.struct(b.alias("base"), F.least(b, F.lit(n - 1)).alias("before"), F.slice("w", F.greatest(b - (n - 1), F.lit(0)) + 1, F.lit(PART + 2 * (n - 1))).alias("near")))
    parts = base.select("doc", "text_hash", F.size("w").alias("n_words"), F.explode(near).alias("part")).select("doc", "text_hash", "n_words", "part.*")
    inner = lambda i: (i >= F.col("before")) & (i < F.col("before") + PART)
    places = F.filter(F.transform("near", lambda w, i: F.when(w.isin(anchors) & inner(i), i)), lambda i: i.isNotNull()) if anchors else F.array().cast("array<int>")
    # Place -1 is no hit: it stands for the row itself, once for each.
    places = F.concat(F.when(F.col("base") == 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")), places)
    scan = parts.select("doc", "text_hash", "n_words", "base", "before", "near", F.explode(places).alias("at"))
    start = F.col("at") - F.col("offset")
    return _folded(
        scan.join(F.broadcast(known), F.get("near", F.nullif("at", F.lit(-1))) == F.col("anchor"), "left").select(
            "doc", "text_hash", "n_words", (F.col("base") - F.col("before") + start).alias("start"), F.size("gram").alias("length"), "items", (F.col("at") < 0).cast("int").alias("first"),
            F.coalesce((start >= 0) & (F.slice("near", F.greatest(start, F.lit(0)) + 1, F.greatest(F.size("gram"), F.lit(0))) == F.col("gram")), F.lit(False)).alias("hit"),
        )
    )


def _by_shuffle(base: DataFrame, known: DataFrame) -> DataFrame:
    """For a benchmark that may not be broadcast: every document window meets the n-grams by a shuffle."""
    lengths = [r.length for r in known.select(F.size("gram").alias("length")).distinct().collect()]  # 1 to n rows
    every = base.select("doc", "text_hash", "w", F.explode(F.array(*[F.lit(x) for x in lengths]) if lengths else F.array().cast("array<int>")).alias("length")).where(F.size("w") >= F.col("length"))
    windows = every.select("doc", "text_hash", "length", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("start"))
    windows = windows.select("doc", "text_hash", "start", "length", F.slice("w", F.col("start") + 1, F.col("length")).alias("gram"))
    met = windows.join(known.select("gram", "items"), "gram").select("doc", "text_hash", F.lit(-1).alias("n_words"), "start", "length", "items", F.lit(0).alias("first"), F.lit(True).alias("hit"))
    none = base.select("doc", "text_hash", F.size("w").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast(known.schema["items"].dataType).alias("items"), F.lit(1).alias("first"), F.lit(False).alias("hit"))
    return _folded(none.unionByName(met))


def covered(spans: Column) -> Column:
    """The distinct word positions inside the spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents without contaminated ones, or (what="spans") with the hit words and
    the separators after them cut out of the text. Columns stay as they are. A key that is
    null or repeated: all rows of a contaminated key go, rows with a null key stay."""
    found = hits(docs, benchmark, text, key, **options).where(F.size("spans") > 0)
    if what == "documents":
        return by_ids(docs, materialise(found.select(key).where(F.col(key).isNotNull()).distinct(), "contaminated"), key, "left_anti")
    if what != "spans":
        raise ValueError(f"what must be documents or spans, not {what}")
    own = "".join(docs.columns) + "_"  # clashes with no column
    cuts = found.select(F.col(key).alias(own + "k"), F.col("text_hash").alias(own + "h"), covered(F.col("spans")).alias(own + "c"))
    joined = docs.join(cuts, F.col(key).eqNullSafe(F.col(own + "k")) & (F.xxhash64(text) == F.col(own + "h")), "left")
    parts = F.regexp_extract_all(text, F.lit(f"[^{RAW_SEPARATORS}]+[{RAW_SEPARATORS}]*"), F.lit(0))
    rest = F.filter(F.transform(parts, lambda p, i: F.when(~F.array_contains(own + "c", i), p)), lambda p: p.isNotNull())
    cut = F.concat(F.regexp_extract(text, f"^[{RAW_SEPARATORS}]*", 0), F.array_join(rest, ""))
    return joined.withColumn(text, F.when(F.col(own + "c").isNotNull(), cut).otherwise(F.col(text))).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per row of the documents, repeated rows included."""
    found = hits(docs, benchmark, **options)
    found = found.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows"))).drop("_row")
    n_hit = F.size(covered(F.col("spans"))).cast("long")
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)
), h AS (
  SELECT doc_id, item_id, i, n FROM p JOIN g USING (n, gram)
), c AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id
), s AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
