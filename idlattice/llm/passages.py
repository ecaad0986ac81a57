"""Passages of equal words, inside and across lines.

Seeds (16 words in a row) are taken at places that depend on the words around them
only. The first text with a seed keeps it. Consecutive seeds of a text that another
text keeps at the same distances are a chain; its ends are extended word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialise, slices, text_bytes
from .words import CHOICE, SEED, Words

#: Words beyond a chain's end that may be equal too: with CHOICE more, another seed would have been taken.
MARGIN = CHOICE - 1


def chains(found: DataFrame) -> DataFrame:
    """(doc, th, start, stop, kdoc, kth, kstart): runs of words of a text that its keeper has, from the seeds taken.

    The keeper of a seed is the first place of the least key with it. Seeds in their
    keeper's own place, or overlapping it, are left out. A seed of very many texts
    costs one row each; adaptive execution splits its join.
    """
    kept = materialise(found.groupBy("h").agg(F.min(F.struct("doc", "th", "place")).alias("k"), F.count("*").alias("n")).where("n > 1").select("h", "k"), "passages-kept")
    own = (F.col("k.doc") == F.col("doc")) & (F.col("k.th") == F.col("th"))
    hits = found.join(kept, "h").where(~(own & (F.col("place") - F.col("k.place") < SEED)))
    # Equal rows of the documents give equal hits.
    hits = hits.groupBy("doc", "th", "place").agg(F.min("k").alias("k"))
    order = Window.partitionBy("doc", "th").orderBy("place")
    before = F.lag(F.struct("k", "place")).over(order)
    follows = (before["k"]["doc"] == F.col("k.doc")) & (before["k"]["th"] == F.col("k.th")) & (F.col("place") - before["place"] == F.col("k.place") - before["k"]["place"]) & (F.col("place") - before["place"] <= CHOICE)
    numbered = hits.withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("chain", F.sum("new").over(order))
    grouped = numbered.groupBy("doc", "th", "chain").agg(F.min("place").alias("start"), (F.max("place") + SEED).alias("stop"), F.min("k").alias("k"))
    out = materialise(grouped.select("doc", "th", "start", "stop", F.col("k.doc").alias("kdoc"), F.col("k.th").alias("kth"), F.col("k.place").alias("kstart")), "passages-chains")
    discard(kept)
    return out


def surroundings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, th, at, left, near): hashes of the MARGIN words before (nearest first) or from a place on, for rows (doc, th, at, left)."""
    wanted = asked.distinct().groupBy("doc", "th").agg(F.collect_list(F.struct("at", "left")).alias("places"))
    joined = docs.select("doc", "th", "text").join(wanted, ["doc", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                words = Words.read(text_bytes(batch.column(2)))
                small = (words.hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                of, at, left, near = [], [], [], []
                for k, (end, n, places) in enumerate(zip(np.cumsum(words.texts).tolist(), words.texts.tolist(), batch.column(3).to_pylist(), strict=True)):
                    own = small[end - n : end]
                    for p in places:
                        of.append(k)
                        at.append(p["at"])
                        left.append(p["left"])
                        near.append(own[max(p["at"] - MARGIN, 0) : p["at"]][::-1] if p["left"] else own[p["at"] : p["at"] + MARGIN])
                rows = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32()), pa.array(left, pa.bool_()), pa.array(near, pa.list_(pa.int32()))], ["doc", "th", "at", "left", "near"])

    return joined.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, th int, at int, left boolean, near array<int>")


def passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, th, start, stop, again): the words of passages that texts share, again where a lesser key (or a place before) has them.

    docs: doc, th (a hash of the text, for rows of one key with several texts), text;
    found: doc, th, place, h of their seeds.
    """
    linked = chains(found)
    ends = F.explode(F.array(
        F.struct(F.lit(True).alias("left"), F.col("start").alias("at"), F.col("kstart").alias("kat")),
        F.struct(F.lit(False).alias("left"), F.col("stop").alias("at"), (F.col("kstart") + F.col("stop") - F.col("start")).alias("kat")),
    )).alias("end")
    sides = linked.select("doc", "th", "start", "stop", "kdoc", "kth", "kstart", ends).select("*", "end.left", "end.at", "end.kat").drop("end")
    keepers = sides.select(F.col("kdoc").alias("doc"), F.col("kth").alias("th"), F.col("kat").alias("at"), "left")
    # Equal rows of the documents give equal surroundings.
    near = materialise(surroundings(docs, sides.select("doc", "th", "at", "left").unionByName(keepers)).dropDuplicates(["doc", "th", "at", "left"]), "passages-near")
    own = sides.join(near.withColumnRenamed("near", "mine"), ["doc", "th", "at", "left"])
    theirs = near.select(F.col("doc").alias("kdoc"), F.col("th").alias("kth"), F.col("at").alias("kat"), "left", F.col("near").alias("other"))
    both = own.join(theirs, ["kdoc", "kth", "kat", "left"])
    differs = F.array_position(F.zip_with("mine", "other", lambda a, b: a.eqNullSafe(b)), False)
    more = F.when(differs > 0, differs - 1).otherwise(F.size("mine")).cast("int")
    grown = both.select("*", F.when(F.col("left"), more).otherwise(0).alias("l"), F.when(F.col("left"), 0).otherwise(more).alias("r"))
    again = grown.select("doc", "th", (F.col("start") - F.col("l")).alias("start"), (F.col("stop") + F.col("r")).alias("stop"), F.lit(True).alias("again"))
    size = F.col("stop") - F.col("start")
    kept = grown.select(F.col("kdoc").alias("doc"), F.col("kth").alias("th"), (F.col("kstart") - F.col("l")).alias("start"), (F.col("kstart") + size + F.col("r")).alias("stop"), F.lit(False).alias("again"))
    out = materialise(again.unionByName(kept.distinct()), "passages")
    discard(linked, near)
    return out
