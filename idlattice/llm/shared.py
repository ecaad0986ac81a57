"""What several of the corpus operators need: shared storage, joins with a size
check, connected components and plain Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a one-key table that a join may broadcast (about 32 MB as a hash relation).
BROADCAST_ROWS = 500_000

#: Common function words by language.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have had they you were their one all we can her has there been if more when will would who so no".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus ne se sont avec il ce ou mais elle nous son aux été leur cette ces comme".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue".split(),
}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    The cluster names it in spark.checkpoint.dir. Only a local session may go
    without: then a folder under /tmp/checkpoints serves.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, so
    that a lost executor costs one read, and keeps expensive passes from running twice."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Removes tables that materialise wrote, once everything that reads them has been written itself."""
    for df in written:
        jvm, path = df.sparkSession._jvm, df.__dict__.pop("_written_to")
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of wide rows with a table of ids.

    Up to BROADCAST_ROWS ids are broadcast, so the wide rows stay where they are;
    beyond that both sides are shuffled on the key.
    """
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if few else ids, key, how).select(*rows.columns)


def in_train(doc_id) -> object:
    """True where crc32 of the id as text, modulo 5, is not 0; null ids are held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 != 0, F.lit(False))


def held_out(doc_id) -> object:
    return ~in_train(doc_id)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The strings as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and, but for a longer single text, bytes of a text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for k, n in enumerate(sizes):
        if k > begin and (held + n > most or k - begin >= rows):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def sorted_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of equal key from batches that are sorted by it, skipping groups of one row.

    Holds one batch and the group that crosses its end.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([rest, part]).combine_chunks() if rest is not None else part
        keys = part.column(key).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if stop - start > 1:
                yield part.slice(start, stop - start)
        rest = part.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows > 1:
        yield rest


def components(edges: DataFrame, tag: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the least node reachable.

    edges has the long columns a and b. Alternates the large-star and small-star
    steps of Kiveris et al. (2014). A step is an aggregate with map-side combine
    and an equi-join, which adaptive execution splits at a hub; nothing goes to the
    driver but two numbers per round. Nodes without an edge to another are absent.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialise(both, tag), None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = (seen["n"], seen["h"])
        # Large star: each node's greater neighbours go to its least neighbour (itself included).
        around = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Least neighbours are written first: only a join whose two sides are plain shuffles can be split at a hub.
        old = now
        least = materialise(around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), tag)
        large = materialise(around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), tag)
        # Small star: each node and its lesser neighbours go to the least of them.
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), tag)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = materialise(small, tag)
        discard(old, least, large, low)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
