"""Operator 13: which tokens of two tokenizers stand for the same bytes.

Python tokenises and cuts at the byte offsets where both sides end: it gives the distinct
groups of some texts and each text's group numbers. Spark's array functions make the
linked ids and the text of these groups once and put each document together from them.
Which documents hold a pair of ids linked is counted over the corpus, and each document's
pairs are joined with these counts: frequent pairs by a broadcast of bounded size, the
rest by a shuffle.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlattice.functions.bind import let

from .shared import BROADCAST_ROWS, materialise, slices, table

#: Between a character and a character that are no white space, a space begins a token on either side.
UNIT_ENDS = re.compile(r"(?<=\S)(?= \S)")
#: Units and bytes of groups that a worker remembers, the characters of the longest of these units, units that are
#: encoded in one call, and bytes of the texts of a row.
MEMORY, GROUP_BYTES, LONGEST, AT_ONCE, SLICE = 400_000, 64 << 20, 40, 4096, 2 << 20
#: Links of a group from which equal ids are counted before they are paired.
MANY = 256
#: Ids of B are below this; A's times this plus B's fit an int.
B_IDS = 32_000
#: Steps of the logarithm of a pair's count, from which the broadcast part is chosen.
STEPS = 4


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Sides:
    """Both tokenizers; texts are cut into units that neither has tokens across."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(byte_path, encoding="utf-8") as file:
            told = json.load(file)
        byte = byte_level()
        names = told["model"]["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
        special = {t["content"] for t in told["added_tokens"]}
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            self.a_bytes[k] = name.encode() if name in special else bytes(byte[c] for c in name)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if len(pieces) > B_IDS or any("▁" in p.lstrip("▁") for p in pieces) or len(self.a_bytes) * B_IDS > 2**31:
            raise ValueError("the tokenizers' ids don't fit, or a piece goes on behind a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int32) for side in (self.a_bytes, self.b_bytes))
        self.clear()

    def clear(self) -> None:
        """Forgets all units and groups, which changes no result."""
        self.memory: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.number: dict[bytes | int, int] = {}
        self.groups: list[tuple[bytes, bytes]] = []
        self.held = 0

    def forget(self) -> None:
        """Where too much is held, all but the units that came in more slices than one since the last time, if these are few."""
        if self.held > GROUP_BYTES or len(self.again) > MEMORY // 2:
            self.clear()
        elif len(self.memory) > MEMORY:
            self.memory, self.again = {u: self.memory[u] for u in self.again}, set()

    def encode(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Of each side the ids of the units, one behind the other, and their number by unit; which units both sides give
        back byte by byte. A unit stands behind a space; ids of units that aren't given back are left out."""
        behind = [" " + u for u in units]
        coded = ([x.ids for x in self.a.encode_batch_fast(behind, add_special_tokens=False)], self.b.encode(units, num_threads=1))  # B adds the space
        whole = [u.encode() for u in behind]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        good, ids, own = np.ones(len(units), bool), [], []
        for lists, bytes_of in zip(coded, (self.a_sizes, self.b_sizes), strict=True):
            own.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.int32, int(own[-1].sum())))
            total = np.concatenate(([0], np.cumsum(bytes_of[ids[-1]], dtype=np.int64)))[np.concatenate(([0], np.cumsum(own[-1])))]
            good &= np.diff(total) == sizes
        for lists, names in zip(coded, (self.a_bytes, self.b_bytes), strict=True):
            # Of the right sizes; nearly always all are right.
            left = np.flatnonzero(good).tolist()
            if b"".join(map(names.__getitem__, chain.from_iterable([lists[k] for k in left]))) != b"".join([whole[k] for k in left]):
                good[[k for k in left if b"".join(map(names.__getitem__, lists[k])) != whole[k]]] = False
        return [x[np.repeat(good, n)] for x, n in zip(ids, own, strict=True)], [n[good] for n in own], good

    def numbered(self, key: bytes | int, a: bytes, b: bytes) -> int:
        """The number of a group."""
        if (n := self.number.get(key)) is None:
            n = self.number[key] = len(self.groups)
            self.groups.append((a, b))
            self.held += 2 * (len(a) + len(b)) + 200
        return n

    def align(self, units: list[str]) -> tuple[list[bytes], list[str]]:
        """The numbers of each unit's groups as int32; the units that a side doesn't give back."""
        (a, b), (n_a, _), good = self.encode(units)
        a_ends, b_ends = np.cumsum(self.a_sizes[a], dtype=np.int64), np.cumsum(self.b_sizes[b], dtype=np.int64)
        ends = np.zeros((2, int(a_ends[-1]) + 1 if len(a) else 1), bool)
        ends[0, a_ends] = ends[1, b_ends] = True
        a_stops, b_stops = (np.concatenate(([0], np.flatnonzero(ends[other, own]) + 1)) for own, other in ((a_ends, 1), (b_ends, 0)))
        found = np.empty(len(a_stops) - 1, np.int32)
        single = (np.diff(a_stops) == 1) & (np.diff(b_stops) == 1)
        pairs, back = np.unique(a[a_stops[1:][single] - 1] * np.int64(B_IDS) + b[b_stops[1:][single] - 1], return_inverse=True)
        found[single] = np.array([self.numbered(p, *(np.int32(x).tobytes() for x in divmod(p, B_IDS))) for p in pairs.tolist()], np.int32)[back]
        a_raw, b_raw, a_at, b_at = a.tobytes(), b.tobytes(), (4 * a_stops).tolist(), (4 * b_stops).tolist()
        for k in np.flatnonzero(~single).tolist():
            x, y = a_raw[a_at[k] : a_at[k + 1]], b_raw[b_at[k] : b_at[k + 1]]
            found[k] = self.numbered(b"%d|%b%b" % (len(x), x, y), x, y)
        # Both sides end at a unit's end.
        stops = np.zeros(len(units) + 1, np.int64)
        stops[1:][good] = np.searchsorted(a_stops, np.cumsum(n_a))
        stops = (4 * np.maximum.accumulate(stops)).tolist()
        raw = found.tobytes()
        return [raw[x:y] for x, y in zip(stops, stops[1:])], [units[k] for k in np.flatnonzero(~good).tolist()]  # noqa: B905

    def aligned(self, texts: list[str]) -> list[bytes]:
        """The numbers of each text's groups as int32; none if it is empty or a side's bytes aren't those of one of its units."""
        self.forget()
        split, memory, bad = [split_units(t) for t in texts], self.memory, set()
        seen = set(chain.from_iterable(split))
        new = list(seen.difference(memory))
        self.again.update(seen.difference(new))
        for k in range(0, len(new), AT_ONCE):
            numbers, changed = self.align(new[k : k + AT_ONCE])
            memory.update(zip(new[k : k + AT_ONCE], numbers, strict=True))
            bad.update(changed)
        out = [b"" if bad and not bad.isdisjoint(own) else b"".join(map(memory.__getitem__, own)) for own in split]
        for u in bad.union(u for u in new if len(u) > LONGEST):
            del memory[u]
        return out

    def units(self, texts: list[str]) -> tuple[list[tuple[bytes, bytes]], list[list[int]]]:
        """The ids of both sides of the distinct groups of some texts, as int32, and each text's group numbers."""
        numbers = [np.frombuffer(x, np.int32).tolist() for x in self.aligned(texts)]
        return self.groups, numbers


def split_units(text: str) -> list[str]:
    """The units of a space and the text, each without the space that it begins with."""
    parts = text.split(" ")
    if "" in parts or list(map(str.strip, parts)) != parts:
        return [u[1:] for u in UNIT_ENDS.split(" " + text)] if text else []
    return parts


@lru_cache(maxsize=2)
def sides(byte_path: str, piece_path: str) -> Sides:
    return Sides(byte_path, piece_path)


def tokenise(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of many texts each: a and b are the ids of the texts' distinct groups, one behind the other, a_stops and b_stops
    where they stop, 0 first. docs: (key, n_a, n_b, groups, held), the numbers of a text's groups and the distinct ones with how often."""
    kind = docs.schema[key].dataType
    schema = f"a array<int>, a_stops array<int>, b array<int>, b_stops array<int>, docs array<struct<key:{kind.simpleString()},n_a:bigint,n_b:bigint,groups:array<int>,held:array<struct<group:int,n:int>>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(byte_path, piece_path)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int32()))
        for whole in batches:
            for batch in slices(whole, 1, most=SLICE, rows=10_000):
                found = both.aligned([t or "" for t in batch.column(1).to_pylist()])
                stops = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
                numbers = np.frombuffer(b"".join(found), np.int32)
                held = np.zeros(len(both.groups), bool)
                held[numbers] = True
                own = np.flatnonzero(held)
                at = (np.cumsum(held, dtype=np.int32) - np.int32(1))[numbers]
                groups = [both.groups[k] for k in own.tolist()]
                columns, sizes = [], []
                for side in (0, 1):
                    parts = [x[side] for x in groups]
                    n = np.array([len(x) // 4 for x in parts], np.int64)
                    columns += [one(np.frombuffer(b"".join(parts), np.int32)), one(np.concatenate(([0], np.cumsum(n))).astype(np.int32))]
                    sizes.append(pa.array(np.diff(np.concatenate(([0], np.cumsum(n[at])))[stops]), pa.int64()))
                each, n = np.unique(np.repeat(np.arange(len(found)), np.diff(stops)) * max(1, len(own)) + at, return_counts=True)
                of, group = np.divmod(each, max(1, len(own)))
                often = pa.StructArray.from_arrays([pa.array(group, pa.int32()), pa.array(n, pa.int32())], ["group", "n"])
                often = pa.ListArray.from_arrays(np.searchsorted(of, np.arange(len(found) + 1)).astype(np.int32), often)
                kept = pa.StructArray.from_arrays([batch.column(0), *sizes, pa.ListArray.from_arrays(stops, at), often], ["key", "n_a", "n_b", "groups", "held"])
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)], ["a", "a_stops", "b", "b_stops", "docs"])

    return docs.select(key, text).mapInArrow(run, schema)


def pair(a: Column, b: Column) -> Column:
    return a * F.lit(B_IDS) + b


def counted(ids: Column) -> Column:
    """(id, n) of the distinct ids."""
    return F.transform(F.array_distinct(ids), lambda x: F.struct(x.alias("id"), F.size(F.filter(ids, lambda y: y == x)).cast("long").alias("n")))


def numbers(stops: str) -> Column:
    """Of the stretches between stops."""
    return F.when(F.size(stops) > 1, F.sequence(F.lit(0), F.size(stops) - 2)).otherwise(F.array().cast("array<int>"))


def run_of(values: str, stops: str, k: Column) -> Column:
    """The values from stops[k] to stops[k + 1]."""
    return F.transform(F.sequence(F.get(stops, k), F.get(stops, k + 1) - 1), lambda i: F.get(values, i))


def single(k: Column) -> Column:
    """Most groups are a token of either side."""
    return F.get("both_stops", k + 1) - F.get("both_stops", k) == 2


def lasts(k: Column) -> tuple[Column, Column]:
    return F.get("a", F.get("a_stops", k + 1) - 1), F.get("b", F.get("b_stops", k + 1) - 1)


def large(k: Column) -> Column:
    many = (F.get("a_stops", k + 1) - F.get("a_stops", k)).cast("long") * (F.get("b_stops", k + 1) - F.get("b_stops", k)) >= MANY
    return (F.get("both_stops", k + 1) - F.get("both_stops", k) > 2 * int(MANY**0.5) - 1) & many  # the sum first: it is cheaper


def places(stops: str, k: Column) -> Column:
    return F.sequence(F.get(stops, k), F.get(stops, k + 1) - 1)


def with_ids(k: Column, body) -> Column:
    return let(run_of("a", "a_stops", k), lambda x: let(run_of("b", "b_stops", k), lambda y: body(x, y)))


def group_text(k: Column) -> Column:
    side = lambda ids, stops: F.array_join(F.transform(places(stops, k), lambda i: F.get(ids, i).cast("string")), ",")
    x, y = (v.cast("string") for v in lasts(k))
    return F.when(single(k), F.concat_ws("|", x, y)).otherwise(F.concat_ws("|", side("a", "a_stops"), side("b", "b_stops")))


def link(a: Column, b: Column, n: Column) -> Column:
    return F.struct(pair(a, b).alias("pair"), n.cast("long").alias("n"))


def group_links(k: Column) -> Column:
    """(pair, n) of the linked ids; of a group of very many links each pair is there once."""
    one = F.lit(1)
    weighed = with_ids(k, lambda x, y: let(counted(y), lambda z: F.flatten(F.transform(counted(x), lambda i: F.transform(z, lambda j: link(i["id"], j["id"], i["n"] * j["n"]))))))
    all_pairs = F.flatten(F.transform(places("a_stops", k), lambda i: F.transform(places("b_stops", k), lambda j: link(F.get("a", i), F.get("b", j), one))))
    return F.when(single(k), F.array(link(*lasts(k), one))).when(large(k), weighed).otherwise(all_pairs)


def align(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`, empty without tokens) and links.

    Text and links of the distinct groups of about SLICE bytes of texts are made once; a
    text's text is its groups' one behind the other. links are (pair, n), for each distinct
    group of the text its pairs (A's id times B_IDS plus B's) and how often they are linked
    by it. A row per row, repeated ones included. Null and empty texts, and texts that a
    side doesn't give back byte by byte, have no tokens.

    Each step is a projection of its own, so that what it makes lies in plain arrays for
    the next one, which looks single values up.
    """
    cut = tokenise(docs, byte_path, piece_path, text, key).select("*", F.zip_with("a_stops", "b_stops", lambda x, y: x + y).alias("both_stops"))
    each = lambda of: F.transform(numbers("a_stops"), of)
    grouped = cut.select("docs", each(group_text).alias("texts"), each(group_links).alias("links"))
    times = lambda h: F.transform(F.get("links", h["group"]), lambda x: F.struct(x["pair"].alias("pair"), (x["n"] * h["n"]).alias("n")))
    own = lambda d: F.struct(
        d["key"].alias("key"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), F.size(d["groups"]).cast("long").alias("n_groups"),
        F.array_join(F.transform(d["groups"], lambda g: F.get("texts", g)), ";").alias("groups"), F.flatten(F.transform(d["held"], times)).alias("links"),
    )
    rows = grouped.select(F.inline(F.transform("docs", own)))
    n_links = F.aggregate("links", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    return rows.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", n_links.alias("n_links"), "groups", "links")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many rows hold the pair linked, and whether no pair of its A id has more.

    The best of an id is one row for each id of A's vocabulary, which bounds the broadcast.
    """
    counts = materialise(aligned.select(F.explode(F.array_distinct("links.pair")).alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pair-counts")
    own = F.floor(F.col("pair") / B_IDS).cast("int")
    most = counts.groupBy(own.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", own).join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def frequent_from(counts: DataFrame, most_rows: int) -> int:
    """The least count from which all pairs together are at most most_rows; a power of two to the quarter, rounded up."""
    step = F.floor(F.log2("count") * STEPS).cast("int")
    rows, held = 0, 1 << 62
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 64 * STEPS rows
        rows += r["count"]
        if rows > most_rows:
            break
        held = int(np.floor(2 ** (r["step"] / STEPS)))
    return held


def best_links(aligned: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """aligned without links, with n_best and count_sum over each row's links.

    aligned has a column row that tells rows apart. Pairs are joined where the row is,
    by a broadcast of the frequent ones, and only links of other pairs are shuffled;
    each of these is in few rows.
    """
    counts = materialise(pair_counts(aligned), "pair-best")
    least = frequent_from(counts, broadcast_rows)
    own = [c for c in aligned.columns if c != "links"]
    links = aligned.select("row", F.inline("links"))
    sums = [F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    near = links.join(F.broadcast(counts.where(F.col("count") >= least)), "pair", "left")
    # A row's links stand together, so they are added up before anything is shuffled.
    found = near.groupBy("row").agg(*sums)
    rest = near.where(F.col("count").isNull()).select("row", "pair", "n").join(counts.where(F.col("count") < least), "pair")
    more = rest.groupBy("row").agg(*[s.alias(f"more_{n}") for s, n in zip(sums, ("n_best", "count_sum"), strict=True)])
    total = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"more_{c}", F.lit(0))).cast("long").alias(c)
    return aligned.select(*own).join(found, "row", "left").join(more, "row", "left").select(*own, total("n_best"), total("count_sum"))


def digests(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", key: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    rows = align(docs, byte_path, piece_path, text, key).withColumn("groups", F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256)))
    aligned = materialise(rows.withColumnRenamed("groups", "groups_sha256").withColumn("row", F.monotonically_increasing_id()), "aligned", "zstd")
    return best_links(aligned, key, broadcast_rows).select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    return digests(table(spark, sf_dir, "documents"), *vocabularies())
