"""Operator 11: spelling variants by a positional q-gram index with a count filter.

Words that differ by one inserted, deleted or replaced code point have their first
or their last half in common, so each word is dealt to the groups of its halves. In
a group only the rest of the words counts: its 2-grams, with their places and the
rest's length, are the keys of an inverted index. The postings that a word's own
grams name are merged by a heap; a word met often enough, as one edit spoils two
grams at most, is compared. Groups that are too large for a task are dealt again by
the halves of their rests, as often as needed, so no pair is lost and no group
stays large.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_ids, discard, materialise, sorted_groups, table

#: What a word is made of, and the capitals that are lower-cased.
RUN = "[a-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run in SLIP has lost a code point; words have as many code points and occurrences at least; a form is as many times as frequent.
SLIP, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Words of a group from which it is dealt again.
MOST_WORDS = 1000


def words(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): counted in the tasks that read the texts before they are shuffled.

    Null and empty texts have no words. A null key counts as an empty string.
    Repeated rows count as often as they occur; other columns aren't read.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(F.translate(text, CAPITALS, SMALL), F.lit(f"({RUN})"))).alias("run"))
    hashed = runs.select("run", F.crc32(F.encode(F.concat("key", F.lit(":"), "run"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    seen = hashed.select(F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return seen.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def halves(rows: DataFrame, own: Column, *keep: str) -> DataFrame:
    """Rows of the groups that a rest belongs to: own is the length of the group's shorter rests.

    A rest of that length or one more is known by its first half, and its other part
    stays in question, and by its last half.
    """
    head = F.floor(own / 2).cast("int")
    tail = (own - head).cast("int")
    long = F.length("rest")
    first = F.struct(F.concat("path", F.lit("<"), own.cast("string"), F.lit(":"), F.substring("rest", F.lit(1), head)).alias("path"), tail.alias("own"), F.substring("rest", head + 1, long).alias("rest"))
    last = F.struct(F.concat("path", F.lit(">"), own.cast("string"), F.lit(":"), F.substring("rest", long - tail + 1, tail)).alias("path"), head.alias("own"), F.substring("rest", F.lit(1), long - tail).alias("rest"))
    return rows.select(*keep, F.explode(F.array(first, last)).alias("g")).select("g.path", "g.own", "g.rest", *keep)


def one_edit(a: str, b: str) -> bool:
    """True if b, as long as a or one longer, is a with one code point inserted or replaced."""
    k, end = 0, len(a)
    while k < end and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if len(b) > end else k < end and a[k + 1 :] == b[k + 1 :]


def holds(postings: list[int], number: int) -> bool:
    k = bisect_left(postings, number)
    return k < len(postings) and postings[k] == number


class Index:
    """The shorter rests of a group by their 2-grams: (gram, place) to their numbers, ascending.

    Of the n + 1 grams of a padded rest one edit spoils two, so a near rest has n - 1
    of them. It is then in the postings of one of any three grams: those of the three
    with the shortest postings are merged, and what they hold is looked up in the others.
    """

    def __init__(self):
        self.rests: list[str] = []
        self.postings: defaultdict[tuple[str, int], list[int]] = defaultdict(list)

    @staticmethod
    def grams(rest: str) -> list[str]:
        """Padded, as what stands around the rests is equal; a rest of one code point has a gram that all such have."""
        padded = f"^{rest}$"
        return [padded[k : k + 2] for k in range(len(padded) - 1)] + ["^$"] * (len(rest) == 1)

    def near(self, rest: str, longer: bool) -> list[int]:
        """Numbers of the rests one edit away; longer: rest is one longer than those here.

        A replacement leaves grams at their places, an insertion moves those behind it by one.
        """
        found, grams = [], []
        for place, gram in enumerate(self.grams(rest)):
            lists = [self.postings.get((gram, place)), self.postings.get((gram, place - 1)) if longer else None]
            if any(lists):
                grams.append([x for x in lists if x])
        bound = max(1, len(rest) - 1)
        if len(grams) < bound:
            return found
        grams.sort(key=lambda lists: sum(map(len, lists)))
        few = len(grams) - bound + 1
        for number, same in groupby(heapq.merge(*chain.from_iterable(grams[:few]))):
            met = sum(1 for _ in same) + sum(any(holds(x, number) for x in lists) for lists in grams[few:])
            if met >= bound and one_edit(self.rests[number], rest):
                found.append(number)
        return found

    def add(self, rest: str) -> None:
        for place, gram in enumerate(self.grams(rest)):
            self.postings[gram, place].append(len(self.rests))
        self.rests.append(rest)


def near_in_groups(rows: DataFrame) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of near words that share a group, once for each group."""
    dealt = rows.select("path", (F.length("rest") - F.col("own")).alias("more"), "rest", "word", "n").repartition("path").sortWithinPartitions("path", "more")
    schema = "a string, a_n bigint, b string, b_n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(pairs: list[tuple]) -> pa.RecordBatch:
            columns = zip(*pairs, strict=True) if pairs else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], ["a", "a_n", "b", "b_n"])

        pairs: list[tuple] = []
        for group in sorted_groups(batches, "path"):
            if not (shorter := group.num_rows - pc.sum(group.column("more")).as_py()):
                continue
            rests, names, counts = (group.column(c).to_pylist() for c in ("rest", "word", "n"))
            index = Index()
            for k, rest in enumerate(rests):
                pairs += [(names[j], counts[j], names[k], counts[k]) for j in index.near(rest, k >= shorter)]
                if k < shorter:
                    index.add(rest)
            if len(pairs) > 20_000:
                yield batch(pairs)
                pairs = []
        yield batch(pairs)

    return dealt.mapInArrow(run, schema)


def near_pairs(counted: DataFrame, least_length: int = LEAST_LENGTH, most: int = MOST_WORDS) -> DataFrame:
    """Each pair of words one edit apart, once: (a, a_n, b, b_n), a the lesser one.

    counted has distinct words of least_length (two or more) code points or more, and n. The groups' sizes
    are counted, and those above most are dealt again by the rests' halves, until a
    rest has one code point. A group that stays is then at most as large as the
    alphabet allows for two code points.
    """
    whole = counted.select("word", "n", F.col("word").alias("rest"), F.lit("").alias("path"), F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("own")).where(F.col("own") >= least_length)
    rows = materialise(halves(whole, F.col("own"), "word", "n"), "spelling-groups")
    found, written = [], [rows]
    while True:
        large = materialise(rows.where("own > 1").groupBy("path").count().where(F.col("count") > most).select("path"), "spelling-large")
        written.append(large)
        found.append(near_in_groups(by_ids(rows, large, "path", "left_anti")))
        if large.isEmpty():
            break
        rows = materialise(halves(by_ids(rows, large, "path", "left_semi"), F.col("own"), "word", "n"), "spelling-groups")
        written.append(rows)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    # A pair may share more than one group.
    out = materialise(pairs.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("b_n")).otherwise(F.col("a_n")).alias("b_n")).dropDuplicates(["a", "b"]), "spelling-pairs")
    discard(*written)
    return out


def variants(counted: DataFrame, times: int = TIMES, least_length: int = LEAST_LENGTH, most: int = MOST_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of (word, n).

    form is the near word of largest n (ties: the least in code-point order) if that
    n is times the word's n or more, else null; root is reached by following forms to
    the last. Forms grow in n, so there are no circles and few steps.
    """
    counted = materialise(counted, "spelling-words")
    pairs = near_pairs(counted, least_length, most)
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    much = -F.col("best.less") >= times * F.col("n")
    own = materialise(
        counted.join(best, "word", "left").select("word", F.when(much, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, -F.col("best.less")).alias("form_n")),
        "spelling-forms",
    )
    roots = materialise(own.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not roots.where("moved").isEmpty():
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nearer, roots = roots, materialise(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(nearer)
    discard(pairs, counted)
    return own.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word of documents."""
    return variants(words(table(spark, sf_dir, "documents")))


#: Neighbours by deletions: equal once one code point is left out at the same place, or one word is the other with one left out.
SQL = """
with recursive bits(b, c, k) as (
  select range, range, 0 from range(256)
  union all
  select b, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, k + 1 from bits where k < 8
),
crc as (select list(c order by b) as cells from bits where k = 8),
runs as (
  select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run
  from documents
),
each_run as (select id, run, count(*) as times, hex(encode(id || ':' || run)) as code from runs group by all),
hashed as (
  select run, times, xor(list_reduce(
    list_transform(range(length(code) // 2), lambda k: cast('0x' || code[2 * k + 1 : 2 * k + 2] as bigint)),
    lambda c, x: xor(c // 256, cells[xor(c, x) % 256 + 1]), 4294967295), 4294967295) as h
  from each_run, crc
),
shown as (
  select case when h % 199 = 0 then left(run, cast(h % length(run) as bigint)) || substring(run, cast(h % length(run) as bigint) + 2) else run end as word, times from hashed
),
words as (select word, cast(sum(times) as bigint) as n from shown where length(word) >= 6 group by word having sum(times) >= 5),
cuts as (
  select word, n, k, left(word, k - 1) || substring(word, k + 1) as cut
  from (select word, n, unnest(range(1, length(word) + 1)) as k from words)
),
near as (
  select a.word, b.word as other, b.n as other_n from cuts a join cuts b on a.cut = b.cut and a.k = b.k and a.word <> b.word
  union
  select c.word, w.word, w.n from cuts c join words w on c.cut = w.word
  union
  select w.word, c.word, c.n from cuts c join words w on c.cut = w.word
),
ranked as (
  select word, other, other_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by other_n desc, other) as place from near
),
forms as (
  select w.word, case when other_n >= 5 * n then other end as form, n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * n then other_n end as form_n
  from words w left join ranked r on r.word = w.word and place = 1
),
steps(word, reached) as (
  select word, word from forms
  union all
  select s.word, f.form from steps s join forms f on f.word = s.reached where f.form is not null
)
select f.word, f.form, s.reached as root, f.n, f.n_near, f.form_n
from forms f join steps s using (word) join forms l on l.word = s.reached and l.form is null
"""
