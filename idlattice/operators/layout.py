"""Geometry of words on a page, as expressions over arrays of words.

A word is a struct (text, left, top, width, height, conf). Folds keep the order of
their input, on which first-fit clustering depends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "struct<text:string,left:int,top:int,width:int,height:int,conf:double>"
WORDS = f"array<{WORD}>"


def placed(words: Column) -> Column:
    """Words with all of text, left, top, width and height."""
    keys = ("text", "left", "top", "width", "height")
    whole = lambda w: ~F.isnull(w[keys[0]]) & ~F.isnull(w[keys[1]]) & ~F.isnull(w[keys[2]]) & ~F.isnull(w[keys[3]]) & ~F.isnull(w[keys[4]])
    return F.filter(F.coalesce(words, F.array().cast(WORDS)), whole)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def mean(values: Column, default: Column | float | None = None) -> Column:
    """Mean of an array's non-null numbers; default for none."""
    some = F.filter(values, lambda x: x.isNotNull())
    out = F.when(F.size(some) > 0, total(some) / F.size(some))
    return out if default is None else F.coalesce(out, default if isinstance(default, Column) else F.lit(default))


def confidences(words: Column) -> Column:
    return F.transform(words, lambda w: w["conf"])


def mean_confidence(words: Column, default: float = 0.85) -> Column:
    return mean(confidences(words), default)


def union_box(words: Column) -> Column:
    """The least box (x, y, w, h) around words; null for none."""
    x = F.array_min(F.transform(words, lambda w: w["left"]))
    y = F.array_min(F.transform(words, lambda w: w["top"]))
    right = F.array_max(F.transform(words, lambda w: w["left"] + w["width"]))
    bottom = F.array_max(F.transform(words, lambda w: w["top"] + w["height"]))
    return F.when(F.size(words) > 0, F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h")))


def extent(words: Column) -> tuple[Column, Column]:
    """Greatest right and bottom edge."""
    return F.array_max(F.transform(words, lambda w: w["left"] + w["width"])), F.array_max(F.transform(words, lambda w: w["top"] + w["height"]))


def indexed(words: Column) -> Column:
    return F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))


def reading_order(words: Column, tolerance: int = 15) -> Column:
    """Bands from the topmost word on, each sorted from left to right.

    A band takes all words less than tolerance below its topmost word. Equal places
    keep the order of the input.
    """
    rows = F.array_sort(F.transform(words, lambda w, i: F.struct(w["top"].alias("top"), i.alias("i"), w.alias("w"))))
    kind = f"array<struct<band:int,left:int,i:int,w:{WORD}>>"
    begin = F.struct(F.lit(None).cast("int").alias("seed"), F.lit(-1).alias("band"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = s["seed"].isNull() | (x["top"] - s["seed"] >= tolerance)
        band = F.when(new, s["band"] + 1).otherwise(s["band"])
        one = F.struct(band.alias("band"), x["w"]["left"].alias("left"), x["i"].alias("i"), x["w"].alias("w"))
        return F.struct(F.when(new, x["top"]).otherwise(s["seed"]).alias("seed"), band.alias("band"), F.concat(s["out"], F.array(one)).alias("out"))

    return F.transform(F.array_sort(F.aggregate(rows, begin, step, lambda s: s["out"])), lambda x: x["w"])


def line_clusters(words: Column, tolerance: float = 20.0) -> Column:
    """Array of word arrays: each word joins the first line whose mean centre is nearer than tolerance, else begins one.

    Depends on the order of the words; a line's centre is the running mean of its words' centres.
    """
    kind = f"array<struct<sum:double,n:int,words:{WORDS}>>"
    middle = lambda w: w["top"] + w["height"] / 2.0

    def step(groups: Column, w: Column) -> Column:
        near = F.transform(groups, lambda g: F.abs(middle(w) - g["sum"] / g["n"]) < tolerance)
        at = F.array_position(near, True)
        joined = F.transform(
            groups,
            lambda g, i: F.when(i + 1 == at, F.struct((g["sum"] + middle(w)).alias("sum"), (g["n"] + 1).alias("n"), F.concat(g["words"], F.array(w)).alias("words"))).otherwise(g),
        )
        fresh = F.struct(middle(w).cast("double").alias("sum"), F.lit(1).alias("n"), F.array(w).alias("words"))
        return F.when(at > 0, joined).otherwise(F.concat(groups, F.array(fresh)))

    return F.transform(F.aggregate(words, F.array().cast(kind), step), lambda g: g["words"])


def by_left(words: Column) -> Column:
    rows = F.array_sort(F.transform(words, lambda w, i: F.struct(w["left"].alias("left"), i.alias("i"), w.alias("w"))))
    return F.transform(rows, lambda x: x["w"])


def rows_by_top(words: Column, tolerance: int = 15) -> Column:
    """Array of word arrays: a word joins the first row whose first word's top is nearer than tolerance."""
    kind = f"array<struct<top:int,words:{WORDS}>>"

    def step(rows: Column, w: Column) -> Column:
        at = F.array_position(F.transform(rows, lambda r: F.abs(w["top"] - r["top"]) < tolerance), True)
        joined = F.transform(rows, lambda r, i: F.when(i + 1 == at, F.struct(r["top"].alias("top"), F.concat(r["words"], F.array(w)).alias("words"))).otherwise(r))
        return F.when(at > 0, joined).otherwise(F.concat(rows, F.array(F.struct(w["top"].alias("top"), F.array(w).alias("words")))))

    return F.transform(F.aggregate(words, F.array().cast(kind), step), lambda r: r["words"])


def words_inside(words: Column, box: Column, slack: int = 4) -> Column:
    """Words whose centre is inside a box (x, y, w, h)."""
    return F.filter(
        words,
        lambda w: (w["left"] + w["width"] / 2.0).between(box["x"] - slack, box["x"] + box["w"] + slack) & (w["top"] + w["height"] / 2.0).between(box["y"] - slack, box["y"] + box["h"] + slack),
    )


def box_text(words: Column, box: Column) -> Column:
    """The text inside a box, line by line."""
    lines = F.array_sort(F.transform(line_clusters(words_inside(words, box), 15.0), lambda g, i: F.struct(mean(F.transform(g, lambda w: w["top"])).alias("top"), i.alias("i"), F.array_join(F.transform(by_left(g), lambda w: w["text"]), " ").alias("text"))))
    return F.array_join(F.transform(lines, lambda x: x["text"]), " ")


def overlap_share(a: Column, b: Column) -> Column:
    """Overlap of two boxes as a share of the smaller one's area; 0 if one has none."""
    x = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    y = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    area_a, area_b = a["w"] * a["h"], b["w"] * b["h"]
    return F.when((x > 0) & (y > 0) & (area_a > 0) & (area_b > 0), x * y / F.least(area_a, area_b)).otherwise(F.lit(0.0))


def overlapping_pairs(boxes: DataFrame, key: str = "doc_id", share: float = 0.3) -> DataFrame:
    """Pairs of a document's field boxes, in field order, that overlap by more than share of either.

    boxes: key, seq, field_name, box. Pairs meet inside the document's own array of
    boxes, of which there are few, so one shuffle by document is all.
    """
    listed = boxes.where(F.col("box").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "field_name", "box"))).alias("all"))
    pairs = F.flatten(F.transform("all", lambda a, i: F.transform(F.slice("all", i + 2, F.size("all")), lambda b: F.struct(a.alias("a"), b.alias("b"), overlap_share(a["box"], b["box"]).alias("share")))))
    return listed.select(key, F.explode(F.filter(pairs, lambda p: p["share"] > share)).alias("p")).select(key, F.col("p.a.field_name").alias("first"), F.col("p.b.field_name").alias("second"), F.col("p.share").alias("share"))


def nearest_distance(at: Column, places: Column, missing: float = 999.0) -> Column:
    """Least distance of a number to an array of numbers."""
    return F.coalesce(F.array_min(F.transform(places, lambda p: F.abs(at - p).cast("double"))), F.lit(missing))


def widest_gap(flags: Column) -> Column:
    """(start, length) of the longest run of true in an array; the first on a tie, null without one."""
    begin = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(-1).alias("start"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x["on"], s["run"] + 1).otherwise(F.lit(0))
        better = run > s["best"]
        return F.struct(run.alias("run"), F.when(better, run).otherwise(s["best"]).alias("best"), F.when(better, x["i"] - run + 1).otherwise(s["start"]).alias("start"))

    rows = F.transform(flags, lambda on, i: F.struct(on.alias("on"), i.alias("i")))
    return F.aggregate(rows, begin, step, lambda s: F.when(s["best"] > 0, F.struct(s["start"].alias("start"), s["best"].alias("length"))))


def first_index(values: Column, test: Callable[[Column], Column]) -> Column:
    """Index of the first value that passes, -1 for none."""
    return F.array_position(F.transform(values, lambda x: F.coalesce(test(x), F.lit(False))), True).cast("int") - 1


def last_index(values: Column, test: Callable[[Column], Column]) -> Column:
    hits = F.filter(F.transform(values, lambda x, i: F.when(F.coalesce(test(x), F.lit(False)), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(hits), F.lit(-1))


def shift_words(words: Column, dx: Column, dy: Column) -> Column:
    return F.transform(words, lambda w: F.struct(w["text"].alias("text"), (w["left"] + dx).alias("left"), (w["top"] + dy).alias("top"), w["width"].alias("width"), w["height"].alias("height"), w["conf"].alias("conf")))
