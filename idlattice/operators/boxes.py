"""Boxes of texts among a page's words.

The searches run over ordered sub-sequences of words with gap rules, which no
built-in expression states plainly, so these three are Arrow functions: one call
for each batch of documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = pa.struct([("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("h", pa.int32())])
BOX_SQL = "struct<x:int,y:int,w:int,h:int>"
BOX_TYPE = T.StructType([T.StructField(c, T.IntegerType()) for c in "xywh"])
NOT_WORD, NOT_CODE = re.compile("[^a-z0-9/<]"), re.compile("[^a-zA-Z0-9/<]")
LOOK_ALIKE, NUMERIC, DIGITS = str.maketrans("oilzsbgq", "01125890"), str.maketrans("OoIlSsBb", "00115588"), str.maketrans("OoIil|!ZzSsBgG", "00111112255896")
TEXT_FIELDS = {"name", "father_name", "nationality", "sex", "gender", "mrz_line1", "mrz_line2"}
Word = dict


def middle(w: Word) -> float:
    return w["top"] + w["height"] / 2


def cluster(words: list[Word], tolerance: float) -> list[list[Word]]:
    """First line whose mean centre is nearer than tolerance takes a word."""
    lines: list[list[Word]] = []
    sums: list[float] = []
    for w in words:
        k = next((k for k, own in enumerate(lines) if abs(middle(w) - sums[k] / len(own)) < tolerance), None)
        if k is None:
            lines.append([w])
            sums.append(middle(w))
        else:
            lines[k].append(w)
            sums[k] += middle(w)
    return lines


def around(words: list[Word]) -> dict:
    x, y = min(w["left"] for w in words), min(w["top"] for w in words)
    return {"x": x, "y": y, "w": max(w["left"] + w["width"] for w in words) - x, "h": max(w["top"] + w["height"] for w in words) - y}


def runs(words: list[Word], texts: list[str], target: str, near: Callable[[Word, Word], bool]) -> Iterator[tuple[int, int]]:
    """Sub-sequences whose texts together are the target, each word near the one before."""
    for i in range(len(words)):
        held = ""
        for j in range(i, len(words)):
            if j > i and not near(words[j - 1], words[j]):
                break
            held += texts[j]
            if held == target:
                yield i, j + 1
            if len(held) > len(target) or not target.startswith(held):
                break


def page_lines(words: list[Word]) -> list[list[Word]]:
    whole = [w for w in words if w["text"] and None not in (w["left"], w["top"], w["width"], w["height"])]
    return [sorted(own, key=lambda w: w["left"]) for own in cluster(whole, 20)]


def alike(text: str) -> str:
    """Letters, digits, / and < in lower case, look-alikes as digits."""
    return NOT_WORD.sub("", text.lower()).translate(LOOK_ALIKE)


def locate(value: str | None, words: list[Word], lines: list[list[Word]], texts: list[list[str]] | None = None) -> dict | None:
    """Box of the run of words on one line that spells the value with the best mean confidence, look-alikes
    alike; else of the line with most words that equal one of its tokens. texts: the lines' words as alike gives them."""
    target = alike(value or "")
    if not target or not words:
        return None
    if texts is None:
        texts = [[alike(w["text"]) for w in own] for own in lines]
    close = lambda a, b: 0 <= b["left"] - (a["left"] + a["width"]) <= 120
    best, score = None, 0.0
    for own, said in zip(lines, texts, strict=True):
        for i, j in runs(own, said, target, close):
            mean = sum(0.9 if w["conf"] is None else w["conf"] for w in own[i:j]) / (j - i)
            if mean > score:
                best, score = own[i:j], mean
    if best:
        return around(best)
    tokens = [t.translate(LOOK_ALIKE) for t in value.lower().split() if re.fullmatch("[a-z0-9/<]+", t)]
    matched = [w for t in tokens for own, said in zip(lines, texts, strict=True) for w, x in zip(own, said, strict=True) if x == t]
    return around(max(cluster(matched, 20), key=len)) if matched else None


def code(text: str, numeric: bool) -> str:
    kept = NOT_CODE.sub("", text)
    return (kept.translate(NUMERIC) if numeric else kept).lower()


class Reading:
    """A page's words in reading order, prepared once for all its fields."""

    def __init__(self, words: list[Word]) -> None:
        self.whole = [w for w in words if w["text"] and w["text"].strip() and None not in (w["left"], w["top"], w["width"], w["height"])]
        lines = sorted((sorted(own, key=lambda w: w["left"]) for own in cluster(self.whole, 15)), key=lambda own: sum(w["top"] for w in own) / len(own))
        self.flat = [w for own in lines for w in own]
        self.lower = [w["text"].lower() for w in self.whole]
        self._texts: dict[bool, list[str]] = {}

    def texts(self, numeric: bool) -> list[str]:
        if numeric not in self._texts:
            self._texts[numeric] = [code(w["text"], numeric) for w in self.flat]
        return self._texts[numeric]


def map_field(field: str, value: str | None, words: list[Word] | Reading, anchors: list[str]) -> dict | None:
    """Box of a chosen value: runs in reading order, over line ends too, ranked by confidence and nearness to a label."""
    if not value or value == "NOT_FOUND":
        return None
    numeric = field not in TEXT_FIELDS
    if not (target := code(value, numeric)):
        return None
    page = words if isinstance(words, Reading) else Reading(words)
    flat, texts = page.flat, page.texts(numeric)

    def near(a: Word, b: Word) -> bool:
        if abs(middle(a) - middle(b)) < 15:
            return -20 <= b["left"] - (a["left"] + a["width"]) <= 150
        return -20 <= b["top"] - (a["top"] + a["height"]) <= 60

    found = [flat[i:j] for i, j in runs(flat, texts, target, near)]
    if not found:
        matched = [w for t in (code(v, numeric) for v in value.split()) if t for w, x in zip(flat, texts, strict=True) if x == t]
        found = [matched] if matched else []
    if len(found) < 2:
        return around(found[0]) if found else None
    labels = [middle(w) for w, said in zip(page.whole, page.lower, strict=True) if any(a in said for a in anchors)]

    def rank(own: list[Word]) -> float:
        box = around(own)
        distance = min((abs(box["y"] + box["h"] / 2 - y) for y in labels), default=0.0)
        return 100 * sum(0.85 if w["conf"] is None else w["conf"] for w in own) / len(own) - distance

    return around(max(found, key=rank))


def digit_runs(words: list[Word], size: int = 12) -> list[dict]:
    """Neighbouring words on a line that together have size digits, look-alikes resolved."""
    numbers = [w | {"digits": d} for w in words if w["text"] and None not in (w["left"], w["top"], w["width"], w["height"]) and (d := w["text"].translate(DIGITS)).isdigit()]
    out = []
    for own in cluster(numbers, 15):
        own.sort(key=lambda w: w["left"])
        for i in range(len(own)):
            held = ""
            for j in range(i, len(own)):
                if j > i and not 0 <= own[j]["left"] - (own[j - 1]["left"] + own[j - 1]["width"]) <= 120:
                    break
                held += own[j]["digits"]
                if len(held) == size:
                    part = own[i : j + 1]
                    out.append({"text": held, "raw": " ".join(w["text"] for w in part), "conf": sum(0.9 if w["conf"] is None else w["conf"] for w in part) / len(part)})
                if len(held) >= size:
                    break
    return out


def plain(values: pa.Array) -> list:
    """An array's values in Python; whole numbers and fractions by way of numpy, lists and structs by their parts."""
    if pa.types.is_list(values.type):
        ends = values.offsets.to_pylist()
        inner = plain(values.values.slice(ends[0], ends[-1] - ends[0])) if ends else []
        return [inner[a - ends[0] : b - ends[0]] if known else None for a, b, known in zip(ends, ends[1:], values.is_valid().to_pylist(), strict=False)]
    if pa.types.is_struct(values.type):
        names = [f.name for f in values.type]
        return [dict(zip(names, row, strict=True)) for row in zip(*map(plain, values.flatten()), strict=True)]
    if values.null_count == 0 and (pa.types.is_integer(values.type) or pa.types.is_floating(values.type)):
        return values.to_numpy(zero_copy_only=False).tolist()
    return values.to_pylist()


#: Documents whose words are Python objects at a time.
PAGES_AT_ONCE = 500


def by_page(*columns: pa.Array) -> Iterator[tuple]:
    """Rows of columns; their values become Python objects for some rows at a time."""
    for begin in range(0, len(columns[0]), PAGES_AT_ONCE):
        yield from zip(*(plain(c.slice(begin, PAGES_AT_ONCE)) for c in columns), strict=True)


@F.arrow_udf(T.ArrayType(BOX_TYPE))
def locate_all(values: pa.Array, words: pa.Array) -> pa.Array:
    out = []
    for own, page in by_page(values, words):
        lines = page_lines(page or [])
        texts = [[alike(w["text"]) for w in line] for line in lines]
        known = {v: locate(v, page or [], lines, texts) for v in dict.fromkeys(own or [])}
        out.append([known[v] for v in own or []])
    return pa.array(out, pa.list_(BOX))


@F.arrow_udf(T.ArrayType(BOX_TYPE))
def map_all(fields: pa.Array, words: pa.Array) -> pa.Array:
    """fields: arrays of (field, value, anchors)."""
    out = []
    for own, page in by_page(fields, words):
        reading = Reading(page or [])
        out.append([map_field(f["field"], f["value"], reading, f["anchors"] or []) for f in own or []])
    return pa.array(out, pa.list_(BOX))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("conf", T.DoubleType())])))
def digit_runs_of(words: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("text", pa.string()), ("raw", pa.string()), ("conf", pa.float64())]))
    return pa.array([digit_runs(page or []) for (page,) in by_page(words)], kind)


# So marked, the optimizer keeps them in a projection of their own instead of repeating
# them inside lambda functions, where no Python function can run.
locate_all, map_all, digit_runs_of = (f.asNondeterministic() for f in (locate_all, map_all, digit_runs_of))
