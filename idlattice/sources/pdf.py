"""First pages of PDF files: their text and the picture that they hold.

Files are read with their cross-reference tables or streams; where these are damaged,
objects are looked for in the whole file. Only what the first pages need is decoded.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a decoded stream, nested containers, and followed references above which a file is given up.
MOST_BYTES, MOST_DEPTH, MOST_STEPS = 64 << 20, 50, 10_000

WHITE = b"\0\t\n\f\r "
TOKEN = re.compile(rb"[\0\t\n\f\r ]*(?:%[^\r\n]*[\0\t\n\f\r ]*)*(<<|>>|[\[\]{}]|/[^\0\t\n\f\r ()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\0\t\n\f\r ]*>|[^\0\t\n\f\r ()<>\[\]{}/%]+)")
STARTS = re.compile(rb"(?<![0-9])(\d{1,9})[\0\t\n\f\r ]+\d{1,5}[\0\t\n\f\r ]+obj\b")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
ESCAPED = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
#: What letters behind a backslash mean.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Damaged(ValueError):
    """A file that can't be read."""


class Name(str):
    __slots__ = ()


class Word(bytes):
    """An operator or keyword."""

    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    about: dict
    raw: bytes


class Reader:
    """Values one behind the other."""

    def __init__(self, data: bytes, at: int = 0, stop: int | None = None):
        self.data, self.at, self.stop = data, at, len(data) if stop is None else stop

    def token(self) -> bytes | None:
        m = TOKEN.match(self.data, self.at, self.stop)
        if m is None:
            return None
        self.at = m.end()
        return m[1]

    def text(self) -> bytes:
        """A string in parentheses, which may nest; at is behind the first."""
        begin, depth = self.at, 1
        while depth:
            m = re.compile(rb"[\\()]").search(self.data, self.at, self.stop)
            if m is None:
                raise Damaged("a string has no end")
            self.at = m.end() + (m[0] == b"\\")
            depth += {b"(": 1, b")": -1, b"\\": 0}[m[0]]
        one = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r", b"\r\n") else m[1])
        return ESCAPED.sub(one, self.data[begin : self.at - 1])

    def value(self, depth: int = 0):
        """The next value, a Word for anything else, None at the end."""
        t = self.token()
        if t is None or depth > MOST_DEPTH:
            return None
        if t == b"(":
            return self.text()
        if t == b"<<":
            out = {}
            while isinstance(key := self.value(depth + 1), Name):
                out[str(key)] = self.value(depth + 1)
            return out
        if t == b"[":
            out = []
            while (item := self.value(depth + 1)) is not None and item != b"]":
                out.append(item)
            return out
        if t[:1] == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), t[1:]).decode("latin-1"))
        if t[:1] == b"<" and t[-1:] == b">":
            digits = re.sub(rb"\s|\0", b"", t[1:-1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if NUMBER.match(t):
            if t.isdigit() and (m := re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![A-Za-z0-9])").match(self.data, self.at, self.stop)):
                self.at = m.end()
                return Ref(int(t))
            return float(t) if b"." in t else int(t)
        return Word(t)


def inflate(data: bytes) -> bytes:
    """What can be decoded; a damaged end is left off."""
    unpack, out = zlib.decompressobj(), b""
    try:
        out = unpack.decompress(data, MOST_BYTES)
    except zlib.error:
        unpack, parts = zlib.decompressobj(), []
        try:
            for k in range(0, len(data), 1024):
                parts.append(unpack.decompress(data[k : k + 1024], MOST_BYTES))
        except zlib.error:
            pass
        out = b"".join(parts)
    if unpack.unconsumed_tail:
        raise Damaged("a stream is too large")
    return out


def unfiltered(data: bytes, columns: int, colours: int, bits: int) -> bytes:
    """Rows with PNG's filters undone."""
    wide, step = (columns * colours * bits + 7) // 8, max(1, colours * bits // 8)
    rows = len(data) // (wide + 1)
    grid = np.frombuffer(data[: rows * (wide + 1)], np.uint8).reshape(rows, wide + 1)
    out = np.zeros((rows + 1, wide), np.uint8)
    for y in range(rows):
        kind, row, above = int(grid[y, 0]), grid[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = row
        elif kind == 2:
            out[y + 1] = row + above
        elif kind == 1:
            for x in range(step):
                out[y + 1, x::step] = np.cumsum(row[x::step], dtype=np.uint8)
        else:
            now, up = [0] * (wide + step), [0] * step + above.tolist()
            for x, v in enumerate(row.tolist()):
                a, b, c = now[x], up[x + step], up[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                now[x + step] = (v + guess) & 255
            out[y + 1] = now[step:]
    return out[1:].tobytes()


class Pdf:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise Damaged("no PDF header")
        self.data, self.places, self.steps, self.held = data, {}, 0, {}
        self.trailer: dict = {}
        try:
            self.tables()
            whole = isinstance(self.get(self.get(self.trailer.get("Root")).get("Pages")), dict)
        except (Damaged, AttributeError, TypeError, KeyError, ValueError, IndexError, RecursionError):
            whole = False
        if not whole:
            self.places = {int(m[1]): m.start() for m in STARTS.finditer(data)}
            self.held.clear()
            found = [self.get(Ref(n)) for n in self.places]
            # Objects in streams are in no place of the file.
            for number, x in zip(list(self.places), found, strict=True):
                if isinstance(x, Stream) and x.about.get("Type") == "ObjStm":
                    head = Reader(self.decoded(x), stop=self.get(x.about.get("First"))) if isinstance(self.get(x.about.get("First")), int) else None
                    while head and isinstance(n := head.value(), int) and isinstance(head.value(), int):
                        self.places.setdefault(n, (number, None))
            roots = [n for n in self.places if isinstance(x := self.get(Ref(n)), dict) and x.get("Type") == "Catalog"]
            if not roots:
                raise Damaged("no catalogue")
            self.trailer = {"Root": Ref(roots[-1])}
        if "Encrypt" in self.trailer:
            raise Damaged("the file is encrypted")

    def tables(self) -> None:
        """Places of objects, by the newest table that has them."""
        at = self.data.rfind(b"startxref")
        todo, seen = [Reader(self.data, at + 9).value() if at >= 0 else None], set()
        while todo:
            at = todo.pop(0)
            if not isinstance(at, int) or not 0 <= at < len(self.data) or at in seen:
                if not seen:
                    raise Damaged("no cross-reference table")
                continue
            seen.add(at)
            reader = Reader(self.data, at)
            first = reader.value()
            about = self.table(reader) if first == b"xref" else self.table_stream(at)
            for k, v in about.items():
                self.trailer.setdefault(k, v)
            todo += [about.get("XRefStm"), about.get("Prev")]

    def table(self, reader: Reader) -> dict:
        while isinstance(start := reader.value(), int):
            for number in range(start, start + min(reader.value(), len(self.data) // 10)):
                place, _, kind = reader.value(), reader.value(), reader.value()
                if kind == b"n":
                    self.places.setdefault(number, place)
        return reader.value()

    def table_stream(self, at: int) -> dict:
        stream = self.object_at(at)
        widths, data = stream.about["W"], self.decoded(stream)
        spans = stream.about.get("Index") or [0, stream.about["Size"]]
        size, rows = sum(widths), 0
        for start, count in zip(spans[::2], spans[1::2], strict=True):
            for number in range(start, start + count):
                row = data[size * rows : size * (rows + 1)]
                rows += 1
                if len(row) < size or not size:
                    break
                a, b, c = (int.from_bytes(row[sum(widths[:k]) : sum(widths[: k + 1])], "big") for k in range(3))
                kind = a if widths[0] else 1
                if kind in (1, 2):
                    self.places.setdefault(number, b if kind == 1 else (b, c))
        return stream.about

    def object_at(self, at: int):
        m = STARTS.match(self.data, at + len(self.data[at : at + 16]) - len(self.data[at : at + 16].lstrip(WHITE)))
        if m is None:
            raise Damaged("no object at its place")
        reader = Reader(self.data, m.end())
        value = reader.value()
        if isinstance(value, dict) and (s := re.compile(rb"[\0\t\n\f\r ]*stream\r?\n?").match(self.data, reader.at)):
            size = self.get(value.get("Length"))
            stop = s.end() + size if isinstance(size, int) else -1
            if not (0 <= stop <= len(self.data) and self.data[stop : stop + 12].lstrip(WHITE).startswith(b"endstream")):
                stop = self.data.find(b"endstream", s.end())
            return Stream(value, self.data[s.end() : stop if stop >= 0 else len(self.data)])
        return value

    def get(self, value):
        """What a reference stands for; null for those of nothing."""
        while isinstance(value, Ref):
            self.steps += 1
            if self.steps > MOST_STEPS:
                raise Damaged("too many references")
            if value.number not in self.held:
                self.held[value.number] = None  # while it is read, it refers to nothing
                place = self.places.get(value.number)
                self.held[value.number] = self.in_stream(value.number, place[0]) if isinstance(place, tuple) else None if place is None else self.object_at(place)
            value = self.held[value.number]
        return value

    def in_stream(self, number: int, stream: int):
        holder = self.get(Ref(stream))
        data, first = self.decoded(holder), self.get(holder.about["First"])
        head = Reader(data, stop=first)
        while isinstance(n := head.value(), int):
            at = head.value()
            if n == number:
                return Reader(data, first + at).value()
        return None

    def decoded(self, stream: Stream) -> bytes:
        data, (names, settings) = stream.raw, self.filters(stream)
        for name, about in zip(names, settings, strict=True):
            if name in ("FlateDecode", "Fl"):
                data = inflate(data)
                if isinstance(about, dict) and self.get(about.get("Predictor", 1)) >= 10:
                    data = unfiltered(data, *(self.get(about.get(k, d)) for k, d in (("Columns", 1), ("Colors", 1), ("BitsPerComponent", 8))))
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0]).decode()
                data = bytes.fromhex(digits + "0" * (len(digits) % 2))
            elif name in ("DCTDecode", "DCT", "JPXDecode"):
                return data  # a picture file of its own
            else:
                raise Damaged(f"filter {name}")
        return data

    def filters(self, stream: Stream) -> tuple[list, list]:
        as_list = lambda x: x if isinstance(x, list) else [] if x is None else [x]
        names = [self.get(x) for x in as_list(self.get(stream.about.get("Filter")))]
        settings = [self.get(x) for x in as_list(self.get(stream.about.get("DecodeParms")))]
        return names, settings + [None] * (len(names) - len(settings))

    def pages(self, most: int | None = None) -> list[dict]:
        """Pages in order, with the resources that they inherit."""
        out, seen = [], set()
        todo = [(self.get(self.trailer["Root"]).get("Pages"), None)]
        while todo and (most is None or len(out) < most):
            ref, resources = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref.number in seen):
                continue
            if isinstance(ref, Ref):
                seen.add(ref.number)
            resources = node.get("Resources", resources)
            if isinstance(kids := self.get(node.get("Kids")), list):
                todo += [(k, resources) for k in reversed(kids)]
            else:
                out.append(node | {"Resources": self.get(resources) or {}})
        return out

    def content(self, page: dict) -> bytes:
        parts = self.get(page.get("Contents"))
        return b"\n".join(self.decoded(x) for x in map(self.get, parts if isinstance(parts, list) else [parts]) if isinstance(x, Stream))

    def text(self, page: dict) -> str:
        """Shown strings; a line for each change of height, a tab for each move along a line. Letters count as Latin-1."""
        reader, held, lines = Reader(self.content(page)), [], [[b""]]

        def move(down: bool) -> None:
            if down:
                lines.append([b""])
            elif lines[-1][-1]:
                lines[-1].append(b"")

        height = None
        while (x := reader.value()) is not None:
            if not isinstance(x, Word):
                held.append(x)
                continue
            if x in (b"Tj", b"TJ", b"'", b'"'):
                if x in (b"'", b'"'):
                    move(True)
                shown = held[-1] if held else b""
                lines[-1][-1] += b"".join(s if isinstance(s, bytes) else b" " if isinstance(s, int | float) and s < -200 else b"" for s in (shown if isinstance(shown, list) else [shown]))
            elif x == b"T*":
                move(True)
            elif x in (b"Td", b"TD") and len(held) >= 2:
                move(bool(held[-1]))
            elif x == b"Tm" and len(held) >= 6:
                move(held[-1] != height)
                height = held[-1]
            elif x == b"ID":  # a picture inside the content
                end = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)").search(reader.data, reader.at)
                reader.at = end.end() if end else len(reader.data)
            held = []
        return "\n".join(t for line in lines if (t := b"\t".join(line).decode("latin-1").strip()))

    def picture(self, page: dict) -> tuple[bytes, str] | None:
        """The first picture that the page draws, or else has, as a file of its own and its kind."""
        own = self.get(page["Resources"].get("XObject")) or {}
        drawn = [m.decode("latin-1") for m in re.findall(rb"/([^\0\t\n\f\r ()<>\[\]{}/%]+)[\0\t\n\f\r ]+Do\b", self.content(page))]
        for name in [*drawn, *own]:
            x = self.get(own.get(name))
            if isinstance(x, Stream) and x.about.get("Subtype") == "Image":
                return self.file_of(x)
        return None

    def file_of(self, x: Stream) -> tuple[bytes, str]:
        names, _ = self.filters(x)
        if names and names[-1] in ("DCTDecode", "DCT", "JPXDecode"):
            return self.decoded(x), "jp2" if names[-1] == "JPXDecode" else "jpeg"
        wide, high, bits = (self.get(x.about.get(k)) for k in ("Width", "Height", "BitsPerComponent"))
        space = self.get(x.about.get("ColorSpace"))
        colours = {"DeviceGray": 1, "CalGray": 1, "DeviceRGB": 3, "CalRGB": 3}.get(space if isinstance(space, str) else self.get(space[0]) if isinstance(space, list) else "")
        if isinstance(space, list) and self.get(space[0]) == "ICCBased":
            colours = {1: 1, 3: 3}.get(self.get(self.get(space[1]).about.get("N")))
        row = (wide * (colours or 0) * bits + 7) // 8
        data = self.decoded(x)
        if colours is None or bits not in (1, 2, 4, 8) or (colours == 3 and bits != 8) or len(data) < row * high:
            raise Damaged("a picture of unknown form")
        return png(data, wide, high, bits, colours, row), "png"


def png(data: bytes, wide: int, high: int, bits: int, colours: int, row: int) -> bytes:
    chunk = lambda kind, own: struct.pack(">I", len(own)) + kind + own + struct.pack(">I", zlib.crc32(kind + own))
    lines = b"".join(b"\0" + data[y * row : (y + 1) * row] for y in range(high))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, bits, 0 if colours == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def read(content: bytes | None, most: int | None = 1) -> tuple[list[str], bytes | None, str | None, str | None]:
    """Texts of the first pages (None: all), the first page's picture, its kind, and what went wrong."""
    texts: list[str] = []
    try:
        pdf = Pdf(content or b"")
        pages = pdf.pages(most)
        if not pages:
            raise Damaged("no page")
        texts += [pdf.text(p) for p in pages]
        picture, kind = pdf.picture(pages[0]) or (None, None)
        return texts, picture, kind, None
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, OverflowError, MemoryError, struct.error) as e:
        return texts, None, None, str(e) or type(e).__name__


def with_first_page(files: DataFrame, content: str = "content", most: int | None = 1) -> DataFrame:
    """Adds page_texts, picture (a picture file's bytes), picture_kind and error to files.

    A row per row. A file that is no PDF or is damaged has an error, and what could be
    read before it; null content likewise. Columns of these names are replaced.
    """
    added = {"page_texts": "array<string>", "picture": "binary", "picture_kind": "string", "error": "string"}
    kept = files.drop(*added)
    names = kept.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [f"{k} {v}" for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one at a time, as pictures are large
                one = batch.slice(k, 1)
                columns = zip(read(one.column(names.index(content))[0].as_py(), most), (pa.list_(pa.string()), pa.binary(), pa.string(), pa.string()), strict=True)
                yield pa.RecordBatch.from_arrays([*one.columns, *[pa.array([v], t) for v, t in columns]], [*names, *added])

    return kept.mapInArrow(run, schema)
