"""Tags of pictures: TIFF directories in JPEG, PNG and TIFF files, in either byte order.

Only offsets inside the file are followed, each directory once, and a value larger
than LONGEST is left out, so that a malformed file costs no more than its size. What
can't be read gives no tags.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a value above which it is left out (thumbnails, makers' notes), and tags of one file.
LONGEST, MOST_TAGS = 4096, 1000

# Fixed values of the EXIF standard: names of tags by directory, bytes of a value by type.
IMAGE_TAGS = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation",
    0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0115: "SamplesPerPixel",
    0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist",
    0x013C: "HostComputer", 0x8298: "Copyright", 0x9213: "ImageHistory", 0xC71B: "PreviewDateTime",
}
EXIF_TAGS = {
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized",
    0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9209: "Flash", 0x920A: "FocalLength", 0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal",
    0x9292: "SubSecTimeDigitized", 0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageLength", 0xA420: "ImageUniqueID",
    0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA433: "LensMake", 0xA434: "LensModel", 0x9213: "ImageHistory",
}
GPS_TAGS = {0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 29: "GPSDate"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
TEXT, RATIONAL, BYTES, SIGNED_RATIONAL = 2, 5, 7, 10
EXIF_POINTER, GPS_POINTER = 0x8769, 0x8825


def segment(content: bytes) -> bytes:
    """The TIFF part of a file; none is no bytes."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    if content[:2] == b"\xff\xd8":
        at = 2
        while content[at : at + 1] == b"\xff" and (kind := content[at + 1 : at + 2]) not in (b"\xda", b"\xd9", b""):
            if kind == b"\xff":  # a fill byte
                at += 1
                continue
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            if kind == b"\xe1" and content[at + 4 : at + 10] == b"Exif\0\0":
                return content[at + 10 : at + 2 + size]
            at += 2 + max(size, 2)
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(content):
            size = int.from_bytes(content[at : at + 4], "big")
            if content[at + 4 : at + 8] == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += 12 + size
    return b""


def shown(data: bytes, kind: int, count: int, order: str) -> str:
    """A value as text; several in brackets."""
    if kind == TEXT:
        return data.split(b"\0", 1)[0].decode("utf-8", "replace").strip()
    if kind == BYTES:
        return data.decode("latin-1") if data.isascii() and data.decode("latin-1").isprintable() else str(list(data))
    if kind in (RATIONAL, SIGNED_RATIONAL):
        parts = struct.unpack(f"{order}{2 * count}{'I' if kind == RATIONAL else 'i'}", data)
        values = [str(a // b) if b and a % b == 0 else f"{a}/{b}" for a, b in zip(parts[::2], parts[1::2], strict=True)]
    else:
        values = [str(v) for v in struct.unpack(f"{order}{count}{FORMATS[kind]}", data)]
    return values[0] if count == 1 else f"[{', '.join(values)}]"


def tags(content: bytes | None) -> dict[str, str]:
    """Names such as "Image Software" and "EXIF DateTimeOriginal" with their values; a second picture's tags are "Thumbnail"."""
    data = segment(content or b"")
    if len(data) < 8:
        return {}
    order = "<" if data[:2] == b"II" else ">"
    number = lambda at, size: int.from_bytes(data[at : at + size], "little" if order == "<" else "big")
    found: dict[str, str] = {}
    todo, seen = [(number(4, 4), "Image", IMAGE_TAGS)], set()
    while todo:
        at, group, names = todo.pop()
        if at in seen or not 8 <= at <= len(data) - 2:
            continue
        seen.add(at)
        entries = min(number(at, 2), (len(data) - at - 2) // 12)
        for entry in range(at + 2, at + 2 + 12 * entries, 12):
            tag, kind, count = number(entry, 2), number(entry + 2, 2), number(entry + 4, 4)
            size = SIZES.get(kind, 0) * count
            place = entry + 8 if size <= 4 else number(entry + 8, 4)
            if not 0 < size <= LONGEST or place + size > len(data) or len(found) >= MOST_TAGS:
                continue
            if tag in (EXIF_POINTER, GPS_POINTER) and kind == 4:
                todo.append((number(place, 4), "EXIF", EXIF_TAGS) if tag == EXIF_POINTER else (number(place, 4), "GPS", GPS_TAGS))
                continue
            found.setdefault(f"{group} {names.get(tag, f'Tag 0x{tag:04X}')}", shown(data[place : place + size], kind, count, order))
        if group == "Image" and (after := at + 2 + 12 * number(at, 2)) + 4 <= len(data) and number(after, 4):
            todo.append((number(after, 4), "Thumbnail", IMAGE_TAGS))
    return found


def with_tags(files: DataFrame, content: str = "content", tags_column: str = "exif_tags") -> DataFrame:
    """Adds a map of tags; empty for null, damaged or other content. One pass over Arrow batches."""
    kept = files.drop(tags_column)
    names = kept.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [f"`{tags_column}` map<string,string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [list(tags(c).items()) for c in batch.column(names.index(content)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(read, pa.map_(pa.string(), pa.string()))], [*names, tags_column])

    return kept.mapInArrow(run, schema)
