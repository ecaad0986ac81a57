import struct
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from idlattice.sources import exif, readers


def tiff(order, image, taken=None, gps=None, thumbnail=None):
    """A TIFF file of directories {tag: (type, count, bytes)}."""
    e = "<" if order == b"II" else ">"

    def directory(entries, at, after=0):
        data, place = b"", at + 2 + 12 * len(entries) + 4
        out = struct.pack(f"{e}H", len(entries))
        for tag, (kind, count, value) in entries.items():
            if len(value) <= 4:
                out += struct.pack(f"{e}HHI", tag, kind, count) + value.ljust(4, b"\0")
            else:
                out += struct.pack(f"{e}HHII", tag, kind, count, place + len(data))
                data += value
        return out + struct.pack(f"{e}I", after) + data

    parts, at = [], 8
    image = dict(image)
    for tag, own in ((exif.EXIF_POINTER, taken), (exif.GPS_POINTER, gps)):
        if own is not None:
            image[tag] = (4, 1, b"\0" * 4)
    size = len(directory(image, at))
    place = at + size
    for tag, own in ((exif.EXIF_POINTER, taken), (exif.GPS_POINTER, gps)):
        if own is not None:
            image[tag] = (4, 1, struct.pack(f"{e}I", place))
            parts.append(directory(own, place))
            place += len(parts[-1])
    second = directory(thumbnail, place) if thumbnail else b""
    return order + struct.pack(f"{e}HI", 42, 8) + directory(image, at, place if thumbnail else 0) + b"".join(parts) + second


def jpeg(data):
    return b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xe1" + struct.pack(">H", len(data) + 8) + b"Exif\0\0" + data + b"\xff\xd9"


def png(data):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 3) + b"tEXtabc1234" + struct.pack(">I", len(data)) + b"eXIf" + data + b"1234"


def text(t):
    return (2, len(t) + 1, t.encode() + b"\0")


def sample(order):
    e = "<" if order == b"II" else ">"
    return tiff(
        order,
        {0x0131: text("Adobe Photoshop 24"), 0x0132: text("2024:02:01 10:00:00"), 0x0112: (3, 1, struct.pack(f"{e}H", 6)), 0x011A: (5, 1, struct.pack(f"{e}II", 72, 1)), 0x0102: (3, 3, struct.pack(f"{e}3H", 8, 8, 8)), 0xABCD: text("own")},
        {0x9003: text("2024:01:01 10:00:00"), 0x829A: (5, 1, struct.pack(f"{e}II", 1, 60)), 0x9000: (7, 4, b"0230")},
        {1: text("N"), 2: (5, 3, struct.pack(f"{e}6I", 18, 1, 58, 1, 1, 3))},
        {0x0103: (3, 1, struct.pack(f"{e}H", 6))},
    )


WANT = {
    "Image Software": "Adobe Photoshop 24", "Image DateTime": "2024:02:01 10:00:00", "Image Orientation": "6", "Image XResolution": "72", "Image BitsPerSample": "[8, 8, 8]", "Image Tag 0xABCD": "own",
    "EXIF DateTimeOriginal": "2024:01:01 10:00:00", "EXIF ExposureTime": "1/60", "EXIF ExifVersion": "0230", "GPS GPSLatitudeRef": "N", "GPS GPSLatitude": "[18, 58, 1/3]", "Thumbnail Compression": "6",
}


def test_tags_of_all_containers_and_byte_orders():
    for order in (b"II", b"MM"):
        for content in (sample(order), jpeg(sample(order)), png(sample(order))):
            assert exif.tags(content) == WANT


def test_damaged_files_have_what_can_be_read():
    whole = sample(b"II")
    for cut in range(len(whole)):
        assert exif.tags(whole[:cut]).items() <= WANT.items() or cut > 8
        exif.tags(jpeg(whole)[:cut])
    for content in (None, b"", b"plain text", b"\xff\xd8\xff\xd9", b"II*\0\xff\xff\xff\xff", b"\x89PNG\r\n\x1a\n" + b"\xff" * 40):
        assert exif.tags(content) == {}


def test_circles_and_huge_counts_end():
    circle = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", exif.EXIF_POINTER, 4, 1, 8) + struct.pack("<I", 8)
    assert exif.tags(circle) == {}
    huge = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 65535) + struct.pack("<HHII", 0x0131, 2, 0xFFFFFFFF, 8) * 80_000
    begin = time.perf_counter()
    assert exif.tags(huge) == {} and time.perf_counter() - begin < 2


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 250), st.binary(max_size=6))
def test_any_bytes(data, at, other):
    exif.tags(data)
    exif.tags(b"II*\0" + data)
    whole = sample(b"MM")
    exif.tags(jpeg(whole[:at] + other + whole[at:]))


def test_column(spark):
    rows = [(1, sample(b"II"), "x"), (2, jpeg(sample(b"MM")), None), (3, None, "y"), (4, b"", "z")]
    got = {r.doc_id: r.exif_tags for r in exif.with_tags(spark.createDataFrame(rows, "doc_id long, content binary, exif_tags string")).collect()}
    assert got == {1: WANT, 2: WANT, 3: {}, 4: {}}


def test_unreadable_files_are_rows(spark, tmp_path):
    """A file that fails while it is read is listed with HASH_ERROR; the others are hashed."""
    import hashlib

    for name, content in (("good.jpg", jpeg(sample(b"II"))), ("bad.png", b"damaged"), ("plain.tif", b"II*"), ("note.txt", b"no picture")):
        (tmp_path / name).write_bytes(content)
    (tmp_path / ".bad.png.crc").write_bytes(b"crc\0\0\0\2\0\1\2\3\4")  # Hadoop's local files check it
    facts = {r.image_path.rsplit("/", 1)[1]: r for r in readers.file_facts(spark, str(tmp_path)).collect()}
    assert set(facts) == {"good.jpg", "bad.png", "plain.tif"}
    assert facts["bad.png"].document_hash == "HASH_ERROR" and facts["bad.png"].exif_tags == {}
    assert facts["plain.tif"].document_hash == hashlib.sha256(b"II*").hexdigest() and facts["good.jpg"].exif_tags == WANT
