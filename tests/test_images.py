"""Sizes of image files of several formats, and listing by the executors."""

import os
import random
import struct
import zlib

import pytest
from linewright.sources import image_size, images, stores
from pyspark.sql import functions as F


def png(w, h):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    pixels = zlib.compress((b"\0" + bytes((w + 7) // 8)) * h)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 1, 0, 0, 0, 0)) + chunk(b"IDAT", pixels) + chunk(b"IEND", b"")


def gif(w, h):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80, 0, 0) + bytes(6) + b";"


def bmp(w, h, old=False, top_down=False):
    if old:
        return b"BM" + struct.pack("<IHHI", 26, 0, 0, 26) + struct.pack("<IHHHH", 12, w, h, 1, 24)
    return b"BM" + struct.pack("<IHHI", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, 24, 0, 0, 0, 0, 0, 0)


def webp(w, h, kind):
    if kind == b"VP8X":
        body = struct.pack("<I", 0) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")
    elif kind == b"VP8L":
        body = b"\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14 | 5 << 28)
    else:
        body = b"\x10\0\0\x9d\x01\x2a" + struct.pack("<HH", w | 1 << 14, h | 2 << 14)
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBP" + kind + struct.pack("<I", len(body)) + body + bytes(8)


def tiff(w, h, order="<", big=False, kind=4, far=0, before=2):
    """`before` other tags stand first; `far` bytes lie before the directory."""
    number, layout = {3: (3, "H"), 4: (4, "I"), 16: (16, "Q")}[kind]
    room = 8 if big else 4

    def entry(tag, code, form, value):
        count = struct.pack(order + ("Q" if big else "I"), 1)
        return struct.pack(order + "HH", tag, code) + count + struct.pack(order + form, value).ljust(room, b"\0")

    tags = [entry(k % 200, 3, "H", 7) for k in range(before)] + [entry(256, number, layout, w), entry(257, number, layout, h), entry(258, 3, "H", 8)]
    mark = b"II" if order == "<" else b"MM"
    start = (16 if big else 8) + far
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, start) if big else struct.pack(order + "HI", 42, start))
    return head + bytes(far) + struct.pack(order + ("Q" if big else "H"), len(tags)) + b"".join(tags)


def jpeg(w, h, segments=(), frame=0xC0, padding=0):
    out = b"\xff\xd8"
    for marker, size in segments:
        out += bytes([0xFF, marker]) + struct.pack(">H", size + 2) + bytes(random.Random(size).randbytes(size))
    out += b"\xff\xc4" + struct.pack(">H", 5) + b"abc" + b"\xff" * padding
    return out + bytes([0xFF, frame]) + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00" + b"\xff\xda\0\x08" + bytes(20) + b"\xff\xd9"


FILES = {
    "png": png,
    "gif": gif,
    "bmp": bmp,
    "bmp_old": lambda w, h: bmp(w, h, old=True),
    "bmp_top_down": lambda w, h: bmp(w, h, top_down=True),
    "webp_lossy": lambda w, h: webp(w, h, b"VP8 "),
    "webp_lossless": lambda w, h: webp(w, h, b"VP8L"),
    "webp_extended": lambda w, h: webp(w, h, b"VP8X"),
    "tiff": tiff,
    "tiff_short": lambda w, h: tiff(w, h, ">", kind=3),
    "tiff_far": lambda w, h: tiff(w, h, ">", far=500_000, before=900),
    "tiff_big": lambda w, h: tiff(w, h, big=True, kind=16, far=9000),
    "jpeg": jpeg,
    "jpeg_progressive": lambda w, h: jpeg(w, h, [(0xE0, 14)], frame=0xC2, padding=3),
    "jpeg_exif": lambda w, h: jpeg(w, h, [(0xE0, 14), (0xE1, 65000), (0xE2, 65533), (0xE2, 40000), (0xDB, 65)]),
}


@pytest.mark.parametrize("kind", FILES)
def test_sizes_cut_files_and_bytes_read(kind):
    """Every format; no size from a file that ends before it; few bytes read."""
    rng = random.Random(kind)
    for _ in range(5):
        w, h = rng.randrange(1, 16_000), rng.randrange(1, 300)
        content = FILES[kind](w, h)
        taken = []

        def read(place, n):
            taken.append(len(content[place : place + n]))
            return content[place : place + n]

        assert image_size.image_size(read) == (w, h)
        assert sum(taken) <= 8 * image_size.BLOCK and len(taken) <= 8
        whole = next(n for n in range(len(content) + 1) if image_size.image_size_of(content[:n])) if len(content) < 5000 else None
        assert whole is None or all(image_size.image_size_of(content[:n]) is None for n in range(whole))


def test_what_is_no_image():
    rng = random.Random(2)
    for content in (b"", b"x", b"BM", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"RIFF0000WAVEfmt ", b"II*\0" + b"\xff" * 4, b"plain text", b"GIF87"):
        assert image_size.image_size_of(content) is None
    assert image_size.image_size_of(b"\xff\xd8" + b"\xff\xda" + bytes(100)) is None
    assert image_size.image_size_of(b"\x89PNG\r\n\x1a\n" + bytes(40)) is None
    for _ in range(3000):
        content = bytearray(FILES[rng.choice(["png", "gif", "bmp", "webp_lossy", "tiff", "jpeg", "tiff_big"])](9, 9)[:400])
        for _ in range(rng.randrange(1, 6)):
            content[rng.randrange(len(content))] = rng.randrange(256)
        got = image_size.image_size_of(bytes(content))
        assert got is None or len(got) == 2
    endless = jpeg(5, 5, [(0xE2, 60_000)] * (image_size.MOST_BLOCKS + 1))
    assert image_size.image_size_of(endless) is None
    taken = []
    image_size.image_size(lambda place, n: taken.append(n) or (b"II*\0\x08\0\0\0\xff\xff" + bytes(1 << 20))[place : place + n])
    assert sum(taken) <= image_size.MOST_BLOCKS * image_size.BLOCK


ODD = ["plain.png", "two words.png", "50%.png", "a+b.png", "é ü.png", "hash#tag?.png", "_under.png", ".hidden.png", "UPPER.PNG", "no_extension", "a%20b.png", "semi;colon&.png"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw images")
    sizes = {}
    for k, name in enumerate(ODD):
        for place in ("", "batch_1/images/train", "batch 2/images"):
            (root / place).mkdir(parents=True, exist_ok=True)
            kind = list(FILES)[(3 * k + len(place)) % len(FILES)]
            (root / place / name).write_bytes(FILES[kind](20 + k, 30 + len(place)))
            sizes[str(root / place / name)] = (20 + k, 30 + len(place))
    (root / "batch_3" / "images").mkdir(parents=True)
    (root / "batch_1" / "notes.txt").write_text("no image")
    sizes[str(root / "batch_1" / "notes.txt")] = (None, None)
    (root / "batch_1" / "gone.png").symlink_to(root / "nowhere.png")
    return str(root), sizes


def test_listing_by_the_executors(spark, folder):
    root, sizes = folder
    got = images.image_listing(spark, root).collect()
    assert sorted(r.path for r in got) == sorted(sizes)
    assert all(r.size == os.path.getsize(r.path) for r in got)
    assert {r.path for r in images.image_listing(spark, root, "*.png").collect()} == {p for p in sizes if p.endswith(".png")}
    plan = images.image_listing(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "file_listing" in plan
    # Spark's own listing finds the same files, but for names that it takes for hidden
    spark_s = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(images.tidy_path(images.plain_path(F.col("_metadata.file_path"))).alias("path"), F.col("_metadata.file_path").alias("uri"))
    theirs = {r.path: r.uri for r in spark_s.collect()}
    assert set(theirs) == {p for p in sizes if os.path.basename(p)[0] not in "_."}
    for uri in theirs.values():
        with stores.ranges(uri) as read:
            assert read(0, 2) == open({u: p for p, u in theirs.items()}[uri], "rb").read(2)


def test_driver_lists_folders_only(folder):
    root, sizes = folder
    reader = images.FileListingReader("file://" + root.replace(" ", "%20"), "*")
    parts = [p.value for p in reader.partitions()]
    assert sorted(os.path.basename(p) for p, deep in parts if deep) == ["batch 2", "batch_1", "batch_3"] and sum(not deep for _, deep in parts) == 1
    rows = {os.path.basename(p.value[0]): sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()}
    assert rows["batch_3"] == 0 and rows["batch_1"] == len(ODD) + 1 and sum(rows.values()) == len(sizes)


def test_sizes_of_listed_files(spark, folder):
    root, sizes = folder
    got = {r.path: (r.width, r.height) for r in images.image_dims(spark, root).collect()}
    assert got == sizes
    gone = spark.createDataFrame([("x", "file:///nowhere/x.png")], "path string, uri string")
    assert images.with_sizes(gone).collect() == [("x", None, None)]
    contents = {r.path: r.content for r in images.with_contents(images.image_listing(spark, root).unionByName(gone.withColumn("size", F.lit(0).cast("long")))).collect()}
    assert contents.pop("x") is None and all(c == open(p, "rb").read() for p, c in contents.items()) and len(contents) == len(sizes)


def test_sizes_of_contents(spark):
    rows = [(k, make(7 + k, 9)) for k, make in enumerate(FILES.values())] + [(99, None), (98, b""), (97, b"text")]
    df = spark.createDataFrame(rows, "id int, content binary").select("id", images.content_size(F.col("content")).alias("s"))
    got = {r.id: r.s and tuple(r.s) for r in df.collect()}
    assert got == {k: (7 + k, 9) for k in range(len(FILES))} | {99: None, 98: None, 97: None}


def test_image_heads_are_no_longer_than_their_rows(spark, tmp_path):
    """Sizes of rows around the longest segment; a short row does not cost a padded segment of its own."""
    from catalog.records import a04
    from catalog.views import labels

    rows = [(d, "en", "src1", "x" * n) for d, n in enumerate([0, 3, 7000, 59999, 60000, 60001, 130000] * 6, 1)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {r.line_no: (r.width, r.height) for r in labels(spark, str(tmp_path)).collect()}
    out = a04(spark, str(tmp_path))
    assert {r.line_no: (r.width, r.height) for r in out.collect()} == want
    assert "rpad(text" not in out._jdf.queryExecution().optimizedPlan().toString()
