"""Width and height of an image from the first bytes of its file.

A file is read by ranges: one block of `BLOCK` bytes, and another block only where the place looked for lies behind it
(a JPEG's size may follow segments of many kilobytes, a TIFF's directory may stand at the end). No file costs more than
`MOST_BLOCKS` blocks; one that needs more, is cut short or is no image has no size. Sizes are the stored ones, whatever an
orientation tag says.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

BLOCK = 4096
MOST_BLOCKS = 64

Size = tuple[int, int]
#: Bytes from a place on, at most so many; fewer at the end of the file.
Read = Callable[[int, int], bytes]


class _Short(Exception):
    """The file ends, or costs more blocks than allowed, before its size is known."""


class _Ranges:
    """Bytes of a file by place; the last block is kept."""

    def __init__(self, read: Read) -> None:
        self.read, self.start, self.block, self.blocks = read, 0, b"", 0

    def at(self, place: int, n: int) -> bytes:
        if not (self.start <= place and place + n <= self.start + len(self.block)):
            if self.blocks == MOST_BLOCKS:
                raise _Short
            self.start, self.block, self.blocks = place, self.read(place, max(BLOCK, n)), self.blocks + 1
        got = self.block[place - self.start : place - self.start + n]
        if len(got) < n:
            raise _Short
        return got

    def numbers(self, layout: str, place: int) -> tuple[int, ...]:
        return struct.unpack(layout, self.at(place, struct.calcsize(layout)))


def _png(file: _Ranges) -> Size | None:
    return file.numbers(">II", 16) if file.at(12, 4) == b"IHDR" else None


def _gif(file: _Ranges) -> Size | None:
    return file.numbers("<HH", 6)


def _bmp(file: _Ranges) -> Size | None:
    (header,) = file.numbers("<I", 14)
    if header == 12:
        return file.numbers("<HH", 18)
    if header < 40:
        return None
    width, height = file.numbers("<ii", 18)  # a negative height counts rows from the top
    return (width, abs(height)) if width >= 0 else None


def _webp(file: _Ranges) -> Size | None:
    if file.at(8, 4) != b"WEBP":
        return None
    kind = file.at(12, 4)
    if kind == b"VP8X":
        low = file.at(24, 6)
        return 1 + int.from_bytes(low[:3], "little"), 1 + int.from_bytes(low[3:], "little")
    if kind == b"VP8L" and file.at(20, 1) == b"\x2f":
        (bits,) = file.numbers("<I", 21)
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 " and file.at(23, 3) == b"\x9d\x01\x2a":
        width, height = file.numbers("<HH", 26)
        return width & 0x3FFF, height & 0x3FFF
    return None


#: Start-of-frame markers, which carry the size; C4, C8 and CC are others. Markers without a length: TEM, RST0 to RST7.
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_BARE = frozenset({0x01, *range(0xD0, 0xD8)})


def _jpeg(file: _Ranges) -> Size | None:
    place = 2
    while True:
        if file.at(place, 1) != b"\xff" or file.at(place + 1, 1) in (b"\xff", b"\x00"):
            place += 1  # filling before a marker
            continue
        marker = file.at(place + 1, 1)[0]
        if marker in _BARE:
            place += 2
        elif marker in _FRAMES:
            height, width = file.numbers(">HH", place + 5)
            return width, height
        elif marker in (0xD8, 0xD9, 0xDA):
            return None
        else:
            place += 2 + file.numbers(">H", place + 2)[0]


#: Bytes and layouts of the whole numbers a TIFF tag may hold.
_TIFF_NUMBERS = {1: "B", 3: "H", 4: "I", 16: "Q"}


def _tiff(file: _Ranges) -> Size | None:
    order = "<" if file.at(0, 2) == b"II" else ">"
    (version,) = file.numbers(order + "H", 2)
    if version == 42:
        (place,), count, entry, value = file.numbers(order + "I", 4), order + "H", 12, 8
    elif version == 43:
        (place,), count, entry, value = file.numbers(order + "Q", 8), order + "Q", 20, 12
    else:
        return None
    (n,) = file.numbers(count, place)
    place += struct.calcsize(count)
    found: dict[int, int] = {}
    for k in range(n):
        tag, kind = file.numbers(order + "HH", place + k * entry)
        if tag in (256, 257) and kind in _TIFF_NUMBERS:
            (found[tag],) = file.numbers(order + _TIFF_NUMBERS[kind], place + k * entry + value)
        if len(found) == 2:
            return found[256], found[257]
    return None


_KINDS: dict[bytes, Callable[[_Ranges], Size | None]] = {
    b"\x89PNG\r\n\x1a\n": _png,
    b"\xff\xd8\xff": _jpeg,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"BM": _bmp,
    b"RIFF": _webp,
    b"II*\x00": _tiff,
    b"II+\x00": _tiff,
    b"MM\x00*": _tiff,
    b"MM\x00+": _tiff,
}


def image_size(read: Read) -> Size | None:
    """Width and height of a file given as a function that reads ranges of it; None where it has none."""
    file = _Ranges(read)
    try:
        # a file may be shorter than the longest mark
        file.block, file.blocks = read(0, BLOCK), 1
        for mark, size in _KINDS.items():
            if file.block.startswith(mark):
                return size(file)
    except _Short:
        return None
    return None


def image_size_of(content: bytes) -> Size | None:
    """Width and height of a file in hand."""
    return image_size(lambda place, n: content[place : place + n])
