"""A page that can't be read doesn't end its file."""

import struct

from lodestone.llm import tiff


def test_pages_after_a_damaged_one_are_read(spark):
    raw = bytearray(tiff.write(bytes(range(64)) * 1094))  # two pages
    at = struct.unpack_from("<I", raw, 4)[0]
    for k in range(struct.unpack_from("<H", raw, at)[0]):
        if struct.unpack_from("<H", raw, at + 2 + 12 * k)[0] == 258:
            struct.pack_into("<H", raw, at + 10 + 12 * k, 4)  # 4-bit samples
    good = tiff.write(b"a" * 64)
    far = bytearray(good)
    struct.pack_into("<II", far, struct.unpack_from("<I", far, 4)[0] + 2 + 4, 1 << 20, 1 << 30)
    media = spark.createDataFrame([(1, bytes(raw)), (2, good), (3, bytes(far)), (4, None)], "doc_id long, media binary")
    got = {(r.doc_id, r.page): r.pixels for r in tiff.pages(media).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (3, 0)}
    assert got[1, 0] is None and got[3, 0] is None and got[2, 0] == b"a" * 64 and got[1, 1]


def directory(*tags, data=b""):
    """A little-endian file of one directory; tags: (tag, kind, count, value)."""
    out = b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(tags))
    return out + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0"


def test_whatever_is_wrong_with_a_directory_gives_a_row_of_nulls(spark):
    size = [(256, 4, 1, 4), (257, 4, 1, 4), (258, 3, 1, 8)]
    strip = [(273, 4, 1, 8), (279, 4, 1, 16)]
    bad = [
        directory(*size, (278, 4, 1, 0), *strip, data=bytes(16)),  # strips without rows
        directory(*size, (322, 4, 1, 0), (323, 4, 1, 16), (324, 4, 1, 8), (325, 4, 1, 16), data=bytes(16)),  # tiles without width
        directory((256, 4, 0, 4), *size[1:], *strip, data=bytes(16)),  # a tag without values
        directory(*size, (278, 4, 1, 1), (273, 4, 4, 8), (279, 4, 1, 16), data=bytes(16)),  # fewer sizes than strips
        directory((256, 4, 1, 1 << 31), (257, 4, 1, 1 << 31), *size[2:], *strip, data=bytes(16)),  # too large
        directory(*size, (277, 3, 1, 0), *strip, data=bytes(16)),  # no samples
        directory(*size, (259, 3, 1, 5), *strip, data=b"\xff" * 16),  # not LZW
        directory(*size, (259, 3, 1, 8), *strip, data=b"\xff" * 16),  # not deflate
        directory(*size, (278, 4, 1, 0xFFFFFFFF), (273, 4, 1, 0xFFFFFFF0), (279, 4, 1, 16), data=bytes(16)),  # a strip beyond the end
    ]
    good = directory(*size, *strip, data=bytes(range(16)))
    media = spark.createDataFrame([(k, x) for k, x in enumerate([good, *bad])], "doc_id long, media binary")
    got = {r.doc_id: r for r in tiff.pages(media).collect()}
    assert got[0].pixels == bytes(range(16)) and set(got) == set(range(len(bad) + 1))
    assert all(got[k].pixels is None and got[k].page == 0 for k in range(1, len(bad) + 1))


def test_one_row_for_each_page(spark):
    media = spark.createDataFrame([(1, tiff.write(bytes(64) * 2500)), (2, tiff.write(b"x" * 128)), (None, tiff.write(b"y" * 64))], "doc_id long, media binary")
    got = sorted(((r.doc_id or 0, r.page, r.height, len(r.pixels)) for r in tiff.pages(media).collect()))
    assert got == [(0, 0, 1, 64), (1, 0, 1024, 65536), (1, 1, 1024, 65536), (1, 2, 452, 452 * 64), (2, 0, 2, 128)]
