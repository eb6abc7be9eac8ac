"""TIFF media columns: a writer, and a reader that walks image directories.

The reader takes either byte order, strips and tiles, samples of 8 or 16 bits, chunky or planar, no
compression, PackBits, LZW or deflate, with or without the horizontal predictor, and gives one row for
each page. The writer stores any bytes losslessly as 8-bit grey pages 64 pixels wide. Compression, strips
or tiles, and the predictor are told by the payload's checksum, so texts of every size meet every layout
and equal bytes give equal files.

Defined results: a null or empty text has an empty payload, padded to 64 zero bytes; repeated rows each
get a row; an empty table gives an empty result; a null file or one without a directory gives no page,
not a failure, in pages(), and a page that can't be read has a row of nulls, whatever is wrong with its
directory, also where it claims more pixels than its file can hold; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 64, 1024, 32, 64
MOST_BYTES, MOST_GROWTH = 1 << 30, 1 << 12  # of a page that is read, in all and for each byte of its file
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}


class Damaged(ValueError):
    """The file isn't a TIFF that this reader takes."""


class Page(NamedTuple):
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: np.ndarray  # (height, width, samples)


def unpack_bits(data: bytes, most: int = MOST_BYTES) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        c = data[i]
        i += 1
        if c < 128:
            out += data[i : i + c + 1]
            i += c + 1
        elif c > 128:
            out += data[i : i + 1] * (257 - c)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three equal bytes and more as runs, all between them as they are."""
    x = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(x)))
    out, held = bytearray(), 0

    def literal(s, e):
        for k in range(s, e, 128):
            part = data[k : min(e, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, n in zip(at[size >= 3].tolist(), size[size >= 3].tolist()):
        literal(held, s)
        for k in range(0, n, 128):
            m = min(128, n - k)
            out.extend(bytes([(257 - m) & 255, data[s]]) if m > 1 else bytes([0, data[s]]))
        held = s + n
    literal(held, len(data))
    return bytes(out)


def lzw_decode(data: bytes, most: int = MOST_BYTES) -> bytes:
    """Codes of 9 to 12 bits, high bits first, growing one code early; it ends once most bytes are there."""
    out, table, width, last, size = [], [], 9, b"", 0
    bits = have = 0
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        bits = (bits << 8 | byte) & 0xFFFFFF
        have += 8
        if have < width:
            continue
        have -= width
        code = bits >> have & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = start.copy(), 9, b""
            continue
        if not table:
            raise Damaged("LZW without a clear code")
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise Damaged("LZW code out of range")
        out.append(word)
        size += len(word)
        if size >= most:
            break
        if last and len(table) < 4096:
            table.append(last + word[:1])
        last = word
        n = len(table) + 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0
    table, width, word = {}, 9, b""

    def put(code):
        nonlocal bits, have
        bits = bits << width | code
        have += width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    put(256)
    table = {bytes([i]): i for i in range(256)}
    n = 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            put(256)
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = c
    if word:
        put(table[word])
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257)
    if have:
        out.append(bits << 8 - have & 255)
    return bytes(out)


def _inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


def _directory(raw: bytes, order: str, at: int) -> tuple[dict[int, list] | None, int]:
    """The tags, None where their values lie beyond the end, and the place of the next directory."""
    if at + 2 > len(raw):
        raise Damaged("directory beyond the end")
    n = struct.unpack_from(order + "H", raw, at)[0]
    if at + 6 + 12 * n > len(raw):
        raise Damaged("directory beyond the end")
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        size = _SIZE.get(kind, 1) * count
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * k)[0]
        if where + size > len(raw):
            tags = None
            break
        if kind in _CODE:
            tags[tag] = list(struct.unpack_from(f"{order}{count}{_CODE[kind]}", raw, where))
    return tags, struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


def _directories(raw: bytes):
    """(byte order, tags) of each directory of a file, in their order."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise Damaged("no TIFF header")
    at, seen = struct.unpack_from(order + "I", raw, 4)[0], set()
    while at:
        if at in seen:
            raise Damaged("directories in a circle")
        seen.add(at)
        tags, at = _directory(raw, order, at)
        yield order, tags


def read(raw: bytes):
    """The pages of a file, in the order of its directories."""
    for order, tags in _directories(raw):
        yield _page(raw, order, tags)


def _page(raw: bytes, order: str, tags: dict[int, list]) -> Page:
    if tags is None:
        raise Damaged("values beyond the end")
    one = lambda t, d: tags.get(t, [d])[0]
    width, height, samples, bits = one(256, 0), one(257, 0), one(277, 1), one(258, 1)
    how, predictor, planar = one(259, NONE), one(317, 1), one(284, 1)
    if bits not in (8, 16) or any(b != bits for b in tags.get(258, [bits])) or not width or not height or predictor not in (1, 2):
        raise Damaged("samples that aren't of 8 or 16 bits, or an empty page")
    tiled = 322 in tags
    bw, bh = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    starts, sizes = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    if bw <= 0 or bh <= 0 or samples <= 0 or planar not in (1, 2):
        raise Damaged("strips or tiles without pixels, or no samples")
    if max(width, bw) * max(height, bh) * samples * bits // 8 > min(MOST_BYTES, MOST_GROWTH * len(raw)):
        raise Damaged("more pixels than the file can hold")
    across, down, planes = -(-width // bw), -(-height // bh), samples if planar == 2 else 1
    if not starts or not sizes or min(len(starts), len(sizes)) < across * down * planes:
        raise Damaged("too few strips or tiles")
    kind, per = np.dtype(f"{order}u{bits // 8}"), samples // planes
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k in range(across * down * planes):
        plane, y, x = k // (across * down), k % (across * down) // across * bh, k % across * bw
        rows = bh if tiled else min(bh, height - y)
        need = rows * bw * per * bits // 8
        data = raw[starts[k] : starts[k] + sizes[k]]
        if how == PACKBITS:
            data = unpack_bits(data, need)
        elif how == LZW:
            data = lzw_decode(data, need)
        elif how in (DEFLATE, OLD_DEFLATE):
            data = _inflate(data, need)
        elif how != NONE:
            raise Damaged(f"compression {how}")
        if len(data) < need:
            raise Damaged("a strip or tile is too short")
        block = np.frombuffer(data, kind, rows * bw * per).reshape(rows, bw, per).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        h, w = min(rows, height - y), min(bw, width - x)
        out[y : y + h, x : x + w, plane * per : plane * per + per] = block[:h, :w]
    return Page(width, height, samples, bits, how, predictor, out)


def write(payload: bytes, width: int = WIDTH, page_rows: int = PAGE_ROWS) -> bytes:
    """A file of as many pages as the payload, a positive multiple of width (which tiles need to be of 16), takes."""
    n = len(payload)
    mark = zlib.crc32(payload)
    how, tiled, predictor = (LZW, PACKBITS, DEFLATE)[mark % 3], bool(mark >> 8 & 1), 1 + (mark >> 9 & 1)
    predictor = 1 if how == PACKBITS else predictor
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for at in range(0, n, width * page_rows):
        page = np.frombuffer(payload, np.uint8, min(width * page_rows, n - at), at).reshape(-1, width)
        rows, blocks = len(page), []
        step = TILE if tiled else STRIP_ROWS
        for y in range(0, rows, step):
            block = page[y : y + step]
            if tiled:
                block = np.concatenate([block, np.zeros((step - len(block), width), np.uint8)])
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            raw = block.tobytes()
            blocks.append(lzw_encode(raw) if how == LZW else pack_bits(raw) if how == PACKBITS else zlib.compress(raw, 1))
        starts, sizes = [], [len(b) for b in blocks]
        for b in blocks:
            starts.append(len(out))
            out += b
        tags = [(256, 4, [width]), (257, 4, [rows]), (258, 3, [8]), (259, 3, [how]), (262, 3, [1]), (277, 3, [1]), (284, 3, [1])]
        tags += [(317, 3, [predictor])] if predictor > 1 else []
        tags += [(322, 4, [width]), (323, 4, [step]), (324, 4, starts), (325, 4, sizes)] if tiled else [(273, 4, starts), (278, 4, [step]), (279, 4, sizes)]
        body = b""
        if len(out) & 1:
            out += b"\0"
        head = len(out)
        room = head + 6 + 12 * len(tags)
        entries = b""
        for tag, kind, values in sorted(tags):
            v = struct.pack(f"<{len(values)}{_CODE[kind]}", *values)
            if len(v) > 4:
                body, v = body + v, struct.pack("<I", room + len(body))
            entries += struct.pack("<HHI", tag, kind, len(values)) + v.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", head)
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + body
        link = room - 4
    return bytes(out)


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a file."""

    def run(batches):
        for rows, buf, offs in C.text_slices(batches):
            raw = buf.tobytes()
            media = [write(padded(raw[s:e])) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offs)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return C.source(docs, text_col, id_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pages(media: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, page, width, height, samples, bits, compression, predictor, pixels): a row for each page, null but for its number where it can't be read."""

    def run(batches):
        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                try:
                    for k, (order, tags) in enumerate(_directories(raw or b"")):
                        try:
                            p = _page(raw, order, tags)
                            rows.append((doc, k, *p[:6], p.pixels.tobytes()))
                        except _UNREADABLE:
                            rows.append((doc, k, *[None] * 7))
                except (Damaged, struct.error):  # the walk itself can't go on
                    pass
                if rows:
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in list(zip(*rows))[:8]], pa.array([r[8] for r in rows], pa.binary())], _PAGE)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, ", ".join(f"{x} long" for x in _PAGE[:-1]) + ", pixels binary")


_UNREADABLE = (Damaged, zlib.error, struct.error, ValueError, ArithmeticError, LookupError, MemoryError)
_PAGE = ["doc_id", "page", "width", "height", "samples", "bits", "compression", "predictor", "pixels"]
_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long"


def digest(media: DataFrame) -> DataFrame:
    """What the stored files hold, read back: sizes, hashes and simple features of the samples."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, n, raw in zip(*(b.column(k).to_pylist() for k in range(3))):
                got = list(read(raw))
                payload = b"".join(p.pixels.tobytes() for p in got)
                hist = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                level = np.arange(256)
                mean = float((hist * level).sum()) / len(payload)
                share = hist[hist > 0] / len(payload)
                feature = f"pages={len(got)};compression={got[0].compression};mean={mean:.4f};entropy={-(share * np.log2(share)).sum():.4f};levels={len(share)}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, len(got)))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [x.split(" ")[0] for x in _DIGEST.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _DIGEST)
