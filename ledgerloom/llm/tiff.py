"""TIFF pages as rows: a reader for baseline 8-bit images and the lossless store that op3 reads back.

The reader walks the chain of image directories in either byte order, gathers strips or tiles, undoes PackBits (32773),
LZW (5), deflate (8, 32946) or no compression (1) and the horizontal predictor (2), and gives one page per directory.

Defined cases: null bytes and bytes that are not TIFF give no pages from `pages` and one row with an error from
`read_pages`; a directory chain that loops ends at the first repeat, and one that leads nowhere ends with a row for the error, after the pages before it; a page's damage costs that
page only, whatever it is; predictors other than 1 and 2, and pages of more than MAX_SAMPLES, are errors; repeated
rows give repeated pages; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

ROW = 192  # bytes of a row of 64 RGB pixels
PAGE_ROWS = 1024
TILE = 64
#: Samples of a page, at most: what a task can hold.
MAX_SAMPLES = 1 << 28

# TIFF 6.0 tags, types and compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        end = at + 1
        while end < len(data) and end - at < 128 and data[end] == data[at]:
            end += 1
        if end - at > 1:
            out += bytes((257 - (end - at), data[at]))
        else:
            while end < len(data) and end - at < 128 and (end + 1 >= len(data) or data[end] != data[end + 1]):
                end += 1
            out += bytes((end - at - 1,)) + data[at:end]
        at = end
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early."""
    table: list[bytes] = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, width, bits, held, last = bytearray(), 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif last and code == len(table):
            word = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out[:size])


def lzw(data: bytes) -> bytes:
    table = {bytes((i,)): i for i in range(256)}
    codes, word = [(256, 9)], b""
    count, width = 258, 9
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        codes.append((table[word], width))
        table[longer] = count
        count += 1
        width = 9 if count < 512 else 10 if count < 1024 else 11 if count < 2048 else 12
        if count == 4095:
            codes.append((256, width))
            table = {bytes((k,)): k for k in range(256)}
            count, width = 258, 9
        word = data[i : i + 1]
    if word:
        codes.append((table[word], width))
        count += 1
        width = 9 if count < 512 else 10 if count < 1024 else 11 if count < 2048 else 12
    codes.append((257, width))
    held, bits, out = 0, 0, bytearray()
    for code, w in codes:
        held, bits = (held << w) | code, bits + w
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
    if bits:
        out.append(held << (8 - bits))
    return bytes(out)


def _expand(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        return data[:size]
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if scheme == LZW:
        return unlzw(data, size)
    if scheme == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {scheme}")


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, in order; raises where the chain is broken, after what came before."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF")
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise ValueError("not a TIFF")
    seen = set()
    while at and at not in seen:
        seen.add(at)
        if at + 2 > len(data):
            raise ValueError("directory beyond the end")
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 6 + 12 * n > len(data):
            raise ValueError("directory beyond the end")
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            letter, width = TYPES.get(kind, ("", 0))
            if not width:
                continue
            where = at + 2 + 12 * i + 8
            if width * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if where + width * count > len(data):
                raise ValueError("tag beyond the end")
            tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def pixels(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """rows x columns x samples of 8 bits."""
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    if not width or not height or any(b != 8 for b in tags.get(BITS, (8,))) or one(PLANAR, 1) != 1:
        raise ValueError("only chunky images of 8-bit samples")
    if width * height * samples > MAX_SAMPLES:
        raise ValueError("image too large")
    scheme, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor}")
    image = np.empty((height, width, samples), np.uint8)
    if TILE_OFFSETS in tags:
        tw, tl, offsets, counts = one(TILE_WIDTH), one(TILE_LENGTH), tags[TILE_OFFSETS], tags[TILE_COUNTS]
        if not tw or not tl:
            raise ValueError("tiles without a size")
        across = -(-width // tw)
        boxes = [(i // across * tl, i % across * tw, tl, tw) for i in range(across * -(-height // tl))]
    else:
        step, offsets, counts = min(one(ROWS_PER_STRIP, height), height), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
        if not step:
            raise ValueError("strips without rows")
        boxes = [(y, 0, min(step, height - y), width) for y in range(0, height, step)]
    for (y, x, h, w), offset, count in zip(boxes, offsets, counts, strict=True):
        size = h * w * samples
        block = np.frombuffer(_expand(data[offset : offset + count], scheme, size), np.uint8)
        if len(block) != size:
            raise ValueError("short strip or tile")
        block = block.reshape(h, w, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        image[y : y + h, x : x + w] = block[: height - y, : width - x]
    return image


def pages(data: bytes | None) -> list[np.ndarray]:
    return [pixels(data, tags) for tags in directories(data)] if data else []


def encode(images: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 2, tiled: bool = False, rows_per_strip: int = 256, order: str = "<") -> bytes:
    """A multi-page TIFF of 8-bit images (rows x columns x samples)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width, samples = image.shape
        if tiled:
            blocks = []
            for y in range(0, height, TILE):
                for x in range(0, width, TILE):
                    tile = np.zeros((TILE, TILE, samples), np.uint8)
                    part = image[y : y + TILE, x : x + TILE]
                    tile[: part.shape[0], : part.shape[1]] = part
                    blocks.append(tile)
        else:
            blocks = [image[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            raw = block.tobytes()
            body = {NONE: bytes, LZW: lzw, PACKBITS: pack_bits, DEFLATE: lambda b: zlib.compress(b, 1)}[scheme](raw)
            offsets.append(len(out))
            counts.append(len(body))
            out += body + b"\0" * (len(body) % 2)
        shape = [(TILE_WIDTH, 3, (TILE,)), (TILE_LENGTH, 3, (TILE,)), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tiled else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, (rows_per_strip,)), (STRIP_COUNTS, 4, counts)]
        tags = sorted([(WIDTH, 4, (width,)), (LENGTH, 4, (height,)), (BITS, 3, (8,) * samples), (COMPRESSION, 3, (scheme,)), (PHOTOMETRIC, 3, (2 if samples == 3 else 1,)), (SAMPLES, 3, (samples,)), (PLANAR, 3, (1,)), (PREDICTOR, 3, (predictor,)), *shape])
        fields = []
        for tag, kind, values in tags:
            letter, size = TYPES[kind]
            body = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(body) > 4:
                body, at = struct.pack(order + "I", len(out)), body
                out += at + b"\0" * (len(at) % 2)
            fields.append(struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_pages(media: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """One row per page: key, page, width, height, samples, pixels; for media that can't be read one row with error."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                walked, n = directories(data) if data is not None else iter(()), 0
                while True:
                    try:
                        tags = next(walked, None)
                    except Exception as error:  # the chain ends here
                        rows.append((name, n if n else None, None, None, None, None, str(error)))
                        break
                    if tags is None:
                        break
                    try:
                        image = pixels(data, tags)
                        rows.append((name, n, image.shape[1], image.shape[0], image.shape[2], image.tobytes(), None))
                    except Exception as error:  # whatever a page holds, it costs that page only
                        rows.append((name, n, None, None, None, None, f"{type(error).__name__}: {error}"))
                    n += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=["key", "page", "width", "height", "samples", "pixels", "error"])

    return media.select(F.col(key).cast("long").alias("key"), F.col(content).alias("content")).mapInArrow(run, "key long, page int, width int, height int, samples int, pixels binary, error string")


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def store(data: bytes) -> bytes:
    """The payload as RGB pages of 64 columns and up to PAGE_ROWS rows: deflate and predictor; tiles from the second page on."""
    grid = np.frombuffer(data, np.uint8).reshape(-1, 64, 3)
    first, rest = grid[:PAGE_ROWS], [grid[y : y + PAGE_ROWS] for y in range(PAGE_ROWS, len(grid), PAGE_ROWS)]
    if not rest:
        return encode([first])
    return _joined(encode([first]), encode(rest, tiled=True))


def _joined(one: bytes, two: bytes) -> bytes:
    """Two little-endian TIFFs as one chain of directories."""
    shift, moved = len(one), bytearray(two)
    at = struct.unpack_from("<I", two, 4)[0]
    last = struct.unpack_from("<I", one, 4)[0]
    while True:
        n = struct.unpack_from("<H", two, at)[0]
        for i in range(n):
            field = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from("<HHI", two, field)
            value = struct.unpack_from("<I", two, field + 8)[0]
            if TYPES[kind][1] * count > 4:
                struct.pack_into("<I", moved, field + 8, value + shift)
                if tag in (STRIP_OFFSETS, TILE_OFFSETS):
                    for k in range(count):
                        struct.pack_into("<I", moved, value + 4 * k, struct.unpack_from("<I", two, value + 4 * k)[0] + shift)
            elif tag in (STRIP_OFFSETS, TILE_OFFSETS):
                struct.pack_into("<I", moved, field + 8, value + shift)
        link = at + 2 + 12 * n
        at = struct.unpack_from("<I", two, link)[0]
        if not at:
            break
        struct.pack_into("<I", moved, link, at + shift)
    head = bytearray(one)
    while (n := struct.unpack_from("<H", one, last)[0]) and (to := struct.unpack_from("<I", one, last + 2 + 12 * n)[0]):
        last = to
    struct.pack_into("<I", head, last + 2 + 12 * n, struct.unpack_from("<I", two, 4)[0] + shift)
    return bytes(head + moved)


def feature(images: list[np.ndarray]) -> str:
    """Pages, mean sample, and a 64-bit mean hash of the samples' 8 x 8 block means over all pages."""
    flat = np.concatenate([x.reshape(-1) for x in images])
    blocks = flat.reshape(-1, 8, 8, 3)  # rows x 8 columns of blocks x 8 pixels x samples
    rows = blocks.astype(np.float64).mean(axis=(2, 3))
    cuts = np.linspace(0, len(rows), 9).round().astype(int)
    means = np.stack([rows[a : max(b, a + 1)].mean(axis=0) if a < len(rows) else rows[-1] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    bits = "".join("1" if x else "0" for x in (means >= means.mean()).reshape(-1))
    return f"p{len(images)}:m{flat.mean():.3f}:h{int(bits, 2):016x}"


def media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """op3's contract: each whole text stored as TIFF, read back page by page, with digests of what was read."""

    def of(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(8)]
        for text_ in texts:
            raw = payload(text_)
            media = store(raw)
            images = pages(media)
            back = b"".join(x.tobytes() for x in images)
            row = (len(text_.encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(images), len(images))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"])

    return map_slices(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), of, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int")


def op3_tiff_pages(spark, sf_dir: str) -> DataFrame:
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
