"""Media columns: Netpbm and BMP images to numpy arrays, area-resized NPY tiles and difference hashes.

``decode`` reads P1-P6 Netpbm and uncompressed 8-, 16-, 24- and 32-bit BMP, colour masks included; ``resize_area`` averages exact (fractional)
areas from an integral image; ``tile`` writes an ``.npy`` file; ``dhash`` compares neighbours of a 9 x 8 tile.
``media_features`` applies all of it to a column of binary media.

Null media give null features.  Media that cannot be decoded (other formats, broken off, empty of pixels, samples or
palette numbers above what the header allows) give null features and an ``error`` text.  Repeated rows
give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import table

BLOCK = 576  # bytes of one image row: 192 RGB pixels
WIDTH = BLOCK // 3


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    out, at = [], 2
    while len(out) < fields:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = (data.find(b"\n", at) + 1) or len(data)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def _size(w: int, h: int) -> None:
    if w <= 0 or h == 0:
        raise ValueError("image without pixels")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1:2]
    if kind in b"14":
        (w, h), at = _netpbm_header(data, 2)
        _size(w, h)
        if kind == b"4":
            rows = np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at).reshape(h, -1)
            return (1 - np.unpackbits(rows, axis=1)[:, :w]) * np.uint8(255)
        bits = np.frombuffer(data, np.uint8, -1, at - 1) if at <= len(data) else np.zeros(0, np.uint8)
        bits = bits[(bits == 48) | (bits == 49)][: w * h] - np.uint8(48)
        return (1 - bits.reshape(h, w)) * np.uint8(255)
    (w, h, top), at = _netpbm_header(data, 3)
    _size(w, h)
    if not 0 < top < 65536:
        raise ValueError("bad Netpbm maximum")
    deep = 3 if kind in b"36" else 1
    if kind in b"56":
        kept = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * deep, at)
    else:
        values = data[at:].split(None, w * h * deep)[: w * h * deep]
        if not all(v.isdigit() and len(v) < 6 for v in values):
            raise ValueError("bad Netpbm sample")
        kept = np.array(list(map(int, values)), np.int64)
    if len(kept) and kept.max() > top:
        raise ValueError("Netpbm sample above the maximum")
    kept = kept.reshape((h, w, 3) if deep == 3 else (h, w))
    return kept.astype(np.uint8) if top == 255 else (kept.astype(np.int64) * 255 // top).astype(np.uint8)


def _decode_bmp(data: bytes) -> np.ndarray:
    (start,) = struct.unpack_from("<I", data, 10)
    head, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if (packed, bits) not in ((0, 8), (0, 16), (0, 24), (0, 32), (3, 16), (3, 32)):
        raise ValueError("BMP kind not supported")
    _size(w, h)
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        if int(rows.max()) >= len(palette):
            raise ValueError("BMP palette number out of range")
        return palette[rows][:, :, 2::-1].copy()
    if packed == 3 or bits == 16:
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        pixels = np.ascontiguousarray(rows).view("<u2" if bits == 16 else "<u4").astype(np.int64)
        return np.stack([_channel(pixels, m) for m in masks], axis=2)
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()


def _channel(pixels: np.ndarray, mask: int) -> np.ndarray:
    shift = (mask & -mask).bit_length() - 1 if mask else 0
    return ((pixels & mask) >> shift) * 255 // max(1, mask >> shift)


def decode(data: bytes) -> np.ndarray:
    """An (h, w) or (h, w, 3) uint8 array; ValueError, and nothing else, for what is not a whole Netpbm or BMP image."""
    try:
        if data[:2] == b"BM":
            return _decode_bmp(data).astype(np.uint8, copy=False)
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return _decode_netpbm(data)
    except (struct.error, IndexError, OverflowError, MemoryError) as e:
        raise ValueError(f"broken image: {e}") from None
    raise ValueError("neither Netpbm nor BMP")


def encode_ppm(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    return b"P6\n%d %d\n255\n" % (w, h) + rgb.tobytes()


def encode_bmp(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + stride * h, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, stride * h, 2835, 2835, 0, 0) + rows.tobytes()


def _edges(sums: np.ndarray, n: int) -> np.ndarray:
    """The running sums along the first axis at n + 1 even, mostly fractional places, times n: all in whole numbers."""
    at = np.arange(n + 1) * (len(sums) - 1)
    low, part = at // n, at % n
    part = part.reshape(-1, *[1] * (sums.ndim - 1))
    return sums[low] * (n - part) + sums[np.minimum(low + 1, len(sums) - 1)] * part


def resize_area(gray: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean of each cell's exact area, from the integral image; float64."""
    whole = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1), np.int64)
    np.cumsum(gray, axis=0, dtype=np.int64, out=whole[1:, 1:])
    np.cumsum(whole, axis=1, out=whole)
    corners = _edges(_edges(whole, h).T, w).T
    cells = np.diff(np.diff(corners, axis=0), axis=1)
    return cells / (gray.shape[0] * gray.shape[1])


def luma(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else ((image[:, :, 0].astype(np.int64) * 299 + image[:, :, 1].astype(np.int64) * 587 + image[:, :, 2].astype(np.int64) * 114) // 1000)


def dhash(gray: np.ndarray) -> str:
    """64 bits: whether a cell of the 8 x 9 tile is less than its right neighbour."""
    t = resize_area(gray, 8, 9)
    return np.packbits((t[:, :-1] < t[:, 1:]).ravel()).tobytes().hex()


def tile(gray: np.ndarray, h: int = 16, w: int = 16) -> bytes:
    """A resized tile as the bytes of an .npy file."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(np.rint(resize_area(gray, h, w)).astype(np.uint8)), allow_pickle=False)  # rows first
    return out.getvalue()


def media_features(df: DataFrame, key: str = "page_id", media: str = "media") -> DataFrame:
    """(key, height, width, dhash, tile (NPY bytes), error) of each row's media."""

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                try:
                    im = None if data is None else decode(data)
                    g = None if im is None else luma(im)
                    rows.append((None,) * 5 if g is None else (g.shape[0], g.shape[1], dhash(g), tile(g), None))
                except ValueError as e:
                    rows.append((None, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.string())], names=[key, "height", "width", "dhash", "tile", "error"])

    kind = dict(df.dtypes)[key]
    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, height int, width int, dhash string, tile binary, error string")


def pack(text: bytes) -> bytes:
    """A text's bytes as an image: padded with 255 to whole rows; an odd number of rows as PPM, an even one as BMP."""
    rows = max(1, -(-len(text) // BLOCK))
    rgb = np.frombuffer(text.ljust(rows * BLOCK, b"\xff"), np.uint8).reshape(rows, WIDTH, 3)
    return encode_ppm(rgb) if rows % 2 else encode_bmp(rgb)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores each whole text losslessly as an image, reads it back and computes features.

    A null text counts as empty; an empty one is one row of 255s.  Equal texts give equal values.
    """

    def run(batches):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            out = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                t = t or b""
                kept = pack(t)
                image = decode(kept)
                payload = image.tobytes()
                gray = luma(image)
                out.append((len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(kept), hashlib.sha256(kept).hexdigest(), dhash(gray), hashlib.sha256(tile(gray)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


QUERIES = {"op8_media": op8_media}
ORACLE: dict[str, str] = {}
