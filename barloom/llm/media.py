"""Media columns: Netpbm and BMP images, area resizing, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import record_batch, sliced, stored, texts_of

ROW = 64


class MediaError(ValueError):
    """The bytes are not an image of a kind that is read here."""


@dataclass(frozen=True)
class Image:
    """Samples (height, width) or (height, width, 3), and the value of full brightness."""

    samples: np.ndarray
    top: int


def encode_pgm(samples: np.ndarray) -> bytes:
    """An 8-bit grey image as binary Netpbm."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, dtype=np.uint8).tobytes()


def _header_numbers(data: bytes, many: int) -> tuple[list[int], int]:
    """The first numbers after the kind, and the place after the white space that ends them.

    Comments run from # to the end of the line. Each byte is looked at once.
    """
    out, at, n = [], 2, len(data)
    while len(out) < many:
        begin = at
        while at < n and (data[at] in b" \t\n\v\f\r" or data[at] == 35):
            if data[at] == 35:
                at = data.find(b"\n", at)
                at = n if at < 0 else at
            at += 1
        stop = at
        while stop < n and 48 <= data[stop] <= 57:
            stop += 1
        if begin == at or stop == at or stop - at > 10:
            raise MediaError("not a Netpbm header")
        out.append(int(data[at:stop]))
        at = stop
    if data[at : at + 1] == b"#":
        at = data.find(b"\n", at)
        at = n if at < 0 else at
    if at >= n or data[at] not in b" \t\n\v\f\r":
        raise MediaError("not a Netpbm header")
    return out, at + 1


def decode_netpbm(data: bytes) -> Image:
    """P1 to P6; of bitmaps 0 is white, which is 255 here."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise MediaError("not Netpbm")
    numbers, at = _header_numbers(data, 2 if kind in b"14" else 3)
    width, height, top = *numbers[:2], numbers[2] if len(numbers) == 3 else 1
    if not width or not height or not 0 < top < 65536:
        raise MediaError("Netpbm of an impossible size")
    shape = (height, width, 3) if kind in b"36" else (height, width)
    size = width * height * (3 if kind in b"36" else 1)
    if kind == b"4":
        stride = -(-width // 8)
        body = data[at : at + stride * height]
        if len(body) != stride * height:
            raise MediaError("Netpbm data are cut short")
        bits = np.unpackbits(np.frombuffer(body, dtype=np.uint8).reshape(height, stride), axis=1)[:, :width]
        return Image((1 - bits) * np.uint8(255), 255)
    if kind in b"56":
        dtype = np.dtype(np.uint8 if top < 256 else ">u2")
        body = data[at : at + size * dtype.itemsize]
        if len(body) != size * dtype.itemsize:
            raise MediaError("Netpbm data are cut short")
        return Image(np.frombuffer(body, dtype=dtype).reshape(shape).astype(dtype.newbyteorder("=")), top)
    rest = re.sub(rb"#[^\n]*", b" ", data[at:])
    words = re.findall(rb"[01]", rest) if kind == b"1" else rest.split()
    if len(words) < size:
        raise MediaError("Netpbm data are cut short")
    try:
        values = np.array(words[:size], dtype=np.int64).reshape(shape)
    except (ValueError, OverflowError) as e:
        raise MediaError("a sample is no number") from e
    if values.min() < 0 or values.max() > top:
        raise MediaError("a sample is out of range")
    return Image(((1 - values) * 255).astype(np.uint8), 255) if kind == b"1" else Image(values.astype(np.uint8 if top < 256 else np.uint16), top)


def encode_bmp(samples: np.ndarray) -> bytes:
    """A grey image as an 8-bit BMP with a grey palette, bottom row first."""
    height, width = samples.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), dtype=np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start) + info + palette.tobytes() + rows.tobytes()


def decode_bmp(data: bytes) -> Image:
    """Uncompressed BMP of 1, 4 or 8 (palette), 16, 24 or 32 bits, either row order."""
    if len(data) < 54 or data[:2] != b"BM":
        raise MediaError("not BMP")
    (start,) = struct.unpack_from("<I", data, 10)
    head, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (1, 4, 8, 16, 24, 32) or width < 1 or not height or head < 40:
        raise MediaError("BMP of another kind")
    rows, stride = abs(height), -(-width * bits // 32) * 4
    if len(data) < start + rows * stride:
        raise MediaError("BMP data are cut short")
    body = np.frombuffer(data, dtype=np.uint8, count=rows * stride, offset=start).reshape(rows, stride)
    body = body[::-1] if height > 0 else body
    if bits <= 8:
        (used,) = struct.unpack_from("<I", data, 46)
        used = used or 1 << bits
        if used > 1 << bits or len(data) < 14 + head + 4 * used:
            raise MediaError("the palette of a BMP is cut short")
        palette = np.frombuffer(data, dtype=np.uint8, count=4 * used, offset=14 + head).reshape(-1, 4)
        shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
        index = ((body[:, :, None] >> shifts) & np.uint8((1 << bits) - 1)).reshape(rows, -1)[:, :width]
        if index.max() >= used:
            raise MediaError("a BMP sample is outside its palette")
        out = palette[index][..., 2::-1]
        return Image(out[..., 0].copy() if (palette[:, :1] == palette[:, 1:3]).all() else out, 255)
    if bits == 16:  # five bits a colour
        words = body[:, : 2 * width].copy().view("<u2")
        five = np.stack([words >> 10 & 31, words >> 5 & 31, words & 31], axis=-1)
        return Image(((five * 255 + 15) // 31).astype(np.uint8), 255)
    return Image(body[:, : width * bits // 8].reshape(rows, width, bits // 8)[..., 2::-1].copy(), 255)


def image_of(data: bytes) -> Image:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def decode(data: bytes) -> np.ndarray:
    """The samples as a numpy array; bytes that are no whole image raise MediaError."""
    return image_of(data).samples


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, from an integral image; edges may split samples.

    Sums are whole numbers, so that only the last division rounds.
    """
    grey = image.astype(np.int64).sum(axis=2) if image.ndim == 3 else image
    rows, cols = grey.shape
    table = np.zeros((rows + 1, cols + 1), dtype=np.int64)
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.int64), axis=1, out=table[1:, 1:])

    def at_edges(values: np.ndarray, size: int, parts: int) -> np.ndarray:
        """parts times the sums up to each of the parts + 1 edges."""
        low, rest = np.divmod(np.arange(parts + 1) * size, parts)
        return values[low] * (parts - rest)[:, None] + values[np.minimum(low + 1, size)] * rest[:, None]

    cut = at_edges(at_edges(table, rows, height).T, cols, width).T
    return np.diff(np.diff(cut, axis=0), axis=1) / (rows * cols * (image.shape[2] if image.ndim == 3 else 1))


def npy_tile(image: Image, height: int = 8, width: int = 9) -> bytes:
    """The area-resized grey image as the bytes of an NPY file of 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(image.samples, height, width) * (255 / image.top)).clip(0, 255).astype(np.uint8))
    return out.getvalue()


def difference_hash(tile: bytes) -> str:
    """Bits of each sample being below its right neighbour, as hex."""
    grey = np.load(io.BytesIO(tile)).astype(np.int16)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def payload_image(text: str) -> tuple[int, np.ndarray]:
    data = text.encode("utf-8", "surrogatepass")
    padded = data + bytes(max(ROW, -(-len(data) // ROW) * ROW) - len(data))
    return len(data), np.frombuffer(padded, dtype=np.uint8).reshape(-1, ROW)


def store_text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as a binary grey image of 64 samples a row.

    A null or empty text gives one row of zeros. Repeated rows stay repeated.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in sliced(texts, 2 << 20):
                made = [payload_image(t) for t in texts[a:b]]
                yield record_batch(schema, [batch.column("doc_id").slice(a, b - a), [n for n, _ in made], [encode_pgm(x) for _, x in made]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored images (doc_id, n_bytes, media), a row for each.

    Null media and media that cannot be read have the reason in error and no features.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile", "error"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7 + ("no media",)
        try:
            image = image_of(data)
        except MediaError as e:
            return (None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, None, str(e))
        payload, tile = image.samples.tobytes(), npy_tile(image)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(tile), tile, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [features(data.as_py()) for data in batch.column("media")]
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield record_batch(schema, [batch.column("doc_id"), batch.column("n_bytes"), *columns])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, error string")


def text_media(docs: DataFrame) -> DataFrame:
    """Store each text as an image in the shared folder, read it back, compute features.

    Extra columns of docs are ignored; a null doc_id stays null; an empty table
    gives no rows; equal texts give equal values.
    """
    return media_features(stored(store_text_media(docs), "media"))
