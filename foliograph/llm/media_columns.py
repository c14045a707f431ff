"""Media columns: Netpbm and BMP images in binary columns.

Images are decoded to numpy arrays, resized to a small tile by area with an
integral image, and written as an NPY tile with a difference hash.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import python_ready, read_table

#: A tile's width and height; the hash compares neighbours in its rows, so it has 8 x 8 bits.
TILE_W, TILE_H = 9, 8
#: Payload images: bytes in a row of pixels (64 pixels of three samples).
ROW_BYTES = 192
#: Rows of pixels that are summed in one go.
STRIP = 4096


def _fields(data: bytes, n: int, at: int) -> tuple[list[int], int]:
    """``n`` numbers of a Netpbm header (comments run to the end of the line) and the place after the last."""
    found: list[int] = []
    while len(found) < n:
        while at < len(data) and data[at] in b" \t\n\r\x0b\x0c":
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if start == at:
            raise ValueError("a number is missing in the header")
        found.append(int(data[start:at]))
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (height, width, channels) of uint8, or uint16 where the greatest value is above 255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no Netpbm image")
    bitmap, plain, channels = kind in (b"P1", b"P4"), kind in (b"P1", b"P2", b"P3"), 3 if kind in (b"P3", b"P6") else 1
    head, at = _fields(data, 2 if bitmap else 3, 2)
    width, height, most = head[0], head[1], 1 if bitmap else head[2]
    if not (width and height and 0 < most < 65536):
        raise ValueError("an empty image or a wrong greatest value")
    size = width * height * channels
    if plain:
        body = b" ".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        values = np.array(list(body.translate(None, b" \t\r\n\x0b\x0c")) if bitmap else body.split(), dtype=np.int64)[:size]
        if bitmap:
            values = values - 48
    elif bitmap:
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)
        values = bits[:, :width].reshape(-1)
    else:
        values = np.frombuffer(data, ">u2" if most > 255 else np.uint8, size, at + 1)
    if len(values) < size or int(values.max()) > most:
        raise ValueError("samples are missing or too great")
    if bitmap:
        values = (1 - values) * 255
    return values.astype(np.uint16 if most > 255 else np.uint8).reshape(height, width, channels)


#: Where colours are in a pixel's number unless masks say it, by bits of a pixel: red, green, blue.
MASKS = {16: (0x7C00, 0x03E0, 0x001F), 32: (0xFF0000, 0x00FF00, 0x0000FF)}


def _channel(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The samples under a mask, from 0 to 255."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    samples = ((pixels & np.uint32(mask)) >> np.uint32(low)).astype(np.uint64)
    return ((samples * 255 + most // 2) // most).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits as (height, width, 3) of uint8; colour masks are read, transparency isn't."""
    if data[:2] != b"BM":
        raise ValueError("no BMP image")
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if head == 12:
        (width, height, _, bits), packing, colours, entry = struct.unpack_from("<HHHH", data, 18), 0, 0, 3
    elif head >= 40:
        width, height, _, bits, packing, _, _, _, colours, _ = struct.unpack_from("<iiHHIIiiII", data, 18)
        entry = 4
    else:
        raise ValueError("a BMP header that isn't read")
    masked = packing in (3, 6) and bits in MASKS
    if not (packing == 0 or masked) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        raise ValueError("a kind of BMP that isn't read")
    stride, rows = -(-width * bits // 32) * 4, abs(height)
    body = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        body = body[::-1]
    if bits == 24:
        return np.ascontiguousarray(body[:, : width * 3].reshape(rows, width, 3)[:, :, ::-1])
    if bits in MASKS:
        pixels = np.ascontiguousarray(body[:, : width * bits // 8]).view(f"<u{bits // 8}").astype(np.uint32)
        # masks are the first numbers behind a header of 40 bytes, and at the same place in a longer one
        masks = struct.unpack_from("<III", data, 54) if masked else MASKS[bits]
        return np.dstack([_channel(pixels, m) for m in masks])
    palette = np.frombuffer(data, np.uint8, entry * (colours or 1 << bits), 14 + head).reshape(-1, entry)
    index = body if bits == 8 else np.unpackbits(body, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1])
    return np.ascontiguousarray(palette[index[:, :width]][:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_ppm(payload: bytes, row_bytes: int = ROW_BYTES) -> bytes:
    """Bytes, a positive multiple of ``row_bytes``, as the samples of a P6 image."""
    return b"P6\n%d %d\n255\n" % (row_bytes // 3, len(payload) // row_bytes) + payload


def area_resize(image: np.ndarray, width: int = TILE_W, height: int = TILE_H) -> np.ndarray:
    """Means over the areas of a width x height grid, of the channels' mean, as float64.

    The integral image (sums of all samples above and left) is worked out strip
    by strip and kept only at the grid's lines; a line between two samples takes
    its share of the sample by linear interpolation, which is exact for areas.
    """
    rows, cols, _ = image.shape
    y, x = np.linspace(0, rows, height + 1), np.linspace(0, cols, width + 1)
    x0 = np.minimum(x.astype(np.int64), cols - 1)
    lines, above = np.zeros((height + 1, width + 1)), np.zeros(cols + 1)
    for at in range(0, rows, STRIP):
        grey = image[at : at + STRIP].sum(axis=2, dtype=np.float64)
        integral = np.zeros((len(grey) + 1, cols + 1))
        np.cumsum(np.cumsum(grey, axis=0), axis=1, out=integral[1:, 1:])
        integral += above
        for k in np.flatnonzero((y > at) & (y <= at + len(grey))):
            lo = min(int(y[k]) - at, len(grey) - 1)
            line = integral[lo] + (y[k] - at - lo) * (integral[lo + 1] - integral[lo])
            lines[k] = line[x0] + (x - x0) * (line[x0 + 1] - line[x0])
        above = integral[-1]
    sums = np.diff(np.diff(lines, axis=0), axis=1)
    return sums / (np.diff(y)[:, None] * np.diff(x)[None, :] * image.shape[2])


def tile_npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile.round().clip(0, 65535).astype(np.uint16), allow_pickle=False)
    return out.getvalue()


def difference_hash(tile: np.ndarray) -> str:
    """64 bits as 16 hex digits: in each of 8 rows, whether a cell is brighter than its left neighbour."""
    return np.packbits(np.diff(tile, axis=1) > 0).tobytes().hex()


def _tile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for data in b.column(0):
            raw = data.as_py()
            try:
                image = decode(raw or b"")
                tile = area_resize(image)
                out.append((image.shape[1], image.shape[0], image.shape[2], tile_npy(tile), difference_hash(tile), None))
            except (ValueError, struct.error, IndexError, OverflowError) as error:
                out.append((None, None, None, None, None, str(error)))
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, types, strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], *columns], [*b.schema.names[1:], "width", "height", "channels", "tile", "dhash", "error"])


def media_tiles(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep`` of each row, and width, height, channels, tile (NPY bytes), dhash, error of the image in ``media_col``.

    What can't be decoded (null and empty media among it) has only its error.
    Equal media give equal rows; repeated rows come back as often as they came;
    an empty table gives an empty result; columns that aren't kept don't matter,
    whatever their names.
    """
    python_ready(df.sparkSession)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "width int, height int, channels int, tile binary, dhash string, error string"])
    return df.select(F.col(media_col).cast("binary").alias("_media"), *(F.col(f"`{c}`") for c in keep)).mapInArrow(_tile_batches, schema)


def _stored_batches(batches: Iterator[pa.RecordBatch], row_bytes: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t.as_py() or b"" for t in b.column(1).cast(pa.binary())]
        media = [encode_ppm(t + b" " * (-len(t) % row_bytes if t else row_bytes), row_bytes) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, padded with spaces to whole rows of pixels, as a P6 image.

    Null texts are empty; an empty text is one row of spaces.  A null id stays
    null, repeated rows come back as often as they came, an empty table gives an
    empty result; other columns aren't looked at.  A text is one image, however
    long, and a batch holds some megabytes or one text.
    """
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_stored_batches, row_bytes=ROW_BYTES), "doc_id long, n_bytes long, media binary")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    for b in batches:
        out = []
        for cell in b.column(2):
            media = cell.as_py()
            image = decode(media)
            tile, payload = area_resize(image), image.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(tile), hashlib.sha256(tile_npy(tile)).hexdigest()))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every text stored as an image column, read back, and what the tile of it gives."""
    stored = store_texts(read_table(spark, sf_dir, "documents"))
    return stored.mapInArrow(_read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")
