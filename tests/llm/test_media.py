import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from foliograph.llm import media_columns as mc

RNG = np.random.default_rng(8)


def bmp(image, bits=24, top_down=False, palette=None):
    h, w = image.shape[:2]
    if bits == 24:
        rows = [r[:, ::-1].tobytes() for r in image]
    elif bits == 32:
        rows = [np.dstack([r[None, :, ::-1], np.zeros((1, w, 1), np.uint8)]).tobytes() for r in image]
    else:
        rows = [np.packbits(np.unpackbits(r[:, None].astype(np.uint8), axis=1)[:, 8 - bits :].reshape(-1)).tobytes() for r in image]
    rows = [r + b"\0" * (-len(r) % 4) for r in rows]
    table = b"".join(bytes([*c[::-1], 0]) for c in palette) if palette is not None else b""
    head = struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, bits, 0, 0, 0, 0, len(palette) if palette is not None else 0, 0)
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(table)) + head + table + b"".join(rows if top_down else rows[::-1])


def test_netpbm_kinds():
    grey, rgb = RNG.integers(0, 256, (5, 7), dtype=np.uint8), RNG.integers(0, 256, (4, 3, 3), dtype=np.uint8)
    deep, bit = RNG.integers(0, 60000, (3, 4)).astype(">u2"), RNG.integers(0, 2, (3, 11))
    text = lambda a: " ".join(map(str, np.asarray(a).reshape(-1))).encode()
    assert np.array_equal(mc.decode(b"P5 7 5 255\n" + grey.tobytes())[:, :, 0], grey)
    assert np.array_equal(mc.decode(b"P2\n# note\n7 5\n255\n" + text(grey))[:, :, 0], grey)
    assert np.array_equal(mc.decode(b"P6\n3 4\n255\n" + rgb.tobytes()), rgb) and np.array_equal(mc.decode(b"P3 3 4 255 " + text(rgb)), rgb)
    assert np.array_equal(mc.decode(b"P5 4 3 60000\n" + deep.tobytes())[:, :, 0], deep)
    want = ((1 - bit) * 255).astype(np.uint8)
    assert np.array_equal(mc.decode(b"P4 11 3\n" + np.packbits(bit, axis=1).tobytes())[:, :, 0], want)
    assert np.array_equal(mc.decode(b"P1 11 3\n" + b"\n".join(bytes(48 + r) for r in bit.astype(np.uint8)))[:, :, 0], want)


def test_bmp_kinds():
    rgb = RNG.integers(0, 256, (5, 3, 3), dtype=np.uint8)
    palette = RNG.integers(0, 256, (16, 3), dtype=np.uint8)
    index = RNG.integers(0, 16, (4, 7))
    for how in ({}, {"top_down": True}, {"bits": 32}):
        assert np.array_equal(mc.decode(bmp(rgb, **how)), rgb)
    for bits in (4, 8):
        assert np.array_equal(mc.decode(bmp(index, bits, palette=palette)), palette[index])
    assert np.array_equal(mc.decode(bmp(index % 2, 1, palette=palette[:2])), palette[index % 2])


def packed(image, masks, bits, head=40, packing=3):
    """A BMP whose pixels are numbers with the colours under masks; a fourth mask's bits are set."""
    h, w = image.shape[:2]
    pixels = np.zeros((h, w), np.uint32)
    for mask, samples in zip(masks, np.moveaxis(image, 2, 0), strict=False):
        low = (mask & -mask).bit_length() - 1
        most = mask >> low
        pixels |= ((samples.astype(np.uint64) * most + 127) // 255 << low).astype(np.uint32)
    if len(masks) > 3:
        pixels |= np.uint32(masks[3])
    rows = [r.astype(f"<u{bits // 8}").tobytes() for r in pixels]
    rows = [r + b"\0" * (-len(r) % 4) for r in rows]
    table = struct.pack(f"<{len(masks)}I", *masks) if packing else b""
    fields = struct.pack("<IiiHHIIiiII", head, w, h, 1, bits, packing, 0, 0, 0, 0, 0)
    fields += (table + b"\0" * (head - 40))[: max(head - 40, len(table))]
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 14 + len(fields)) + fields + b"".join(rows[::-1])


def test_bmp_masks():
    rgb = RNG.integers(0, 256, (5, 3, 3), dtype=np.uint8)
    rgb[0, 0] = 10, 20, 30
    assert mc.decode(packed(rgb, (0xFF, 0xFF00, 0xFF0000, 0xFF000000), 32))[0, 0].tolist() == [10, 20, 30]
    for masks in ((0xFF, 0xFF00, 0xFF0000, 0xFF000000), (0xFF000000, 0xFF0000, 0xFF00), (0xFF0000, 0xFF00, 0xFF)):
        for head in (40, 56, 108, 124):
            assert np.array_equal(mc.decode(packed(rgb, masks, 32, head)), rgb)
    assert np.array_equal(mc.decode(packed(rgb, (0xFF0000, 0xFF00, 0xFF, 0xFF000000), 32, packing=0)), rgb)
    for masks, packing in (((0xF800, 0x7E0, 0x1F), 3), ((0x7C00, 0x3E0, 0x1F), 0), ((0xF00, 0xF0, 0xF, 0xF000), 3)):
        most = np.array([m >> ((m & -m).bit_length() - 1) for m in masks[:3]])
        coarse = ((rgb.astype(int) * most + 127) // 255 * 255 + most // 2) // most
        assert np.array_equal(mc.decode(packed(rgb, masks, 16, packing=packing)), coarse)
    wide = packed(rgb, (0x3FF00000, 0xFFC00, 0x3FF), 32)
    assert np.abs(mc.decode(wide).astype(int) - rgb).max() <= 1


def test_bmp_core_header():
    palette, index = RNG.integers(0, 256, (16, 3), dtype=np.uint8), RNG.integers(0, 16, (2, 4), dtype=np.uint8)
    table = palette[:, ::-1].tobytes()
    rows = [bytes([r[0] << 4 | r[1], r[2] << 4 | r[3], 0, 0]) for r in index]
    data = b"BM" + struct.pack("<IHHI", 0, 0, 0, 26 + len(table)) + struct.pack("<IHHHH", 12, 4, 2, 1, 4) + table + b"".join(rows[::-1])
    assert np.array_equal(mc.decode(data), palette[index])
    for bad in (b"BM" + bytes(60), bmp(RNG.integers(0, 2, (2, 2, 3), dtype=np.uint8))[:30]):
        with pytest.raises((ValueError, struct.error)):
            mc.decode(bad)
    rle = bytearray(bmp(RNG.integers(0, 4, (3, 4)), 8, palette=RNG.integers(0, 256, (4, 3), dtype=np.uint8)))
    rle[30] = 1
    with pytest.raises(ValueError):
        mc.decode(bytes(rle))


@pytest.mark.parametrize("shape", [(8, 9, 1), (1, 1, 3), (7, 64, 3), (100, 13, 1), (5000, 64, 3)])
def test_area_means(shape):
    image = RNG.integers(0, 256, shape, dtype=np.uint8)
    y, x = np.linspace(0, shape[0], 9), np.linspace(0, shape[1], 10)
    cover = lambda n, lo, hi: np.clip(np.minimum(np.arange(n) + 1, hi) - np.maximum(np.arange(n), lo), 0, None)
    grey = image.astype(float).mean(axis=2)
    want = [[cover(shape[0], y[r], y[r + 1]) @ grey @ cover(shape[1], x[c], x[c + 1]) / ((y[r + 1] - y[r]) * (x[c + 1] - x[c])) for c in range(9)] for r in range(8)]
    assert np.allclose(mc.area_resize(image), want)


def test_columns_and_errors(spark):
    image = b"P5 18 16 255\n" + bytes(range(18)) * 16
    rows = [(1, image), (2, image), (3, b"GIF89a"), (4, None), (5, b""), (6, b"P6 9 9 255\nshort"), (7, b"BM"), (8, b"P5 -1 2 255\n"), (None, image)]
    df = spark.createDataFrame([(i, bytearray(m) if m is not None else None, "x", 1) for i, m in rows], "id long, media binary, error string, width int")
    got = {r["id"]: r for r in mc.media_tiles(df).collect()}
    assert got[1]["dhash"] == got[2]["dhash"] == "ff" * 8 and (got[1]["width"], got[1]["height"], got[1]["channels"]) == (18, 16, 1)
    assert np.load(io.BytesIO(got[1]["tile"])).shape == (8, 9)
    assert all(got[k]["error"] and got[k]["tile"] is None for k in (3, 4, 5, 6, 7, 8)) and got[None]["error"] is None
    assert mc.media_tiles(df.limit(0)).collect() == []


def test_texts_come_back(edge_docs, edge_rows, no_docs):
    rows = mc.store_texts(edge_docs).mapInArrow(mc._read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string").collect()
    want = []
    for doc, text, *_ in edge_rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((str(doc), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == sorted(want)
    same = {(r["media_sha256"], r["feature"], r["media_bytes"]) for r in rows if r["doc_id"] in (7, 8)}
    assert len(same) == 1
    assert mc.store_texts(no_docs).collect() == []
