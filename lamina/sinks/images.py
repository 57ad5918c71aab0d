"""Image encoders (TIFF, JPEG, linear DNG) and a sink that writes one file for each image."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lamina.functions import matrix as mx
from lamina.session import ship
from lamina.sinks.tags import Directory

STRIP_ROWS = 32


def _rationals(values, most: int = 1_000_000) -> list[tuple[int, int]]:
    return [mx.rational(float(v), most) for v in values]


def tiff16(image: np.ndarray, make: str = "", model: str = "", exif: dict | None = None) -> bytes:
    """16-bit RGB, one strip for each STRIP_ROWS rows, with an EXIF directory if there is exposure data."""
    rows, columns = image.shape[:2]
    strips = [image[a : a + STRIP_ROWS].astype("<u2").tobytes() for a in range(0, rows, STRIP_ROWS)]
    main = Directory().add(256, 4, [columns]).add(257, 4, [rows]).add(258, 3, [16] * 3).add(259, 3, [1]).add(262, 3, [2]).add(277, 3, [3]).add(278, 4, [STRIP_ROWS]).add(284, 3, [1]).add(271, 2, make).add(272, 2, model)
    main.add(279, 4, [len(s) for s in strips]).add(273, 4, [0] * len(strips))
    extra = Directory()
    if exif and exif.get("exposure"):
        extra.add(33434, 5, _rationals([exif["exposure"]]))
    if exif and exif.get("aperture"):
        extra.add(33437, 5, _rationals([exif["aperture"]]))
    if exif and exif.get("iso"):
        extra.add(34855, 3, [int(exif["iso"]) & 0xFFFF])
    if extra.entries:
        main.add(34665, 4, [0])
    at = 8 + main.size()
    if extra.entries:
        main.add(34665, 4, [at])
    data_at = at + (extra.size() if extra.entries else 0)
    main.add(273, 4, [data_at + sum(len(s) for s in strips[:i]) for i in range(len(strips))])
    return b"II*\0" + struct.pack("<I", 8) + main.pack(8) + (extra.pack(at) if extra.entries else b"") + b"".join(strips)


_LUMA = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
_CHROMA = [17, 18, 24, 47] + [99] * 4 + [18, 21, 26, 66] + [99] * 4 + [24, 26, 56] + [99] * 5 + [47, 66] + [99] * 38
_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_DC_BITS, _DC_VALUES = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))


def _ac_table() -> tuple[list[int], list[int]]:
    """A valid code for all (run, size) symbols: short codes for small ones; the file carries the table."""
    symbols = sorted([(r << 4) | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0], key=lambda v: (0 if v == 0 else (v >> 4) + 2 * (v & 15), v))
    bits = [0, 1, 2, 2, 3, 4, 5, 6, 8, 10, 12, 15, 18, 22, 26, 0]
    bits[15] = len(symbols) - sum(bits[:15])
    return bits, symbols


def _codes(bits: list[int], values: list[int]) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[values[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _table(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, (c, n) in codes.items():
        code[symbol], length[symbol] = c, n
    return code, length


def _sizes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each number's magnitude, and the number in that many bits, negatives in ones' complement."""
    n = np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    return n, np.where(v > 0, v, v + (1 << n) - 1)


def _scan(blocks: np.ndarray, dc: dict, ac: dict, step: int = 1 << 14) -> bytes:
    """Coded bytes of blocks (number, channel, 64 in zigzag order), a stretch of blocks at a time."""
    (dc_code, dc_len), (ac_code, ac_len) = _table(dc), _table(ac)
    first = np.diff(blocks[:, :, 0], axis=0, prepend=0)
    out, left = [], np.zeros(0, np.uint8)
    for at in range(0, len(blocks), step):
        flat = blocks[at : at + step].reshape(-1, 64)
        # a token is a code and its number; its place is block * 256 + 4 * position, zero runs come just before
        size, bits = _sizes(first[at : at + step].ravel())
        tokens = [(np.arange(len(flat)) * 256, dc_code[size] << size | bits, dc_len[size] + size)]
        row, pos = np.nonzero(flat[:, 1:])
        pos += 1
        before = np.where(np.append(True, row[1:] != row[:-1]), 0, np.append(0, pos[:-1])) if len(row) else pos
        run = pos - before - 1
        size, bits = _sizes(flat[row, pos])
        symbol = (run % 16) << 4 | size
        tokens.append((row * 256 + pos * 4, ac_code[symbol] << size | bits, ac_len[symbol] + size))
        many = run // 16
        zeros = np.repeat(row * 256 + pos * 4 - 1, many)
        tokens.append((zeros, np.full(len(zeros), ac_code[0xF0]), np.full(len(zeros), ac_len[0xF0])))
        end = np.zeros(len(flat), np.int64)
        np.maximum.at(end, row, pos)
        short = np.nonzero(end < 63)[0]
        tokens.append((short * 256 + 255, np.full(len(short), ac_code[0]), np.full(len(short), ac_len[0])))
        place, value, length = (np.concatenate([t[i] for t in tokens]) for i in range(3))
        order = np.argsort(place, kind="stable")
        value, length = value[order], length[order]
        token = np.repeat(np.arange(len(length)), length)
        within = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
        new = np.append(left, ((value[token] >> (length[token] - 1 - within)) & 1).astype(np.uint8))
        whole = len(new) // 8 * 8
        out.append(np.packbits(new[:whole]).tobytes())
        left = new[whole:]
    if len(left):
        out.append(np.packbits(np.append(left, np.ones(8 - len(left), np.uint8))).tobytes())
    return b"".join(out).replace(b"\xff", b"\xff\0")


def jpeg(image: np.ndarray, quality: int = 98) -> bytes:
    """Baseline JPEG of an 8-bit RGB image, no chroma subsampling."""
    if not 1 <= quality <= 100:
        raise ValueError("quality is 1 to 100")
    rows, columns = image.shape[:2]
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (_LUMA, _CHROMA)]
    r, g, b = (np.pad(image[:, :, i].astype(float), ((0, -rows % 8), (0, -columns % 8)), mode="edge") for i in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    blocks = []
    for i, p in enumerate(planes):
        tiles = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        freq = (basis @ tiles @ basis.T).reshape(-1, 64)
        blocks.append(np.rint(freq / tables[min(i, 1)]).astype(int)[:, _ZIGZAG])
    ac_bits, ac_values = _ac_table()
    dc, ac = _codes(_DC_BITS, _DC_VALUES), _codes(ac_bits, ac_values)
    scan = _scan(np.stack(blocks, axis=1), dc, ac)
    seg = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for i, t in enumerate(tables):
        out += seg(0xDB, bytes([i]) + bytes(t[_ZIGZAG].tolist()))
    out += seg(0xC0, struct.pack(">BHHB", 8, rows, columns, 3) + b"\1\x11\0\2\x11\1\3\x11\1")
    out += seg(0xC4, bytes([0x00, *_DC_BITS, *_DC_VALUES])) + seg(0xC4, bytes([0x10, *ac_bits, *ac_values]))
    return out + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"


#: Name and greyscale mix (None: the camera's own colour) of the embedded profiles.
PROFILES = [("Default", None), ("Grayscale", (1 / 3, 1 / 3, 1 / 3)), ("Grayscale (red filter)", (2.0, -1.0, 0.0)), ("Grayscale (blue filter)", (0.0, -1.0, 2.0)), ("Linear sRGB", "srgb"), ("Unconverted", "identity")]


def profile_matrix(mix, layers: list[float]) -> list[float]:
    if mix is None:
        return mx.forward_camera(layers)
    if mix == "srgb":
        return mx.forward_srgb()
    if mix == "identity":
        return mx.multiply(mx.diagonal(mx.D50_WHITE), mx.IDENTITY)
    return mx.forward_greyscale(list(mix))


def _signed(m: list[float]) -> list[tuple[int, int]]:
    return _rationals(m, 10_000)


def profile_directory(name: str, forward: list[float]) -> bytes:
    """A camera profile as a big-endian directory of its own."""
    d = Directory(">").add(50721, 10, _signed(mx.XYZ_TO_SRGB)).add(50778, 3, [21]).add(50936, 2, name).add(50964, 10, _signed(forward)).add(50941, 4, [3])
    return b"MMCR" + struct.pack(">I", 8) + d.pack(8)


def gain_opcodes(maps: list[np.ndarray], area: tuple[int, int, int, int], rows: int, columns: int) -> bytes:
    """Gain maps (rows x columns of 32-bit gains, one a plane) as a big-endian opcode list; ``area`` is top, left, bottom, right."""
    top, left, bottom, right = area
    h, w = bottom - top, right - left
    out = struct.pack(">I", len(maps))
    for plane, g in enumerate(maps):
        n, m = g.shape
        out += struct.pack(">4I", 9, 0x01030000, 0, 76 + 4 * g.size) + struct.pack(">4I", 0, 0, h, w) + struct.pack(">4I", plane, 1, 1, 1) + struct.pack(">2I", n, m)
        out += struct.pack(">4d", rows / h / (n - 1), columns / w / (m - 1), -top / h, -left / w) + struct.pack(">I", 1) + g.astype(">f4").tobytes()
    return out


def dng(image: np.ndarray, preview: np.ndarray, layers: list[float], gain: list[float], model: str = "", black: float = 0.0, white: tuple[int, int, int] = (65535,) * 3, maps: list[np.ndarray] | None = None, baseline: float = 0.0, area: tuple[int, int, int, int] | None = None, exif: dict | None = None) -> bytes:
    """Linear DNG: directory 0 with an 8-bit preview, a sub-directory with the 16-bit raster, and profiles.

    ``area`` is the sensor's active area (top, left, bottom, right), to which gain maps relate. Exposure data goes to directory 0.
    """
    rows, columns = image.shape[:2]
    strips = [image[a : a + STRIP_ROWS].astype("<u2").tobytes() for a in range(0, rows, STRIP_ROWS)]
    shown = preview.astype(np.uint8).tobytes()
    profiles = [profile_directory(n, profile_matrix(m, layers)) for n, m in PROFILES[1:]]
    main = Directory().add(254, 4, [1]).add(256, 4, [preview.shape[1]]).add(257, 4, [preview.shape[0]]).add(258, 3, [8] * 3).add(259, 3, [1]).add(262, 3, [2]).add(277, 3, [3]).add(278, 4, [preview.shape[0]]).add(279, 4, [len(shown)]).add(284, 3, [1])
    main.add(272, 2, model).add(50706, 1, bytes([1, 4, 0, 0])).add(50707, 1, bytes([1, 4, 0, 0])).add(50708, 2, model or "layered")
    main.add(50721, 10, _signed(mx.XYZ_TO_SRGB)).add(50723, 10, _signed(mx.calibration(gain))).add(50964, 10, _signed(mx.forward_camera(layers))).add(50778, 3, [21]).add(50728, 5, _rationals(mx.invert_components(gain)))
    main.add(50730, 10, _rationals([baseline])).add(50936, 2, PROFILES[0][0]).add(273, 4, [0]).add(330, 4, [0]).add(50933, 4, [0] * len(profiles))
    for tag, kind, key in ((33434, 5, "exposure"), (33437, 5, "aperture"), (34855, 3, "iso")):
        if exif and exif.get(key):
            main.add(tag, kind, [int(exif[key]) & 0xFFFF] if kind == 3 else _rationals([exif[key]]))
    sub = Directory().add(254, 4, [0]).add(256, 4, [columns]).add(257, 4, [rows]).add(258, 3, [16] * 3).add(259, 3, [1]).add(262, 3, [34892]).add(277, 3, [3]).add(278, 4, [STRIP_ROWS]).add(284, 3, [1])
    sub.add(279, 4, [len(s) for s in strips]).add(273, 4, [0] * len(strips)).add(50714, 5, [(round(black * 65536), 65536)] * 3).add(50717, 4, list(white)).add(50829, 4, [0, 0, rows, columns])
    if maps:
        sub.add(51009, 7, gain_opcodes(maps, area or (0, 0, rows, columns), rows, columns))
    at = 8 + main.size()
    main.add(273, 4, [at])
    at += len(shown) + len(shown) % 2
    places = []
    for p in profiles:
        places.append(at)
        at += len(p) + len(p) % 2
    main.add(50933, 4, places).add(330, 4, [at])
    data_at = at + sub.size()
    sub.add(273, 4, [data_at + sum(len(s) for s in strips[:i]) for i in range(len(strips))])
    even = lambda x: x + b"\0" * (len(x) % 2)
    return b"II*\0" + struct.pack("<I", 8) + main.pack(8) + even(shown) + b"".join(map(even, profiles)) + sub.pack(at) + b"".join(strips)


def block_preview(image: np.ndarray, most: int = 300) -> np.ndarray:
    """8-bit preview of a 16-bit image: block means, colour matrix, sRGB curve, a clip that keeps the channels' proportions."""
    k = max(1, -(-image.shape[1] // most))
    h, w = image.shape[0] // k, image.shape[1] // k
    mean = image[: h * k, : w * k].reshape(h, k, w, k, 3).mean(axis=(1, 3))
    unit = np.clip(mean / 65535.0, 0, 1) @ np.reshape(mx.XYZ_TO_SRGB, (3, 3)).T
    curve = np.where(unit <= 0.0031308, 12.92 * unit, 1.055 * np.power(np.maximum(unit, 0.0031308), 1 / 2.4) - 0.055) * 255.0
    peak = curve.max(axis=2, keepdims=True)
    return np.floor(np.maximum(curve * np.where(peak > 255, 255.0 / np.maximum(peak, 1), 1.0), 0) + 0.5).astype(np.uint8)


def write_dng(pixels: DataFrame, facts: DataFrame, folder: str, values: tuple[str, str, str] = ("r", "g", "b"), group: str = "image_id") -> DataFrame:
    """One linear DNG for each image; returns (image, file, bytes).

    ``facts`` has one row for each image: name, layers, gain, model, area (top, left, bottom, right or null), exposure, aperture, iso and
    maps, an array of (rows, columns, gains) by channel. They meet the pixels in one group, so no pixel carries them.
    """
    ship(pixels.sparkSession)

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        if pdf.empty or own.empty:
            return pd.DataFrame({group: [], "file": [], "bytes": []})
        f = own.iloc[0]
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        image = np.zeros((h, w, 3), np.int64)
        image[pdf["y"], pdf["x"]] = pdf[list(values)].to_numpy()
        maps = [np.array(m["gains"], np.float32).reshape(m["rows"], m["columns"]) for m in (f["maps"] if f["maps"] is not None else [])]
        maps = [m for m in maps if min(m.shape) > 1]
        # gain maps relate to the active area; without one they are left out
        area = None if f["area"] is None else tuple(int(v) for v in f["area"])
        data = dng(image, block_preview(image), [float(v) for v in f["layers"]], [float(v) for v in f["gain"]], f["model"] or "", maps=maps if area else None, area=area, exif=_exif(f))
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        with store.open_output_stream(f"{base}/{f['name']}.dng") as out:
            out.write(data)
        return pd.DataFrame({group: [f[group]], "file": [f"{f['name']}.dng"], "bytes": [len(data)]})

    kind = pixels.schema[group].dataType.simpleString()
    return pixels.groupBy(group).cogroup(facts.groupBy(group)).applyInPandas(run, f"{group} {kind}, file string, bytes long")


def _exif(row: pd.Series) -> dict:
    return {k: float(row[k]) for k in ("exposure", "aperture", "iso") if k in row and pd.notna(row[k])}


def write_images(pixels: DataFrame, folder: str, kind: str, values: tuple[str, str, str] = ("r", "g", "b"), group: str = "image_id", quality: int = 98, facts: DataFrame | None = None) -> DataFrame:
    """Write one file for each image below ``folder`` (a URI that every executor reaches); returns (image, file, bytes).

    ``kind`` is tiff, jpeg or ppm. An image is one group: its size is bounded by the sensor. ``facts``, if given, has one row for each
    image: name (the file's, else the image's own), and for TIFF make, model, exposure, aperture and iso.
    """
    ship(pixels.sparkSession)
    if kind not in ("tiff", "jpeg", "ppm"):
        raise ValueError(f"unknown kind {kind}")

    def write(pdf: pd.DataFrame, own: pd.Series) -> pd.DataFrame:
        from pyarrow import fs

        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        image = np.zeros((h, w, 3), np.int64)
        image[pdf["y"], pdf["x"]] = pdf[list(values)].to_numpy()
        if kind == "tiff":
            data = tiff16(image, own.get("make") or "", own.get("model") or "", _exif(own))
        elif kind == "jpeg":
            data = jpeg(image, quality)
        else:
            data = (f"P3\n{w} {h}\n65535\n" + "".join("%d %d %d \n" % tuple(p) for p in image.reshape(-1, 3).tolist())).encode()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        file = f"{own.get('name') or pdf[group].iloc[0]}.{kind}"
        with store.open_output_stream(f"{base}/{file}") as out:
            out.write(data)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "file": [file], "bytes": [len(data)]})

    schema = f"{group} {pixels.schema[group].dataType.simpleString()}, file string, bytes long"
    if facts is None:
        return pixels.groupBy(group).applyInPandas(lambda pdf: write(pdf, pd.Series(dtype=object)), schema)
    none = pd.DataFrame({group: [], "file": [], "bytes": []})
    return pixels.groupBy(group).cogroup(facts.groupBy(group)).applyInPandas(lambda pdf, own: none if pdf.empty else write(pdf, own.iloc[0] if len(own) else pd.Series(dtype=object)), schema)
