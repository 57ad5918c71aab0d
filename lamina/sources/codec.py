"""Bit-level decoders of one stream each, on bytes. Everything after the bits is numpy."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np


def short_table(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(code size, left-aligned code byte) pairs to 256 answers (bits used, value); value -1 where no code goes on.

    The value of a code is its place in the list. Sizes of 0 and over 8 are no codes.
    """
    codes = {(n, c >> (8 - n)): i for i, (n, c) in enumerate(pairs) if 0 < n <= 8}
    prefixes = {(k, c >> (n - k)) for n, c in codes for k in range(n + 1)}
    out = []
    for byte in range(256):
        for n in range(0, 9):
            at = (n, byte >> (8 - n))
            if at in codes and n:
                out.append((n, codes[at]))
                break
            if at not in prefixes:
                out.append((n, -1))
                break
        else:
            out.append((8, -1))
    return out


#: Files of a camera share their tables.
_short_table = lru_cache(64)(short_table)


def category_diffs(data: bytes, pairs: list[tuple[int, int]], n: int) -> np.ndarray:
    """``n`` differences: a code gives the number of bits, the bits the value; a leading 0 bit means negative.

    Bits past the end are 0; where no code goes on the difference is 0.
    """
    table = _short_table(tuple(pairs))
    out = np.zeros(n, np.int64)
    acc = have = pos = 0
    size = len(data)
    for i in range(n):
        while have < 8:
            acc = (acc << 8) | (data[pos] if pos < size else 0)
            pos += 1
            have += 8
        used, bits = table[(acc >> (have - 8)) & 255]
        have -= used
        acc &= (1 << have) - 1
        if bits > 0:
            while have < bits:
                acc = (acc << 8) | (data[pos] if pos < size else 0)
                pos += 1
                have += 8
            have -= bits
            v = acc >> have
            acc &= (1 << have) - 1
            out[i] = v if v >> (bits - 1) else v - (1 << bits) + 1
    return out


@lru_cache(16)
def mapped_codes(words: tuple[int, ...], mapping: tuple[int, ...] | None) -> tuple[dict[tuple[int, int], int], set[tuple[int, int]], int]:
    """The value of each (length, code), their beginnings, and the greatest length."""
    codes = {(w >> 27 & 31, w & 0x07FFFFFF): (mapping[i] if mapping and len(mapping) == len(words) else i) for i, w in enumerate(words) if w}
    return codes, {(k, c >> (length - k)) for length, c in codes for k in range(length + 1)}, max((length for length, _ in codes), default=0)


def mapped_diffs(data: bytes, words: list[int], mapping: list[int] | None, n: int) -> np.ndarray:
    """``n`` differences by codes alone: the top five bits of a word are the length, the rest the code."""
    codes, prefixes, most = mapped_codes(tuple(words), None if mapping is None else tuple(mapping))
    bits = np.unpackbits(np.frombuffer(data[: -(-n * most // 8)], np.uint8)).tolist()  # no more can be read
    out, at = np.zeros(n, np.int64), 0
    for i in range(n):
        length = code = 0
        while (length, code) not in codes and (length, code) in prefixes:
            code = code << 1 | (bits[at] if at < len(bits) else 0)
            at += 1
            length += 1
        v = codes.get((length, code), 0)
        out[i] = v - 65536 if v > 32767 else v
    return out


def rebuild_phases(diffs: np.ndarray, rows: int, columns: int, seed: int, clamp: bool = True) -> np.ndarray:
    """2x2-phase prediction undone: two running sums down the first two columns, two along each row."""
    v = diffs.reshape(rows, columns).astype(np.int64)
    for parity in (0, 1):
        v[parity::2, :2] = seed + np.cumsum(v[parity::2, :2], axis=0)
    for phase in (0, 1):
        v[:, phase::2] = np.cumsum(v[:, phase::2], axis=1)
    return np.maximum(v, 0) & 0xFFFF if clamp else v


def rebuild_rows(diffs: np.ndarray, columns: int, offset: int = 0) -> np.ndarray:
    """Rows of three interleaved colours: a running sum for each, held in 16 signed bits, negatives shown as 0."""
    v = diffs.reshape(-1, columns, 3)
    total = (np.cumsum(v, axis=1) + offset + 32768) % 65536 - 32768
    return np.maximum(total, 0)


def true_plane(data: bytes, rows: int, columns: int, pairs: list[tuple[int, int]], seed: int) -> np.ndarray:
    return rebuild_phases(category_diffs(data, pairs, rows * columns), rows, columns, seed)


def legacy_image(data: bytes, offsets: list[int], columns: int, words: list[int], mapping: list[int] | None, auto_offset: bool = True) -> np.ndarray:
    """(rows, columns, 3). With ``auto_offset``, an image with negative values is moved up to start at 0."""
    whole = memoryview(data)
    diffs = np.stack([mapped_diffs(whole[o:], words, mapping, columns * 3) for o in offsets])
    raw = (np.cumsum(diffs.reshape(len(offsets), columns, 3), axis=1) + 32768) % 65536 - 32768
    low = int(raw.min()) if raw.size else 0
    return rebuild_rows(diffs, columns, -low if auto_offset and low < 0 else 0).reshape(len(offsets), columns, 3)


def packed_rows(words: np.ndarray, columns: int, bits: int, mapping: list[int]) -> np.ndarray:
    """Uncompressed rows: each 32-bit word holds three mapped differences, lowest first; running sums along rows."""
    w = words.reshape(-1, columns).astype(np.int64)
    table = np.array(mapping, np.int64)
    fields = np.stack([table[(w >> (c * bits)) & ((1 << bits) - 1)] for c in range(3)], axis=2)
    return np.maximum((np.cumsum(fields, axis=1) + 32768) % 65536 - 32768, 0)


def pack12(values: np.ndarray, size: int) -> bytes:
    """12-bit values, two in three bytes, cut to ``size`` bytes and filled with zeros."""
    v = np.append(values, np.zeros(len(values) % 2, np.int64)).reshape(-1, 2) & 4095
    out = np.stack([v[:, 0] >> 4, (v[:, 0] << 4 & 0xF0) | v[:, 1] >> 8, v[:, 1] & 0xFF], axis=1).astype(np.uint8).tobytes()
    return out[:size].ljust(size, b"\0")


def _pairs(data: bytes) -> list[tuple[int, int]]:
    out, at = [], 0
    while at + 1 < len(data) and data[at]:
        out.append((data[at], data[at + 1]))
        at += 2
    return out


def metadata_bytes(section: bytes) -> bytes:
    """The decoded bytes of a metadata section: kinds 2 (hidden by a key stream), 4 and 5 (coded differences)."""
    from lamina.operators.sequences import key_stream

    kind, size, bias, block, blocks = struct.unpack_from("<5I", section, 8)
    body = section[28:]
    if kind == 2:
        return (np.frombuffer(body, np.uint8) ^ np.array(key_stream(blocks, len(body)), np.uint8)).tobytes()
    if kind == 4:
        need = min(block * blocks, -(-size * 2 // 3))
        rows = -(-need // block) if block else 0
        return pack12(rebuild_phases(category_diffs(body[32:], _pairs(body), rows * block), rows, block, bias, False).ravel()[:need], size)
    if kind == 5:
        seed = bias - (1 << 32) if bias >> 31 else bias
        return ((seed + np.cumsum(category_diffs(body[32:], _pairs(body), size))) & 255).astype(np.uint8).tobytes()
    raise ValueError(f"unknown metadata kind {kind}")
