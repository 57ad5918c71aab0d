"""Writes containers: every codec that the source reads, from rasters and metadata given in memory."""

import struct

import numpy as np

#: Category codes for 0 to 12 bits: (code size, left-aligned code byte).
PAIRS = [(3, 0b000 << 5), (3, 0b001 << 5), (3, 0b010 << 5), (3, 0b011 << 5), (3, 0b100 << 5), (4, 0b1010 << 4), (4, 0b1011 << 4), (4, 0b1100 << 4), (5, 0b11010 << 3), (5, 0b11011 << 3), (6, 0b111000 << 2), (6, 0b111001 << 2), (7, 0b1110100 << 1), (7, 0b1110101 << 1)]


class Bits:
    def __init__(self):
        self.text = []

    def put(self, value, n):
        if n:
            self.text.append(format(value, f"0{n}b"))

    def bytes(self):
        s = "".join(self.text)
        s += "0" * (-len(s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big") if s else b""


def code_diffs(diffs):
    out = Bits()
    for d in diffs:
        n = abs(int(d)).bit_length()
        size, code = PAIRS[n]
        out.put(code >> (8 - size), size)
        out.put(int(d) if d > 0 else int(d) + (1 << n) - 1, n)
    return out.bytes()


def plane_diffs(v, seed):
    rows, columns = v.shape
    out, start = [], {(a, b): seed for a in (0, 1) for b in (0, 1)}
    for y in range(rows):
        last = {}
        for x in range(columns):
            before = start[y & 1, x & 1] if x < 2 else last[x & 1]
            out.append(int(v[y, x]) - before)
            last[x & 1] = int(v[y, x])
            if x < 2:
                start[y & 1, x & 1] = int(v[y, x])
    return out


def table_bytes():
    return b"".join(bytes(p) for p in PAIRS) + b"\0\0"


def true_section(planes, seeds=(500, 600, 700), kind=1, fmt=0x1E, image=None):
    rows, columns = image or planes[0].shape
    body = b""
    if fmt in (0x23, 0x25, 0x27):
        body += b"".join(struct.pack("<2H", p.shape[1], p.shape[0]) for p in planes)
    body += struct.pack("<4H", *seeds, 0) + table_bytes()
    body += b"\0" * 4 if fmt in (0x23, 0x25, 0x27) else b""
    coded = [code_diffs(plane_diffs(p, s)) for p, s in zip(planes, seeds, strict=True)]
    body += struct.pack("<3I", *map(len, coded))
    body += b"".join(c.ljust(-(-len(c) // 16) * 16, b"\0") for c in coded)
    return b"SECi" + struct.pack("<6I", 0x20000, kind, fmt, columns, rows, 0) + body


def legacy_section(image, fmt=6):
    """Rows of 3 colours; 1024 mapped differences with fixed ten-bit codes."""
    rows, columns = image.shape[:2]
    mapping = [i - 512 for i in range(1024)]
    words = [(10 << 27) | i for i in range(1024)]
    data, offsets = b"", []
    for y in range(rows):
        offsets.append(len(data))
        bits, last = Bits(), [0, 0, 0]
        for x in range(columns):
            for c in range(3):
                bits.put(int(image[y, x, c]) - last[c] + 512, 10)
                last[c] = int(image[y, x, c])
        data += bits.bytes()
    body = struct.pack("<1024h", *mapping) + struct.pack("<1024I", *words) + data + struct.pack(f"<{rows}I", *offsets)
    return b"SECi" + struct.pack("<6I", 0x20000, 3, fmt, columns, rows, 0) + body


def packed_section(image):
    rows, columns = image.shape[:2]
    mapping = [i - 512 for i in range(1024)]
    words = []
    for y in range(rows):
        last = [0, 0, 0]
        for x in range(columns):
            w = 0
            for c in range(3):
                w |= (int(image[y, x, c]) - last[c] + 512) << (10 * c)
                last[c] = int(image[y, x, c])
            words.append(w)
    body = struct.pack("<1024h", *mapping) + struct.pack(f"<{len(words)}I", *words)
    return b"SECi" + struct.pack("<6I", 0x20000, 3, 6, columns, rows, columns * 4) + body


def property_section(items):
    pool, table = b"", b""
    for n, v in items:
        for s in (n, v):
            table += struct.pack("<I", len(pool) // 2)
            pool += s.encode("utf-16-le") + b"\0\0"
    return b"SECp" + struct.pack("<I", 0x20000) + struct.pack("<4I", len(items), 0, 0, len(pool) // 2) + table + pool


def entry(tag, name, value):
    name = name.encode() + b"\0"
    at = 20 + len(name)
    return tag + struct.pack("<4I", 1, at + len(value(at)), 20, at) + name + value(at)


def text_entry(name, text):
    return entry(b"CMbT", name, lambda at: struct.pack("<I", len(text) + 1) + text.encode() + b"\0")


def list_entry(name, items):
    def value(at):
        pool, table = b"", b""
        for n, v in items:
            table += struct.pack("<I", len(pool))
            pool += n.encode() + b"\0"
            table += struct.pack("<I", len(pool))
            pool += v.encode() + b"\0"
        return struct.pack("<II", len(items), at + 8 + len(table)) + table + pool

    return entry(b"CMbP", name, value)


def matrix_entry(name, code, sizes, values, kind):
    def value(at):
        start = at + 12 + 12 * len(sizes)
        dims = b"".join(struct.pack("<3I", s, 0, i) for i, s in enumerate(sizes))
        return struct.pack("<3I", code, len(sizes), start) + dims + np.array(values, kind).tobytes()

    return entry(b"CMbM", name, value)


def metadata_section(plain, kind=2, key=777):
    from lamina.operators.sequences import key_stream

    if kind == 2:
        body = bytes(a ^ b for a, b in zip(plain, key_stream(key, len(plain)), strict=True))
        return b"SECc" + struct.pack("<6I", 0x20000, 2, 0, 0, 0, key) + body
    table = table_bytes().ljust(28, b"\0")
    assert len(table) <= 30
    if kind == 5:
        diffs, last = [], 7
        for b in plain:
            diffs.append(b - last)
            last = b
        coded = code_diffs(diffs)
        return b"SECc" + struct.pack("<6I", 0x20000, 5, len(plain), 7, 0, 0) + table_bytes().ljust(32, b"\0")[:32] + coded
    values = []
    data = plain + b"\0" * (-len(plain) % 3)
    for i in range(0, len(data), 3):
        values += [data[i] << 4 | data[i + 1] >> 4, (data[i + 1] & 15) << 8 | data[i + 2]]
    block = 32
    values += [0] * (-len(values) % block)
    v = np.array(values).reshape(-1, block)
    coded = code_diffs(plane_diffs(v, 100))
    return b"SECc" + struct.pack("<6I", 0x20000, 4, len(plain), 100, block, len(v)) + table_bytes().ljust(32, b"\0")[:32] + coded


def container(sections, version=(2 << 16) | 3, size=(64, 48), wb="Sunlight"):
    head = b"FOVb" + struct.pack("<I", version) + bytes(range(16))
    if version < 4 << 16:
        n = 64 if version >= 3 << 16 else 32
        head += struct.pack("<4I", 0, size[0], size[1], 90)
        if version > 2 << 16:
            head += wb.encode().ljust(32, b"\0") + (b"Std".ljust(32, b"\0") if version >= (2 << 16) | 3 else b"") + bytes(n) + struct.pack(f"<{n}f", *range(n))
    out = head.ljust(616, b"\0")
    rows = []
    for kind, data in sections:
        rows.append(struct.pack("<II4s", len(out), len(data), kind))
        out += data
    at = len(out)
    return out + b"SECd" + struct.pack("<II", 0x20000, len(rows)) + b"".join(rows) + struct.pack("<I", at)
