"""The binary container as DataFrames: header, sections, properties, metadata entries, planes and pixels.

Files come from Spark's own ``binaryFile`` reader, so any store that Spark reads will do; a file that is damaged
gives no rows in the views that need the damaged part. The data source ``layered_raw`` reads by range where ``pyarrow.fs`` reaches
the store: a header or a directory costs a few hundred bytes of a file, however large.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamina.session import ship
from lamina.sources import codec
from lamina.sources.batches import arrow_schema, batches, tuples

MAGIC, DIRECTORY = b"FOVb", b"SECd"
PROPERTIES, IMAGES, METADATA = (b"SECp", b"PROP"), (b"SECi", b"IMA2", b"IMAG"), (b"SECc", b"CAMF")
VERSION_21, VERSION_23, VERSION_30, VERSION_40 = (2 << 16) | 1, (2 << 16) | 3, 3 << 16, 4 << 16
HEADER_BYTES = 616
#: Combined (type << 16) + format of the raster codecs; thumbnails have type 2.
LEGACY, TRUE, QUATTRO = {0x00030005, 0x00030006}, {0x0003001E, 0x0001001E}, {0x00010023, 0x00010025, 0x00010027}
THUMBNAILS = {3: "plain", 0x0B: "huffman", 0x12: "jpeg", 0x19: "sdq"}

HEADER_SCHEMA = "path string, identifier string, version long, unique_id binary, mark_bits long, columns long, rows long, rotation long, white_balance string, color_mode string, ext_types array<int>, ext_data array<float>"
SECTION_SCHEMA = "path string, idx int, offset long, length long, type string"
PROPERTY_SCHEMA = "path string, idx int, name string, value string"
ENTRY_SCHEMA = "path string, idx int, kind string, name string, text string, props array<struct<name:string,value:string>>, matrix_type int, dims array<struct<size:int,name:string,n:int>>, f64 array<double>, i64 array<bigint>"
PLANE_SCHEMA = "path string, idx int, layout string, image_rows int, image_columns int, plane int, rows int, columns int, seed int, table array<struct<size:int,code:int>>, data binary"
STRIP_SCHEMA = "path string, idx int, layout string, plane int, y int, v array<int>"
THUMB_SCHEMA = "path string, idx int, kind string, columns int, rows int, data binary"


def header(data: bytes) -> dict:
    """The fixed header; which fields there are depends on the version."""
    if data[:4] != MAGIC:
        raise ValueError("not a layered raw container")
    version = struct.unpack_from("<I", data, 4)[0]
    out = dict.fromkeys(("mark_bits", "columns", "rows", "rotation", "white_balance", "color_mode", "ext_types", "ext_data"))
    out |= {"identifier": "FOVb", "version": version, "unique_id": data[8:24]}
    if version < VERSION_40:
        out |= dict(zip(("mark_bits", "columns", "rows", "rotation"), struct.unpack_from("<4I", data, 24), strict=True))
        at = 40
        if version >= VERSION_21:
            text = lambda b: b.split(b"\0")[0].decode("latin-1")
            out["white_balance"] = text(data[at : at + 32])
            at += 32
            if version >= VERSION_23:
                out["color_mode"] = text(data[at : at + 32])
                at += 32
            n = 64 if version >= VERSION_30 else 32
            out["ext_types"] = list(data[at : at + n])
            out["ext_data"] = list(struct.unpack_from(f"<{n}f", data, at + n))
    return out


def directory(data: bytes) -> list[tuple[int, int, bytes]]:
    """(offset, length, type) of each section; the last four bytes say where the directory is."""
    at = struct.unpack_from("<I", data, len(data) - 4)[0]
    if data[at : at + 4] != DIRECTORY:
        raise ValueError("no section directory")
    n = struct.unpack_from("<I", data, at + 8)[0]
    rows = [struct.unpack_from("<II4s", data, at + 12 + 12 * i) for i in range(n)]
    return [(o, s, t) for o, s, t in rows]


def sections_of(data: bytes, kinds: tuple[bytes, ...]) -> list[tuple[int, bytes]]:
    return [(i, data[o : o + n]) for i, (o, n, t) in enumerate(directory(data)) if t in kinds]


def properties(section: bytes) -> list[tuple[str, str]]:
    """Names and values from the two-byte character pool; one whose place is outside is empty."""
    n = struct.unpack_from("<I", section, 8)[0]
    table = struct.unpack_from(f"<{2 * n}I", section, 24)
    pool = section[24 + 8 * n :]

    def text(at: int) -> str:
        at *= 2
        end = at
        while end + 1 < len(pool) and pool[end : end + 2] != b"\0\0":
            end += 2
        return pool[at:end].decode("utf-16-le", "replace") if at < len(pool) else ""

    return [(text(table[2 * i]), text(table[2 * i + 1])) for i in range(n)]


_ELEMENTS = {0: "<i2", 1: "<u4", 2: "<u4", 3: "<f4", 5: "<u1", 6: "<u2"}


def _text(data: bytes) -> str:
    return data.split(b"\0")[0].decode("latin-1")


def entry(data: bytes) -> tuple[dict, int]:
    """One metadata entry and its size."""
    if len(data) < 20:
        raise ValueError("short entry")
    tag, _, size, name_at, at = struct.unpack_from("<4s4I", data)
    if not 20 <= name_at < len(data) or not size:
        raise ValueError("bad entry")
    out: dict = dict.fromkeys(("text", "props", "matrix_type", "dims", "f64", "i64"))
    out |= {"kind": {b"CMbT": "text", b"CMbP": "props", b"CMbM": "matrix"}.get(tag, "other"), "name": _text(data[name_at : at or size])}
    if at and at < len(data):
        if tag == b"CMbT":
            n = struct.unpack_from("<I", data, at)[0]
            out["text"] = _text(data[at + 4 : at + 4 + n])
        elif tag == b"CMbP":
            n, base = struct.unpack_from("<II", data, at)
            pairs = struct.unpack_from(f"<{2 * n}I", data, at + 8)
            item = lambda o: _text(data[base + o :]) if base + o < len(data) else ""
            out["props"] = [(item(pairs[2 * i]), item(pairs[2 * i + 1])) for i in range(n)]
        elif tag == b"CMbM":
            out |= matrix(data, at, size)
    return out, size


def matrix(data: bytes, at: int, size: int) -> dict:
    code, n, start = struct.unpack_from("<3I", data, at)
    dims, count = [], 1
    for i in range(n):
        length, name_at, order = struct.unpack_from("<3I", data, at + 12 + 12 * i)
        dims.append((length, _text(data[name_at:]) if 0 < name_at < len(data) else "", order))
        count *= length
    out = {"matrix_type": code, "dims": dims}
    if not count:
        return out
    each = (size - start) // count
    kind = _ELEMENTS.get(code) or {8: "<f8", 4: "<u4", 2: "<u2"}.get(each)
    if kind is None:
        return out
    raw = np.zeros(count, kind)
    body = np.frombuffer(data[start : start + count * np.dtype(kind).itemsize], kind) if start + count * each <= len(data) else raw[:0]
    raw[: len(body)] = body
    if raw.dtype.kind == "f":
        out["f64"] = np.where(np.isfinite(raw), raw, 0).astype(float).tolist()
    else:
        out["i64"] = raw.astype(np.int64).tolist()
    return out


def entries(section: bytes) -> list[dict]:
    """All entries up to the first that can't be read."""
    data = codec.metadata_bytes(section)
    out, at = [], 0
    while at < len(data):
        try:
            one, size = entry(data[at:])
        except (ValueError, struct.error):
            break
        out.append(one)
        at += size
    return out


def planes(section: bytes) -> list[dict]:
    """The coded planes of a raster section; none for thumbnails and unknown codecs."""
    if section[:4] != b"SECi":
        raise ValueError("no image section")
    kind, fmt, columns, rows, stride = struct.unpack_from("<5I", section, 8)
    code = (kind << 16) + fmt if fmt < 1 << 16 else fmt
    body = section[28:]
    if kind & 0xFF == 2 or rows > 100_000:
        return []
    base = {"image_rows": rows, "image_columns": columns}
    if code in LEGACY:
        mapping = list(struct.unpack_from("<1024h", body))
        if stride:
            words = np.frombuffer(body[2048:], "<u4")[: rows * columns]
            return [base | {"layout": "packed", "plane": 0, "rows": rows, "columns": columns, "seed": 10, "table": [(v, 0) for v in mapping], "data": words.tobytes()}]
        return [base | {"layout": "legacy", "plane": 0, "rows": rows, "columns": columns, "seed": 0, "table": [], "data": body}]
    if code not in TRUE | QUATTRO and fmt & 0xFF not in (0x1E, 0x23, 0x25, 0x27):
        return []
    quattro = code in QUATTRO or fmt & 0xFF in (0x23, 0x25, 0x27)
    at, sizes, layout = 0, [(columns, rows)] * 3, "true"
    if quattro:
        flat = struct.unpack_from("<6H", body)
        sizes = [(flat[2 * i], flat[2 * i + 1]) for i in range(3)]
        at = 12
        if sizes[0][1] == rows // 2:
            layout = "quattro"
        elif sizes[0][1] == rows:
            layout = "binned"
        else:
            raise ValueError("unknown plane sizes")
    seeds = struct.unpack_from("<3H", body, at)
    at += 8
    table = []
    while True:
        table.append((body[at], body[at + 1]))
        at += 2
        if not table[-1][0]:
            break
    at += 4 if quattro else 0
    lengths = struct.unpack_from("<3I", body, at)
    at += 12
    out = []
    for p in range(3):
        out.append(base | {"layout": layout, "plane": p, "rows": sizes[p][1], "columns": sizes[p][0], "seed": seeds[p], "table": table, "data": body[at : at + lengths[p]]})
        at += -(-lengths[p] // 16) * 16  # planes start at multiples of 16 bytes
    return out


def decode_plane(p: dict) -> list[np.ndarray]:
    """Decoded channel rasters of one coded plane: one, or all three of a legacy image."""
    rows, columns, pairs = p["rows"], p["columns"], [tuple(t) for t in p["table"]]
    if p["layout"] == "packed":
        v = codec.packed_rows(np.frombuffer(p["data"], "<u4"), columns, p["seed"], [t[0] for t in pairs])
        return [v[:, :, c] for c in range(3)]
    if p["layout"] == "legacy":
        body = p["data"]
        mapping, words = list(struct.unpack_from("<1024h", body)), list(struct.unpack_from("<1024I", body, 2048))
        offsets = list(struct.unpack_from(f"<{rows}I", body, len(body) - 4 * rows))
        v = codec.legacy_image(body[6144 : len(body) - 4 * rows], offsets, columns, words, mapping)
        return [v[:, :, c] for c in range(3)]
    v = codec.true_plane(p["data"], rows, columns, pairs, p["seed"])
    return [v[:, : p["image_columns"]] if p["layout"] == "binned" else v]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The files: path and content. Nothing else is read before a view asks for it."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _view(files: DataFrame, schema: str, rows: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    ship(files.sparkSession)
    kinds = arrow_schema(schema)

    def all_rows(given: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, content in tuples(given):
            try:
                found = list(rows(path, bytes(content)))
            except (ValueError, struct.error, IndexError):
                continue
            yield from found

    return files.select("path", "content").mapInArrow(lambda given: batches(all_rows(given), kinds), schema)


def headers(files: DataFrame) -> DataFrame:
    def rows(path, data):
        h = header(data)
        yield (path, h["identifier"], h["version"], h["unique_id"], h["mark_bits"], h["columns"], h["rows"], h["rotation"], h["white_balance"], h["color_mode"], h["ext_types"], h["ext_data"])

    return _view(files, HEADER_SCHEMA, rows)


def sections(files: DataFrame) -> DataFrame:
    return _view(files, SECTION_SCHEMA, lambda path, data: ((path, i, o, n, t.decode("latin-1")) for i, (o, n, t) in enumerate(directory(data))))


def first_section(sections_df: DataFrame, *types: str) -> DataFrame:
    """(path, idx, offset, length) of the first section of any of the types."""
    found = sections_df.where(F.col("type").isin(*types)).groupBy("path").agg(F.min_by(F.struct("idx", "offset", "length"), "idx").alias("s"))
    return found.select("path", "s.*")


def property_rows(files: DataFrame) -> DataFrame:
    def rows(path, data):
        for _, s in sections_of(data, PROPERTIES)[:1]:
            yield from ((path, i, n, v) for i, (n, v) in enumerate(properties(s)))

    return _view(files, PROPERTY_SCHEMA, rows)


def metadata_rows(files: DataFrame) -> DataFrame:
    def rows(path, data):
        for _, s in sections_of(data, METADATA)[:1]:
            for i, e in enumerate(entries(s)):
                yield (path, i, e["kind"], e["name"], e["text"], e["props"], e["matrix_type"], e["dims"], e["f64"], e["i64"])

    return _view(files, ENTRY_SCHEMA, rows)


def plane_rows(files: DataFrame) -> DataFrame:
    """One row for each coded plane of each file's last readable raster section."""

    def rows(path, data):
        found: list[tuple] = []
        for i, s in sections_of(data, IMAGES):
            try:
                some = [(path, i, p["layout"], p["image_rows"], p["image_columns"], p["plane"], p["rows"], p["columns"], p["seed"], p["table"], p["data"]) for p in planes(s)]
            except (ValueError, struct.error, IndexError):
                continue
            found = some or found
        yield from found

    return _view(files, PLANE_SCHEMA, rows)


def thumbnails(files: DataFrame) -> DataFrame:
    """Embedded previews, their bytes as they are."""

    def rows(path, data):
        for i, s in sections_of(data, IMAGES):
            kind, fmt, columns, n = struct.unpack_from("<4I", s, 8)
            if kind & 0xFF == 2:
                yield (path, i, THUMBNAILS.get(fmt & 0xFF, "other"), columns, n, s[28:])

    return _view(files, THUMB_SCHEMA, rows)


def decode_strips(plane_df: DataFrame) -> DataFrame:
    """(path, idx, layout, plane, y, v): decoded rows. Planes are dealt out, as each is one sequential stream."""
    ship(plane_df.sparkSession)
    kinds, names = arrow_schema(STRIP_SCHEMA), arrow_schema(PLANE_SCHEMA).names

    def all_rows(given: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for row in tuples(given):
            p = dict(zip(names, row, strict=True))
            p["table"] = [(t["size"], t["code"]) for t in p["table"]]
            for c, v in enumerate(decode_plane(p)):
                yield from ((p["path"], p["idx"], p["layout"], p["plane"] + c, y, line) for y, line in enumerate(v.astype(np.int32)))

    parts = int(plane_df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plane_df.select(*names).repartition(parts, "path", "plane").mapInArrow(lambda given: batches(all_rows(given), kinds), STRIP_SCHEMA)


def strips_to_pixels(strips: DataFrame) -> DataFrame:
    """(path, y, x, b, m, t): rows of the three planes meet as arrays, then become pixels.

    In the quattro layout the top plane has another size and stays apart; t is 0 here.
    """
    layer = lambda p: F.max(F.when(F.col("plane") == p, F.col("v")))
    low = strips.where("not (layout = 'quattro' and plane = 2)")
    rows = low.groupBy("path", "y").agg(layer(0).alias("b"), layer(1).alias("m"), layer(2).alias("t"))
    whole = [F.coalesce(F.col(c), F.array().cast("array<int>")).alias(c) for c in "bmt"]
    p = rows.select("path", "y", *whole).select("path", "y", F.posexplode(F.arrays_zip("b", "m", "t")).alias("x", "p"))
    return p.select("path", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[F.coalesce(F.col(f"p.{c}"), F.lit(0)).cast("long").alias(c) for c in "bmt"])


def top_pixels(strips: DataFrame) -> DataFrame:
    """(path, y, x, v) of the full-resolution top plane of the quattro layout."""
    top = strips.where("layout = 'quattro' and plane = 2")
    return top.select("path", F.col("y").cast("long").alias("y"), F.posexplode("v").alias("x", "v")).select("path", "y", F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias("v"))


_HEADER_FIELDS = ("identifier", "version", "unique_id", "mark_bits", "columns", "rows", "rotation", "white_balance", "color_mode", "ext_types", "ext_data")
_ENTRY_FIELDS = ("kind", "name", "text", "props", "matrix_type", "dims", "f64", "i64")
VIEWS = {"header": HEADER_SCHEMA, "sections": SECTION_SCHEMA, "properties": PROPERTY_SCHEMA, "metadata": ENTRY_SCHEMA}


class ContainerSource(DataSource):
    """``spark.read.format("layered_raw").option("view", ...).load(path)``; one task for each file."""

    @classmethod
    def name(cls) -> str:
        return "layered_raw"

    def schema(self) -> str:
        return VIEWS[self.options.get("view", "header")]

    def reader(self, schema) -> DataSourceReader:
        return ContainerReader(self.options)


class Ranges:
    """A file's bytes by range: what a view asks for is read, and counted, nothing else."""

    def __init__(self, source) -> None:
        self.source, self.size, self.fetched = source, source.size(), 0

    def __call__(self, at: int, n: int) -> bytes:
        if not 0 <= at <= self.size:
            return b""
        self.source.seek(at)
        data = self.source.read(min(n, self.size - at))
        self.fetched += len(data)
        return data

    def directory(self) -> list[tuple[int, int, bytes]]:
        """The section directory: the last four bytes, its head, its rows."""
        end = self(self.size - 4, 4)
        at = struct.unpack("<I", end)[0]
        head = self(at, 12)
        if head[:4] != DIRECTORY:
            raise ValueError("no section directory")
        n = struct.unpack_from("<I", head, 8)[0]
        rows = self(at + 12, 12 * n)
        return [struct.unpack_from("<II4s", rows, 12 * i) for i in range(n)]

    def first(self, kinds: tuple[bytes, ...]) -> bytes | None:
        """The bytes of the first section of one of the types."""
        return next((self(o, n) for o, n, t in self.directory() if t in kinds), None)


def view_rows(view: str, path: str, read: Ranges) -> Iterator[tuple]:
    """The rows of a view of one file, from the bytes that it needs; a damaged file gives none."""
    try:
        if view == "header":
            h = header(read(0, HEADER_BYTES))
            yield (path, *[h[k] for k in _HEADER_FIELDS])
        elif view == "sections":
            yield from [(path, i, o, n, t.decode("latin-1")) for i, (o, n, t) in enumerate(read.directory())]
        elif view == "properties":
            found = read.first(PROPERTIES)
            yield from [(path, i, n, v) for i, (n, v) in enumerate(properties(found))] if found else []
        else:
            found = read.first(METADATA)
            yield from [(path, i, *[e[k] for k in _ENTRY_FIELDS]) for i, e in enumerate(entries(found))] if found else []
    except (ValueError, struct.error, IndexError):
        return


class ContainerReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.view = options["path"], options.get("view", "header")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        info = store.get_file_info(at)
        files = [at] if info.is_file else sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.is_file)
        return [InputPartition((self.path, f)) for f in files]

    def read(self, partition: InputPartition):
        from pyarrow import fs

        whole, at = partition.value
        store = fs.FileSystem.from_uri(whole)[0] if "://" in whole else fs.LocalFileSystem()
        with store.open_input_file(at) as source:
            yield from view_rows(self.view, at, Ranges(source))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ContainerSource)
