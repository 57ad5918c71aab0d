"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for each frame.

    magic | frame ... | seek table (zstandard) | footer: table offset, table size, table crc32, magic

Frames hold ``FRAME`` ids each (the last one fewer) as little-endian unsigned 32-bit integers, so the frame of
any id is known; the seek table has each frame's offset, size and crc32, and each document's
id and first token. Documents without an id come first; the table says how many they are. A reader fetches the
footer, the table and only the frames it needs.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import batch_of, map_arrow, materialise, text_of, work_path
from lamina.llm.wordbpe import encoder

MAGIC = b"LMTOKEN2"
FRAME = 1 << 16
_FOOTER = struct.Struct("<QQI8s")


def _u32(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class TokenFileWriter:
    """Streams documents into one file; holds one frame's ids at a time."""

    def __init__(self, out, level: int = 3) -> None:
        self.out, self.zip = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.size, self.at, self.n, self.nulls = [], 0, len(MAGIC), 0, 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.starts: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """The next document, in ascending order of ids; those without one come first."""
        self.nulls += doc_id is None
        self.ids.append(doc_id or 0)
        self.starts.append(self.n)
        self.n += len(ids) // 4
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 4 * FRAME:
            data, at = memoryview(b"".join(self.held)), 0
            while self.size - at >= 4 * FRAME:
                self._frame(data[at : at + 4 * FRAME])
                at += 4 * FRAME
            self.held, self.size = [bytes(data[at:])], self.size - at

    def _frame(self, data) -> None:
        packed = self.zip.compress(data)
        self.frames.append((self.at, len(packed), zlib.crc32(data)))
        self.out.write(packed)
        self.at += len(packed)

    def close(self) -> int:
        if self.size:
            self._frame(b"".join(self.held))
        table = np.array(self.frames, "<u8").reshape(-1, 3)
        raw = struct.pack("<QQQQ", len(table), len(self.ids), self.n, self.nulls) + table.tobytes() + np.array(self.ids, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes()
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.out.write(_FOOTER.pack(self.at, len(packed), zlib.crc32(packed), MAGIC))
        self.out.close()
        return self.at + len(packed) + _FOOTER.size


class TokenFileReader:
    """Random access; verifies the table's and each fetched frame's checksum."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - _FOOTER.size)
        at, length, crc, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        source.seek(at)
        packed = source.read(length)
        if magic != MAGIC or zlib.crc32(packed) != crc:
            raise ValueError("damaged token file: seek table")
        raw = zstandard.ZstdDecompressor().decompress(packed)
        frames, docs, self.n, self.nulls = struct.unpack_from("<QQQQ", raw)
        self.frames = np.frombuffer(raw, "<u8", 3 * frames, 32).reshape(-1, 3)
        self.ids = np.frombuffer(raw, "<i8", docs, 32 + 24 * frames)
        self.starts = np.append(np.frombuffer(raw, "<u8", docs, 32 + 24 * frames + 8 * docs), np.uint64(self.n)).astype(np.int64)
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            at, length, crc = map(int, self.frames[k])
            self.source.seek(at)
            data = zstandard.ZstdDecompressor().decompress(self.source.read(length))
            if zlib.crc32(data) != crc:
                raise ValueError(f"damaged token file: frame {k}")
            self._last = k, data
        return self._last[1]

    def slices(self, row: int) -> Iterator[bytes]:
        """The ids of the row-th document, in one slice for each frame it touches."""
        a, b = int(self.starts[row]), int(self.starts[row + 1])
        while a < b:
            k = a // FRAME
            end = min(b, (k + 1) * FRAME)
            yield self.frame(k)[4 * (a - k * FRAME) : 4 * (end - k * FRAME)]
            a = end

    def names(self) -> pa.Array:
        """The documents' ids, null for those without one."""
        return pa.array(self.ids, pa.int64(), mask=np.arange(len(self.ids)) < self.nulls)

    def find(self, doc_id: int | None) -> list[int]:
        """Rows of a document, found in the sorted id table."""
        if doc_id is None:
            return list(range(self.nulls))
        a, b = np.searchsorted(self.ids[self.nulls :], [doc_id, doc_id + 1]) + self.nulls
        return list(range(int(a), int(b)))

    def read(self, row: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.slices(row)), "<u4")


def _write(path: str, folder: str, end_id: int | None, level: int):
    schema = pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
    end = b"" if end_id is None else _u32([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "u32", _u32, b"".join)
        context = TaskContext.get()
        writer, name = None, f"tokens-{uuid.uuid4().hex}.bin"  # a retried task writes another file; the manifest has one
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if writer is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base)
                    writer = TokenFileWriter(store.open_output_stream(f"{base}/{name}"), level)
                writer.add(doc_id.as_py(), b"".join([*enc.parts(text.as_py()), end]))
        if writer is not None:
            size = writer.close()
            yield batch_of(schema, part=[context.partitionId() if context else 0], file=[f"{folder}/{name}"], docs=[len(writer.ids)], tokens=[writer.n], bytes=[size])

    return run


def write_token_files(df: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, level: int = 3, partitions: int | None = None) -> DataFrame:
    """Encode whole texts and write one file for each range of ids, in ascending order of ids.

    Returns the manifest, a written table: part, file, docs, tokens, bytes, base (ids in all
    files before). ``folder`` must be one that all executors share. Null texts are empty. Rows without an id come
    first; rows with one id follow each other in order of a hash of their text, then the text, and may be spread over files. No
    rows: no files, an empty manifest.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_of(df, text_col)
    rows = df.select(df[id_col].cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    # the hash lets one id's rows, null's too, be cut into ranges
    ordered = rows.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    manifest = materialise(map_arrow(ordered, _write(path, folder, end_id, level), "part long, file string, docs long, tokens long, bytes long"), "manifest")
    # one row a file: the running sum is over as many rows as there are files
    return materialise(manifest.withColumn("base", F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: id, start (ids before it, over all files), n_tokens, ids_crc32."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(file)
                with store.open_input_file(at) as source:
                    reader = TokenFileReader(source)
                    names, crcs = reader.names(), []
                    for row in range(len(reader.ids)):
                        crc = 0
                        for part in reader.slices(row):
                            crc = zlib.crc32(part, crc)
                        crcs.append(crc)
                    for a in range(0, len(crcs), 10_000):
                        s = slice(a, a + 10_000)
                        yield batch_of(schema, id=names[s], start=reader.starts[:-1][s] + base, n_tokens=np.diff(reader.starts)[s], ids_crc32=crcs[s])

    files = manifest.select("file", "base").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(files, run, "id long, start long, n_tokens long, ids_crc32 long")


def document_index(manifest: DataFrame) -> DataFrame:
    """(id, file, row) of every document of the files; only their seek tables are read."""
    schema = pa.schema([("id", pa.int64()), ("file", pa.string()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(file)
                with store.open_input_file(at) as source:
                    names = TokenFileReader(source).names()
                for a in range(0, len(names), 10_000):
                    part = names[a : a + 10_000]
                    yield batch_of(schema, id=part, file=[file] * len(part), row=list(range(a, a + len(part))))

    files = manifest.select("file").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(files, run, "id long, file string, row long")


def read_documents(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<long>) of the wanted ids only, a null one included: an equal-key join with the index names
    their files, which are opened once each, and of those their frames are fetched."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, source, reader = None, None, None
        for batch in batches:
            for name, file, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != now:
                    if source is not None:
                        source.close()
                    store, at = fs.FileSystem.from_uri(file)
                    now, source = file, store.open_input_file(at)
                    reader = TokenFileReader(source)
                yield batch_of(schema, id=[name], ids=[reader.read(row).astype("int64")])
        if source is not None:
            source.close()

    index, asked = document_index(manifest), wanted.select(F.col(id_col).cast("long").alias("asked")).distinct()
    pairs = index.join(asked, index["id"].eqNullSafe(asked["asked"])).select("id", "file", "row")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(pairs.repartition(n, "file").sortWithinPartitions("file", "row"), run, "id long, ids array<long>")


def token_round_trip(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``df``'s token files into a new folder of the shared work space and read them back: one row for each row."""
    folder = work_path(df.sparkSession, "tokens")
    return read_token_files(write_token_files(df, path, folder, id_col, text_col, end_id))
