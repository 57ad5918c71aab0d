"""Tag directories: value places, rationals, strips, and packing in either byte order."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Type code -> (size, struct letter): byte, ascii, short, long, rational, undefined, signed rational, float, double.
TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, "B"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}


def place_values(tags: DataFrame, start: int, ifd: str = "ifd", tag: str = "tag", size: str = "size") -> DataFrame:
    """Add place: where a directory's value goes, in the order of tags, if it has over four bytes; else null."""
    far = F.when(F.col(size) > 4, F.col(size)).otherwise(0)
    before = F.sum(far).over(Window.partitionBy(ifd).orderBy(tag).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return tags.withColumn("place", F.when(F.col(size) > 4, (before + start).cast("long")))


def to_rational(v: Column, most: int, steps: int = 50) -> Column:
    """struct(num, den): the best continued fraction whose denominator is at most ``most``."""
    long = lambda n: F.lit(n).cast("long")
    start = F.struct(F.abs(v).cast("double").alias("z"), long(0).alias("n0"), long(1).alias("d0"), long(1).alias("n1"), long(0).alias("d1"), F.lit(False).alias("done"))

    def step(s, _):
        a = F.floor(s["z"]).cast("long")
        n2, d2 = s["n1"] * a + s["n0"], s["d1"] * a + s["d0"]
        stop = s["done"] | (d2 > most)
        last = F.abs(s["z"] - a) == 0
        nxt = F.struct(F.when(last, s["z"]).otherwise(1.0 / F.nullif(s["z"] - a, F.lit(0.0))).alias("z"), s["n1"].alias("n0"), s["d1"].alias("d0"), n2.alias("n1"), d2.alias("d1"), last.alias("done"))
        keep = F.struct(s["z"].alias("z"), s["n0"].alias("n0"), s["d0"].alias("d0"), s["n1"].alias("n1"), s["d1"].alias("d1"), F.lit(True).alias("done"))
        return F.when(stop, keep).otherwise(nxt)

    got = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    zero = F.struct(long(0).alias("num"), long(1).alias("den"))
    return F.when(v == 0, zero).otherwise(F.struct((F.when(v < 0, -got["n1"]).otherwise(got["n1"])).alias("num"), got["d1"].alias("den")))


def strip_sizes(pixels: DataFrame, rows: int, bytes_each: int) -> DataFrame:
    """(strip, bytes) of an image cut in strips of ``rows`` rows."""
    return pixels.groupBy(F.expr(f"y div {rows}").alias("strip")).agg((F.count(F.lit(1)) * bytes_each).alias("bytes"))


@dataclass
class Directory:
    """Collects tags, then writes them sorted, small values in place and large ones after the directory."""

    order: str = "<"
    entries: dict[int, tuple[int, int, bytes]] = field(default_factory=dict)

    def add(self, tag: int, kind: int, values) -> Directory:
        if isinstance(values, str):
            values = values.encode("latin-1", "replace") + b"\0"
        if isinstance(values, (bytes, bytearray)):
            data, count = bytes(values), len(values)
        else:
            values = list(values)
            flat = [x for v in values for x in (v if isinstance(v, tuple) else (v,))]
            data, count = struct.pack(self.order + TYPES[kind][1][0] * len(flat), *flat), len(values)
        self.entries[tag] = kind, count, data
        return self

    def size(self) -> int:
        return 2 + 12 * len(self.entries) + 4 + sum(len(d) + len(d) % 2 for _, _, d in self.entries.values() if len(d) > 4)

    def pack(self, at: int, following: int = 0) -> bytes:
        """Bytes of the directory for a place ``at`` in the file."""
        far = at + 2 + 12 * len(self.entries) + 4
        head, tail = struct.pack(self.order + "H", len(self.entries)), b""
        for tag, (kind, count, data) in sorted(self.entries.items()):
            head += struct.pack(self.order + "HHI", tag, kind, count)
            if len(data) <= 4:
                head += data.ljust(4, b"\0")
            else:
                head += struct.pack(self.order + "I", far + len(tail))
                tail += data + b"\0" * (len(data) % 2)
        return head + struct.pack(self.order + "I", following) + tail
