import numpy as np
import pytest
from encoder import container, legacy_section, list_entry, matrix_entry, metadata_section, packed_section, property_section, text_entry, true_section

from lamina.operators import metadata as md
from lamina.sinks.text import metadata_lines
from lamina.sources import codec
from lamina.sources import container as ct

RNG = np.random.default_rng(5)


def smooth(h, w, base=600):
    return np.clip(base + np.cumsum(RNG.integers(-9, 10, (h, w)), axis=1), 0, 4095)


ENTRIES = (
    text_entry("Note", "hello")
    + list_entry("WhiteBalanceGains", [("Sunlight", "SunGain"), ("Auto", "AutoGain"), ("Auto", "Second")])
    + list_entry("WhiteBalanceColorCorrections", [("Sunlight", "SunCC")])
    + matrix_entry("SunGain", 3, [3], [1.5, 1.0, 0.75], "<f4")
    + matrix_entry("AutoGain", 3, [3], [2.0, 1.0, np.nan], "<f4")
    + matrix_entry("SunCC", 3, [3, 3], np.eye(3).ravel() * 2, "<f4")
    + matrix_entry("TempGainFact", 3, [3], [2.0, 2.0, 2.0], "<f4")
    + matrix_entry("CAMERAID", 1, [1], [81], "<u4")
    + matrix_entry("WhiteBalance", 1, [1], [2], "<u4")
    + matrix_entry("ImageDepth", 1, [1], [12], "<u4")
    + matrix_entry("KeepImageArea", 2, [4], [10, 5, 49, 34], "<u4")
    + matrix_entry("CaptureISO", 3, [1], [200.0], "<f4")
    + matrix_entry("CaptureShutter", 3, [1], [125.0], "<f4")
    + matrix_entry("Shorts", 0, [2, 2], [-1, 2, -3, 4], "<i2")
    + matrix_entry("Doubles", 9, [2], [0.5, np.inf], "<f8")
)
PROPS = [("CAMMODEL", "Model dp2 x"), ("CAMSERIAL", "42"), ("CAMMODEL", "other"), ("APERTURE", "2.8"), ("ÜNÏ", "日本")]


@pytest.fixture(scope="module")
def planes():
    return [smooth(12, 9) for _ in range(3)]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory, planes):
    folder = tmp_path_factory.mktemp("raw")
    quattro = [smooth(6, 8), smooth(6, 8), smooth(12, 16)]
    binned = [smooth(8, 10) for _ in range(3)]
    legacy = np.stack([smooth(7, 6, 300) for _ in range(3)], axis=2)
    negative = legacy - legacy.max() + 5
    prop, meta = (b"SECp", property_section(PROPS)), (b"SECc", metadata_section(ENTRIES, 2))
    made = {
        "true": container([prop, (b"SECi", b"SECi" + (0x20000).to_bytes(4, "little") + (2).to_bytes(4, "little") + (0x12).to_bytes(4, "little") + b"\1\0\0\0\1\0\0\0\0\0\0\0JPEGBYTES"), (b"SECi", true_section(planes)), meta]),
        "four": container([(b"IMA2", true_section(planes)), (b"CAMF", metadata_section(ENTRIES, 4))], version=4 << 16),
        "five": container([(b"SECi", true_section(planes)), (b"SECc", metadata_section(ENTRIES, 5))], version=3 << 16),
        "quattro": container([(b"SECi", true_section(quattro, fmt=0x23, image=(12, 16)))], version=(4 << 16) | 1),
        "binned": container([(b"SECi", true_section(binned, fmt=0x25, image=(8, 7)))]),
        "legacy": container([(b"SECi", legacy_section(legacy))], version=2 << 16),
        "negative": container([(b"SECi", legacy_section(negative, fmt=5))]),
        "packed": container([(b"SECi", packed_section(legacy))]),
        "broken": b"FOVb" + b"\0" * 700,
        "empty": b"",
    }
    for n, data in made.items():
        (folder / n).write_bytes(data)
    return ct.scan(spark, str(folder)), folder, {"quattro": quattro, "binned": binned, "legacy": legacy, "negative": negative - negative.min()}


def of(df, name):
    return df.where(df.path.endswith(f"/{name}"))


def test_headers_and_sections(files):
    h = {r["path"].rsplit("/", 1)[1]: r for r in ct.headers(files[0]).collect()}
    assert h["true"]["columns"] == 64 and h["true"]["white_balance"] == "Sunlight" and h["true"]["color_mode"] == "Std" and len(h["true"]["ext_data"]) == 32
    assert h["five"]["ext_data"][63] == 63.0 and h["four"]["columns"] is None and h["legacy"]["white_balance"] is None and "empty" not in h
    s = ct.sections(files[0])
    assert [r["type"] for r in of(s, "true").orderBy("idx").collect()] == ["SECp", "SECi", "SECi", "SECc"]
    assert of(ct.first_section(s, "SECi", "IMA2"), "true").first()["idx"] == 1
    assert of(s, "broken").count() == 0


def test_properties(files):
    p = ct.property_rows(files[0])
    assert [(r["name"], r["value"]) for r in of(p, "true").orderBy("idx").collect()] == PROPS
    assert of(md.property_named(p, "CAMMODEL"), "true").first()["value"] == "Model dp2 x"


@pytest.mark.parametrize("name", ["true", "four", "five"])
def test_metadata(files, name):
    e = of(ct.metadata_rows(files[0]), name)
    rows = {r["name"]: r for r in e.collect()}
    assert rows["Note"]["text"] == "hello" and rows["AutoGain"]["f64"] == [2.0, 1.0, 0.0] and rows["Doubles"]["f64"] == [0.5, 0.0]
    assert rows["Shorts"]["i64"] == [-1, 2, -3, 4] and [d["size"] for d in rows["Shorts"]["dims"]] == [2, 2]
    assert md.scalar(e, "CAMERAID").first()["value"] == 81 and md.scalar(e, "CAMERAID", "f64").count() == 0 and md.vector(e, "SunGain", 2).count() == 0
    assert md.list_property(e, "WhiteBalanceGains", "Auto").first()["value"] == "AutoGain"
    assert md.preset_matrix(e, "WhiteBalanceGains", "Daylight", [3]).first()["value"] == [1.5, 1.0, 0.75]
    assert md.preset_matrix(e, "WhiteBalanceGains", "Sunlight", [3, 3]).count() == 0
    assert md.white_balance_gain(e, "Sunlight").first()["value"] == [3.0, 2.0, 1.5]
    assert md.is_true_engine(e).first()["value"] is True and md.max_raw(e).first()["value"] == [4095] * 3
    assert md.matrix_sized(e, "Shorts", [2, 0]).first()["value"] == [-1, 2, -3, 4] and md.rect(e, "KeepImageArea").first()["value"] == [10, 5, 49, 34]
    exif = md.exif_info(e).first()
    assert exif["iso"] == 200 and exif["exposure"] == 1 / 125


def test_camera_info(files):
    info = of(md.camera_info(ct.headers(files[0]), ct.property_rows(files[0]), ct.metadata_rows(files[0])), "true").first()
    assert (info["model"], info["serial"], info["white_balance"]) == ("Model dp2 x", "42", "Sunlight")


def test_rasters(files, planes):
    strips = ct.decode_strips(ct.plane_rows(files[0])).cache()
    pixels = ct.strips_to_pixels(strips)

    def image(name, c):
        rows = of(pixels, name).collect()
        out = np.zeros((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), int)
        for r in rows:
            out[r["y"], r["x"]] = r[c]
        return out

    for name in ("true", "four", "five"):
        assert all((image(name, c) == p).all() for c, p in zip("bmt", planes, strict=True))
    kept = files[2]
    assert (image("quattro", "b") == kept["quattro"][0]).all() and (image("quattro", "m") == kept["quattro"][1]).all() and (image("quattro", "t") == 0).all()
    top = {(r["y"], r["x"]): r["v"] for r in of(ct.top_pixels(strips), "quattro").collect()}
    assert all(top[y, x] == kept["quattro"][2][y, x] for y in range(12) for x in range(16))
    assert all((image("binned", c) == p[:, :7]).all() for c, p in zip("bmt", kept["binned"], strict=True))
    for name, want in (("legacy", kept["legacy"]), ("packed", kept["legacy"]), ("negative", kept["negative"])):
        assert all((image(name, c) == want[:, :, i]).all() for i, c in enumerate("bmt"))


def test_thumbnail_and_dump(files):
    t = ct.thumbnails(files[0]).collect()
    assert [(r["kind"], bytes(r["data"])) for r in t] == [("jpeg", b"JPEGBYTES")]
    lines = metadata_lines(*(of(d, "true") for d in (ct.headers(files[0]), ct.metadata_rows(files[0]), ct.property_rows(files[0]))), most=2)
    text = [r["line"] for r in lines.orderBy("part", "idx", "sub").collect()]
    assert text[0] == "BEGIN header" and "text Note: hello" in text and "CAMSERIAL = 42" in text and any("(1 more)" in x for x in text) and text[-1] == "END properties"


def test_data_source(spark, files):
    ct.register(spark)
    for view, want in (("header", ct.headers), ("properties", ct.property_rows), ("sections", ct.sections)):
        got = spark.read.format("layered_raw").option("view", view).load(str(files[1]))
        assert got.count() == want(files[0]).count()


def test_missing_codes_and_short_data():
    table = [(1, 0), (2, 0b10 << 6)]
    assert codec.category_diffs(b"", table, 3).tolist() == [0, 0, 0]
    assert codec.category_diffs(bytes([0b11111111]), table, 2).tolist() == [0, 0]
    assert codec.short_table(table)[0b11000000] == (2, -1)
    assert codec.mapped_diffs(b"\x80", [(1 << 27) | 1, (1 << 27) | 0], [5, -7 & 0xFFFF], 3).tolist() == [5, -7, -7]


def test_views_read_what_they_need(tmp_path):
    from pyarrow import fs

    from lamina.sources import container as ct

    raster = true_section([np.full((64, 64), 900) + np.random.default_rng(1).integers(0, 900, (64, 64)) for _ in range(3)])
    data = container([(b"SECp", property_section([("A", "b")])), (b"SECi", raster), (b"SECc", metadata_section(text_entry("Note", "x"), 2))])
    (tmp_path / "f").write_bytes(data)
    fetched = {}
    for view in ct.VIEWS:
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as source:
            read = ct.Ranges(source)
            assert list(ct.view_rows(view, "f", read))
            fetched[view] = read.fetched
    assert fetched["header"] == 616 and fetched["sections"] == 4 + 12 + 3 * 12 and max(fetched.values()) <= 616 < len(data) // 10


def test_tables_are_made_once():
    """A legacy image's codes are looked up once for all rows and images, and a row's bits end where it can end."""
    image = np.stack([smooth(40, 6, 300) for _ in range(3)], axis=2)
    codec.mapped_codes.cache_clear()
    for _ in range(3):
        (p,) = ct.planes(legacy_section(image))
        assert (np.stack(ct.decode_plane(p), axis=2) == image).all()
    assert codec.mapped_codes.cache_info().misses == 1
    words = [(1 << 27) | 1, (2 << 27) | 1]
    assert codec.mapped_diffs(b"\x60" + b"\xff" * 9, words, None, 3).tolist() == [1, 0, 0]
    assert codec.mapped_diffs(b"", words, None, 2).tolist() == codec.mapped_diffs(b"\0\0", words, None, 2).tolist() == [0, 0]


def test_batches_are_small():
    """Rows leave a worker few at a time, by number and by bytes, in order."""
    from lamina.sources import batches as b

    taken = []

    def rows(n, size):
        for i in range(n):
            taken.append(i)
            yield f"f{i}", i, bytes(size), [(i, "x")]

    schema = b.arrow_schema("path string, idx int, data binary, dims array<struct<size:int,name:string>>")
    first = next(b.batches(rows(100_000, 0), schema))
    assert first.num_rows == len(taken) == b.ROWS
    taken.clear()
    first = next(b.batches(rows(100_000, 100_000), schema))
    assert first.num_rows == len(taken) == -(-b.BYTES // 100_008)
    assert list(b.tuples(b.batches(rows(3, 2), schema))) == [(f"f{i}", i, b"\0\0", [{"size": i, "name": "x"}]) for i in range(3)]
    assert not list(b.batches(iter(()), schema))
