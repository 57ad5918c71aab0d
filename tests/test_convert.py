"""From containers to files, with each file's own calibration."""

import numpy as np
import pytest
from encoder import container, list_entry, matrix_entry, metadata_section, property_section, true_section

from pyspark.sql import functions as F

from lamina.functions import matrix as mx
from lamina.operators import gain, neighbourhood
from lamina.plans import convert as cv
from lamina.plans.develop import Options
from lamina.sources import container as ct

RNG = np.random.default_rng(9)


def entries(gain):
    return (
        list_entry("WhiteBalanceGains", [("Auto", "G")]) + list_entry("WhiteBalanceColorCorrections", [("Auto", "C")]) + matrix_entry("G", 3, [3], gain, "<f4") + matrix_entry("C", 3, [3, 3], np.eye(3).ravel(), "<f4")
        + matrix_entry("ImageDepth", 1, [1], [12], "<u4") + matrix_entry("KeepImageArea", 2, [4], [0, 0, 15, 11], "<u4") + matrix_entry("ActiveImageArea", 2, [4], [2, 2, 13, 11], "<u4")
        + matrix_entry("DarkShieldTop", 2, [4], [0, 0, 15, 1], "<u4") + matrix_entry("BadPixelsF20", 1, [3, 2], [5, 6, 1, 99, 3, 1], "<u4") + matrix_entry("BadPixels", 1, [1], [(4 << 20) | (7 << 8)], "<u4") + matrix_entry("HighlightPixelsInfo", 1, [2, 2], [3, 3, 20, 5], "<u4")
        + matrix_entry("BadPixelsChromaF23", 1, [5], [9, 4, 6, 0, 2], "<u4") + matrix_entry("DarkShieldColRange", 2, [2, 2], [0, 1, 14, 15], "<u4")
    )


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("in")
    for n, gain in (("a", [2.0, 1.0, 0.5]), ("b", [1.0, 1.0, 1.0])):
        planes = [np.full((12, 16), 100) + RNG.integers(0, 3, (12, 16)) for _ in range(3)]
        for p in planes:
            p[2:, 2:14] += RNG.integers(0, 3000, (10, 12))
        data = container([(b"SECp", property_section([("CAMMODEL", "M")])), (b"SECi", true_section(planes)), (b"SECc", metadata_section(entries(gain), 2))])
        (at / n).write_bytes(data)
    return at


def test_calibrations(spark, folder):
    rows = {r["image_id"][-1]: r for r in cv.calibrations(ct.scan(spark, str(folder)), "Auto").collect()}
    assert rows["a"]["gain"] == [2.0, 1.0, 0.5] and rows["b"]["gain"] == [1.0] * 3 and rows["a"]["max_raw"] == [4095] * 3
    assert np.allclose(rows["a"]["layers"], mx.SRGB_TO_XYZ) and tuple(rows["a"]["active"]) == (2, 2, 13, 11)
    assert [tuple(r) for r in rows["a"]["dark"]] == [(0, 0, 15, 1), (0, 0, 1, 11), (14, 0, 15, 11)]


def test_bad_pixels_from_metadata(spark, folder):
    files = ct.scan(spark, str(folder))
    got = {(r["y"], r["x"]) for r in cv.bad_pixels(files, cv.calibrations(files)).collect() if r["image_id"].endswith("a")}
    assert got == {(5, 6), (4, 7), (3, 3), (8, 3), (9, 4), (9, 6)}


@pytest.mark.parametrize(("kind", "options"), [("ppm", Options(tone="none", denoise=False)), ("tiff", Options(unprocessed=True)), ("ppm", Options(preprocessed=True)), ("jpeg", Options(quality=80)), ("meta", Options())])
def test_convert(spark, folder, tmp_path, kind, options):
    target = f"file://{tmp_path}/{kind}"
    rows = cv.convert(spark, str(folder), target, kind, options).collect()
    assert len(rows) == 2 and all(r["bytes"] > 0 for r in rows)
    if kind == "ppm":  # both are cropped to the active area
        assert (tmp_path / "ppm" / "a.ppm").read_text().split("\n")[1] == "12 10"


def test_preprocessed_and_top(spark, folder):
    files = ct.scan(spark, str(folder))
    pixels = ct.strips_to_pixels(ct.decode_strips(ct.plane_rows(files))).withColumnRenamed("path", "image_id")
    cal = cv.calibrations(files)
    shown = cv.preprocessed_map(pixels, cal)
    assert shown.count() == 2 * 12 * 16 and shown.where("r < 0 or r > 65535").count() == 0
    top = spark.createDataFrame([("p", 0, 1, 7)], "image_id string, y long, x long, v long")
    grey = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in cv.top_map(top, spark.createDataFrame([("p", 3, 2)], "image_id string, width long, height long")).collect()}
    assert len(grey) == 6 and grey[0, 1] == (7, 7, 7) and grey[1, 2] == (0, 0, 0)


def test_top_plane_development(spark):
    planes = [np.full((4, 6), 900), np.full((4, 6), 800)]
    top = np.full((8, 12), 2500)
    pixels = spark.createDataFrame([("q", y, x, int(planes[0][y, x]), int(planes[1][y, x]), 0) for y in range(4) for x in range(6)], "image_id string, y long, x long, b long, m long, t long")
    tops = spark.createDataFrame([("q", y, x, int(top[y, x])) for y in range(8) for x in range(12)], "image_id string, y long, x long, v long")
    cal = spark.createDataFrame([("q", [1.0, 1.0, 1.0], list(mx.SRGB_TO_XYZ), [4095] * 3, [], None, None, None, 0, 0)], f"image_id string, gain array<double>, layers array<double>, max_raw array<bigint>, dark array<{cv._RECT}>, active {cv._RECT}, active_area array<bigint>, keep array<bigint>, header_columns bigint, header_rows bigint")
    out = cv.develop_all(pixels, cal, Options(denoise=False, tone="none"), tops, (6, 4), (12, 8)).collect()
    assert len(out) == 96 and len({(r["r"], r["g"], r["b"]) for r in out}) == 1


def test_equal_names_and_own_classes(spark, folder, tmp_path):
    """Files of one name in two folders stay two images; each is denoised by its own class and cropped to its own area."""
    import shutil

    for sub, name in (("one", "a"), ("two", "b")):
        (tmp_path / "in" / sub).mkdir(parents=True)
        shutil.copy(folder / name, tmp_path / "in" / sub / "x.raw")
    files = ct.scan(spark, str(tmp_path / "in" / "*"))
    names = [r["name"] for r in cv.file_names(files.select(F.col("path").alias("image_id"))).collect()]
    assert len(set(names)) == 2 and all(n.startswith("x.raw-") for n in names)
    written = cv.convert(spark, str(tmp_path / "in" / "*"), f"file://{tmp_path}/out", "ppm", Options(tone="none", denoise=False)).collect()
    assert len({r["file"] for r in written}) == 2
    pixels = ct.strips_to_pixels(ct.decode_strips(ct.plane_rows(files))).withColumnRenamed("path", "image_id")
    cal = cv.calibrations(files).withColumn("denoise_class", F.when(F.col("image_id").contains("/one/"), "F20").otherwise("STD"))
    both = {(r["image_id"], r["y"], r["x"]): r["r"] for r in cv.develop_all(pixels, cal, Options(tone="none"), size=(16, 12)).collect()}
    assert len(both) == 2 * 12 * 10
    for part in ("/one/", "/two/"):
        alone = cv.develop_all(pixels.where(F.col("image_id").contains(part)), cal.where(F.col("image_id").contains(part)), Options(tone="none"), size=(16, 12)).collect()
        assert all(both[r["image_id"], r["y"], r["x"]] == r["r"] for r in alone)


def test_median_inside_own_area(spark):
    rng = np.random.default_rng(4)
    grids = {k: rng.integers(0, 99, (7, 9)) for k in "pq"}
    rows = [(k, y, x, int(g[y, x])) for k, g in grids.items() for y in range(7) for x in range(9)]
    areas = {"p": (2, 1, 5, 4), "q": None}
    df = spark.createDataFrame(rows, "image_id string, y long, x long, v long").join(spark.createDataFrame([(k, a) for k, a in areas.items()], f"image_id string, active {cv._RECT}"), "image_id")
    for r in neighbourhood.median_area(df, "v", 9, 7, F.col("active")).collect():
        g, a = grids[r["image_id"]], areas[r["image_id"]] or (0, 0, 8, 6)
        inside = a[0] <= r["x"] <= a[2] and a[1] <= r["y"] <= a[3]
        wide = np.pad(g, 1, mode="edge")[r["y"] : r["y"] + 3, r["x"] : r["x"] + 3]
        assert r["v"] == (np.median(wide) if inside else g[r["y"], r["x"]])


def test_tiles_equal_whole_images(spark):
    rng = np.random.default_rng(5)
    g = rng.integers(0, 4000, (23, 31))
    df = spark.createDataFrame([("p", y, x, int(g[y, x])) for y in range(23) for x in range(31)], "image_id string, y long, x long, v long")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(neighbourhood.median3(df, "v", 31, 23, tile=8)) == rows(neighbourhood.median3(df, "v", 31, 23))
    assert rows(neighbourhood.bicubic(df, ["v"], (31, 23), (50, 46), tile=8)) == rows(neighbourhood.bicubic(df, ["v"], (31, 23), (50, 46)))


def test_cube_files():
    side, values = cv.read_cube("# c\nTITLE \"t\"\nLUT_3D_SIZE 2\n" + "\n".join(f"{i} 0 0.5" for i in range(8)))
    assert side == 2 and len(values) == 8 and values[3] == (3.0, 0.0, 0.5)
    with pytest.raises(ValueError):
        cv.read_cube("LUT_3D_SIZE 3\n0 0 0")


def spatial(aperture):
    """Four blocks around f/4 at a lens position of 30.5, each of one code everywhere, and what they merge to."""
    out, names = b"", []
    for k, (stop, place) in enumerate(((2.8, 30.0), (5.6, 30.0), (2.8, 31.0), (5.6, 31.0))):
        names.append((1 / stop, place))
        props = []
        for c, n in (("R", 6), ("G", 4), ("B", 4)):
            props += [(f"GainsTable{c}", f"T{k}{c}"), (f"MinGains{c}", "0.5"), (f"Delta{c}", "0.25")]
            out += matrix_entry(f"T{k}{c}", 1, [2, n // 2], [k + 1 + i for i in range(n)], "<u4")
        out += list_entry(f"SpatialGainsProps_{stop}_{place}", props)
    return out + matrix_entry("CaptureAperture", 3, [1], [aperture], "<f4") + matrix_entry("ObjectDistance", 3, [1], [183.0], "<f4"), names


def test_dng_with_gain_maps(spark, tmp_path):
    import struct

    more, places = spatial(4.0)
    planes = [np.full((12, 16), 100) + RNG.integers(0, 900, (12, 16)) for _ in range(3)]
    (tmp_path / "in").mkdir()
    for name, extra in (("g", more), ("n", b"")):
        data = container([(b"SECp", property_section([("CAMMODEL", "M")])), (b"SECi", true_section(planes)), (b"SECc", metadata_section(entries([2.0, 1.0, 0.5]) + extra, 2))])
        (tmp_path / "in" / name).write_bytes(data)
    files = ct.scan(spark, str(tmp_path / "in"))
    got = {r["channel"]: r for r in gain.file_gains(ct.metadata_rows(files), ct.property_rows(files), "Auto").collect()}
    tx, ty = 1 / 4.0, 1 / (1 / 30.0 - 1 / 1830.0)
    xs, ys = sorted({p[0] for p in places}), sorted({p[1] for p in places})
    wx = {xs[1]: (tx - xs[0]) / (xs[1] - xs[0]), xs[0]: (xs[1] - tx) / (xs[1] - xs[0])}
    wy = {ys[1]: (ty - ys[0]) / (ys[1] - ys[0]), ys[0]: (ys[1] - ty) / (ys[1] - ys[0])}
    for channel, n in ((0, 6), (1, 4), (2, 4)):
        want = [sum(wx[x] * wy[y] * (0.5 + 0.25 * (k + 1 + i)) for k, (x, y) in enumerate(places)) for i in range(n)]
        assert np.allclose(got[channel]["gains"], want, rtol=1e-6) and (got[channel]["rows"], got[channel]["columns"]) == (2, n // 2)
    rows = {r["file"]: r["bytes"] for r in cv.convert(spark, str(tmp_path / "in"), f"file://{tmp_path}/out", "dng", Options(tone="none", denoise=False)).collect()}
    assert set(rows) == {"g.dng", "n.dng"} and rows["g.dng"] > rows["n.dng"]
    data = (tmp_path / "out" / "g.dng").read_bytes()

    def tags(at):
        n = struct.unpack_from("<H", data, at)[0]
        return {t: (k, c, v) for t, k, c, v in (struct.unpack_from("<HHII", data, at + 2 + 12 * i) for i in range(n))}

    main = tags(8)
    sub = tags(main[330][2])
    assert data[:4] == b"II*\0" and sub[256][2] == 12 and sub[257][2] == 10 and 33437 in main and 51009 in sub
    at = sub[51009][2]
    assert struct.unpack_from(">I", data, at)[0] == 3 and struct.unpack_from(">I", data, at + 4)[0] == 9
    with pytest.raises(ValueError):
        cv.convert(spark, str(tmp_path / "in"), f"file://{tmp_path}/out", "dng", Options(unprocessed=True))


def test_exposure_data_in_tiff(spark, tmp_path):
    planes = [np.full((12, 16), 100) + RNG.integers(0, 900, (12, 16)) for _ in range(3)]
    more = matrix_entry("CaptureAperture", 3, [1], [4.0], "<f4") + matrix_entry("CaptureISO", 3, [1], [400.0], "<f4") + matrix_entry("SensorISO", 3, [1], [100.0], "<f4")
    data = container([(b"SECp", property_section([("CAMMODEL", "Model X")])), (b"SECi", true_section(planes)), (b"SECc", metadata_section(entries([1.0, 1.0, 1.0]) + more, 2))])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t").write_bytes(data)
    files = ct.scan(spark, str(tmp_path / "in"))
    assert [r["scale"] for r in cv.iso_scales(ct.metadata_rows(files)).collect()] == [4.0]
    cv.convert(spark, str(tmp_path / "in"), f"file://{tmp_path}/out", "tiff", Options(unprocessed=True)).collect()
    written = (tmp_path / "out" / "t.tiff").read_bytes()
    n = int.from_bytes(written[8:10], "little")
    tags = {int.from_bytes(written[10 + 12 * i : 12 + 12 * i], "little") for i in range(n)}
    assert 34665 in tags and b"Model X" in written
