"""Raster operators against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import matrix as mx
from lamina.functions import pixel as px
from lamina.operators import badpixels, denoise, gain, geometry, levels, neighbourhood, sequences
from lamina.plans.develop import Calibration, Options, develop
from lamina.sinks import images
from lamina.sinks.tags import Directory
from lamina.sources import codec


def frame(spark, image, names=("b", "m", "t"), key=0):
    h, w = image.shape[:2]
    rows = [(key, y, x, *[int(v) for v in np.atleast_1d(image[y, x])]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, " + ", ".join(f"{n} long" for n in names))


def grid(df, names=("b", "m", "t")):
    rows = df.collect()
    out = np.zeros((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1, len(names)), np.int64)
    for r in rows:
        out[r["y"], r["x"]] = [r[n] for n in names]
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(3).integers(0, 4096, (9, 11, 3))


def test_levels(spark, image):
    areas = [(0, 0, 10, 1), (0, 0, 1, 8)]
    got = levels.black_level(frame(spark, image), areas).first()
    inside = [image[y, x] for x0, y0, x1, y1 in areas for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)]
    for i, c in enumerate("bmt"):
        v = np.array([p[i] for p in inside])
        assert math.isclose(got[f"level_{c}"], v.mean()) and math.isclose(got[f"dev_{c}"], v.std())
    none = levels.black_level(frame(spark, image), []).first()
    assert none["level_b"] == 0 and none["dev_t"] == 0
    dark = image.copy()
    dark[:2], dark[:, :2] = 20 + image[:2] % 5, 20 + image[:, :2] % 5
    lv = levels.black_level(frame(spark, dark), areas)
    one, lin = lv.first(), grid(levels.linearise(frame(spark, dark), lv, levels.FALLBACK_GAIN))
    top0 = [round(g / levels.FALLBACK_GAIN[0] * 16383) for g in levels.FALLBACK_GAIN]
    bias = max(4 * one[f"dev_{c}"] * t / (4095 - one[f"level_{c}"]) for c, t in zip("bmt", top0, strict=True))
    for i, (c, g) in enumerate(zip("bmt", levels.FALLBACK_GAIN, strict=True)):
        top = round(g * (16383 - bias) / levels.FALLBACK_GAIN[0] + bias)
        want = np.clip(np.floor((top - bias) / (4095 - one[f"level_{c}"]) * (dark[:, :, i] - one[f"level_{c}"]) + bias + 0.5), 0, 65535)
        assert np.abs(lin[:, :, i] - want).max() <= 1 and (lin[:, :, i] == want).mean() > 0.99


@pytest.mark.parametrize("pair", [(px.opponent_std, px.opponent_std_inverse, 1), (px.opponent_top, px.opponent_top_inverse, 0), (px.opponent_top4, px.opponent_top4_inverse, 0)])
def test_opponent_round_trip(spark, image, pair):
    there, back, error = pair
    f = frame(spark, image).select("image_id", "y", "x", *[c.alias(n) for c, n in zip(there(*map(F.col, "bmt")), "pqr", strict=True)])
    got = grid(f.select("image_id", "y", "x", *[c.alias(n) for c, n in zip(back(*map(F.col, "pqr")), "bmt", strict=True)]))
    assert np.abs(got - image).max() <= error


def test_median_and_area(spark, image):
    v = image[:, :, 0]
    wide = np.pad(v, 1, mode="edge")
    want = np.median(np.stack([wide[i : i + 9, j : j + 11] for i in range(3) for j in range(3)]), axis=0)
    got = neighbourhood.median3(frame(spark, image), "b", 11, 9).collect()
    assert len(got) == 99 and all(r["median"] == want[r["y"], r["x"]] for r in got)
    area = grid(neighbourhood.median_area(frame(spark, image), "b", 11, 9, (2, 1, 8, 6)))
    inner = np.zeros((9, 11), bool)
    inner[1:7, 2:9] = True
    assert (area[:, :, 0] == np.where(inner, want, v)).all() and (area[:, :, 1:] == image[:, :, 1:]).all()
    one = frame(spark, image[:1, :1])
    assert neighbourhood.median3(one, "b", 1, 1).first()["median"] == image[0, 0, 0]


def loop_bicubic(v, w_out, h_out):
    h, w = v.shape
    k = lambda x: 1.5 * abs(x) ** 3 - 2.5 * x * x + 1 if abs(x) <= 1 else (-0.5 * abs(x) ** 3 + 2.5 * x * x - 4 * abs(x) + 2 if abs(x) < 2 else 0)
    out = np.zeros((h_out, w_out))
    for y in range(h_out):
        for x in range(w_out):
            sy, sx = (y + 0.5) * h / h_out, (x + 0.5) * w / w_out
            y0, x0 = int(sy), int(sx)
            total = weight = 0.0
            for j in range(-1, 3):
                for i in range(-1, 3):
                    p = v[min(max(y0 + j, 0), h - 1), min(max(x0 + i, 0), w - 1)]
                    t = k(i - (sx - x0)) * k(j - (sy - y0))
                    total += p * t
                    weight += t
            out[y, x] = min(max(total / weight, 0), 65535)
    return out


def test_bicubic(spark, image):
    got = grid(neighbourhood.bicubic(frame(spark, image), ["b"], (11, 9), (22, 18)), ["b"])[:, :, 0]
    assert (np.abs(got - np.floor(np.round(loop_bicubic(image[:, :, 0], 22, 18), 9))) == 0).all()
    flat = np.full((5, 5, 3), 777)
    assert (grid(neighbourhood.bicubic(frame(spark, flat), ["m"], (5, 5), (13, 7), True), ["m"]) == 777).all()


def test_sequences(spark):
    rng = np.random.default_rng(8)
    diffs = rng.integers(-300, 300, (6, 7))
    df = frame(spark, diffs[:, :, None], ["diff"])
    want = codec.rebuild_phases(diffs, 6, 7, 400)
    assert all(r["value"] == want[r["y"], r["x"]] for r in sequences.phases_sum(df, 400, ["image_id"]).collect())
    rows = np.maximum((np.cumsum(diffs * 200, axis=1) + 32768) % 65536 - 32768, 0)
    assert all(r["value"] == rows[r["y"], r["x"]] for r in sequences.rows_sum(df.withColumn("diff", F.col("diff") * 200), ["y"]).collect())
    total = np.cumsum(diffs.ravel())
    got = sequences.chunked_sum(df.selectExpr("y * 7 + x as i", "diff"), "i", 4).collect()
    assert all(r["total"] == total[r["i"]] for r in got)
    raw = [5, 9, 4095, 0, 77, 1234]
    pairs = spark.createDataFrame([(raw[i], raw[i + 1]) for i in (0, 2, 4)], "a long, b long")
    packed = [v for r in pairs.select(*sequences.pack12(F.col("a"), F.col("b"))).collect() for v in r]
    assert bytes(packed) == codec.pack12(np.array(raw), 9)


def test_bad_pixels(spark, image):
    marks = [3, 5, 9, 0, 0, 4, 0, 7, 1, 2, 0]
    got = badpixels.row_marked(spark.createDataFrame([(1, i, v) for i, v in enumerate(marks)], "g int, pos long, value long"), ["g"]).orderBy("pos").collect()
    assert [(r["y"], r["x"]) for r in got] == [(3, 5), (3, 9), (0, 4), (7, 1), (7, 2)]
    assert badpixels.focus_grid(spark, 15, 3).count() == 340 * 90 - 0 and badpixels.focus_grid(spark, 99, 3) is None
    flat = np.full((9, 9, 3), 500)
    flat[4, 4] = flat[4, 5] = 60000
    bad = spark.createDataFrame([(0, 4, 4), (0, 4, 5), (0, 4, 5)], "image_id long, y long, x long")
    assert (grid(badpixels.inpaint(frame(spark, flat), bad)) == 500).all()
    ramp = np.tile(np.arange(20) * 100.0, (15, 1))
    mask = np.zeros(ramp.shape, bool)
    mask[6:8, 9:11] = True
    assert np.abs(badpixels.fast_march(np.where(mask, 0, ramp), mask) - ramp).max() < 60


def test_gain(spark):
    names = spark.createDataFrame([("SpatialGainsProps_1_INF",), ("SpatialGainsProps_0_MOD",), ("SpatialGainsProps_2.8_31.5",), ("SpatialGainsProps_9_INF",), ("Other",)], "name string")
    got = {r["block"]: (r["bx"], r["by"]) for r in gain.block_places(names, F.lit(30.0), F.lit(280.0), [2.8, 5.6]).collect()}
    assert set(got) == {"SpatialGainsProps_1_INF", "SpatialGainsProps_0_MOD", "SpatialGainsProps_2.8_31.5"}
    assert math.isclose(got["SpatialGainsProps_0_MOD"][1], 1 / (1 / 30 - 1 / 280)) and math.isclose(got["SpatialGainsProps_1_INF"][0], 1 / 5.6)
    corners = [(0, 1.0, 1.0), (1, -1.0, 1.0), (2, -1.0, -3.0), (3, 1.0, -3.0)]
    t = spark.createDataFrame([(1, 7, 0.0, 0.0)], "k int, target int, tx double, ty double")
    b = spark.createDataFrame([(1, i, x, y) for i, x, y in corners] + [(1, 9, 1.0, 1.0)], "k int, idx int, bx double, by double")
    near = gain.nearest_in_quadrants(t, b, ["k"])
    w = {r["q"]: (r["idx"], r["weight"]) for r in gain.quadrant_weights(near, ["k", "target"]).collect()}
    assert w == {0: (0, 0.375), 1: (1, 0.375), 2: (2, 0.125), 3: (3, 0.125)}
    codes = spark.createDataFrame([(1, i, 0, c, 10 * i + c, 1.0, 0.5) for i, _, _ in corners for c in range(2)], "k int, idx int, channel int, cell int, code int, least double, step double")
    merged = {r["cell"]: r["gain"] for r in gain.merge_gain(gain.quadrant_weights(near, ["k", "target"]), codes, ["target"], ["k"]).collect()}
    assert all(math.isclose(merged[c], 1 + 0.5 * (0.375 * 10 + 0.125 * 50 + c), rel_tol=1e-6) for c in range(2))


def test_gain_at_places(spark):
    """Many targets and blocks at few places: each place is compared once, and what has no place comes last."""
    t = spark.createDataFrame([(1, i, i % 7 / 7.0, i % 3 / 3.0) for i in range(500)] * 2 + [(1, 900, None, 0.5), (2, 901, 0.5, 0.5)], "k int, target int, tx double, ty double")
    b = [(i, i % 11 / 11.0, i % 5 / 5.0) for i in range(300)] + [(-1, None, 0.9), (-2, None, -1.0)]
    blocks = spark.createDataFrame([(1, *x) for x in b], "k int, idx int, bx double, by double")
    want = set()
    for i, x, y in {(i, i % 7 / 7.0, i % 3 / 3.0) for i in range(500)}:
        best = {}
        for j, bx, by in b[:300]:
            q = (0 if by > y else 3) if bx > x else 1 if by > y else 2
            best[q] = min(best.get(q, (9.0, 0)), ((bx - x) ** 2 + (by - y) ** 2, j))
        want |= {(i, q, j) for q, (_, j) in best.items()}
    want |= {(900, 1, -1), (900, 2, -2)}
    got = gain.nearest_in_quadrants(t, blocks, ["k"]).collect()
    assert len(got) == len(want) and {(r["target"], r["q"], r["idx"]) for r in got} == want
    assert gain.places(t, ["k"]).count() == 23


def test_geometry(spark, image):
    assert geometry.centre_rect(10, 8, 0, 4) == (0, 0, 9, 7) and geometry.centre_rect(11, 9, 5, 3) == (3, 3, 7, 5)
    assert (grid(geometry.crop(frame(spark, image), (2, 3, 5, 7))) == image[3:8, 2:6]).all()
    p = grid(geometry.preview(frame(spark, image * 16), 11, 9, most=5), "rgb")
    assert p.shape == (3, 3, 3) and p.max() <= 255 and geometry.reduction(10) == 1


def test_matrices():
    m = [2.0, 1.0, 0.5, -1.0, 3.0, 0.25, 0.75, -0.5, 1.5]
    assert np.allclose(np.array(mx.multiply(m, mx.inverse(m))).reshape(3, 3), np.eye(3))
    assert mx.inverse([1.0] * 9) == mx.IDENTITY and mx.transpose(mx.transpose(m)) == m
    assert mx.rational(0.0, 9) == (0, 1) and mx.rational(-0.75, 100) == (-3, 4) and mx.rational(math.pi, 1000) == (355, 113)
    assert mx.space_name("nonsense") == "srgb" and mx.layers_to_xyz(None) is None
    legacy = mx.layers_to_xyz(None, mx.IDENTITY, mx.IDENTITY)
    assert np.allclose(legacy, mx.diagonal(mx.NEUTRAL_XYZ))


def test_neutral_expression(spark):
    from lamina.operators.metadata import neutral_of

    for m in ([2.0, 1.0, 0.5, -1.0, 3.0, 0.25, 0.75, -0.5, 1.5], [1.0] * 9):
        got = spark.range(1).select(*neutral_of([F.lit(x) for x in m])).first()
        assert np.allclose(list(got), mx.raw_neutral(m))


def test_denoise(spark):
    rng = np.random.default_rng(4)
    flat = np.full((24, 28, 3), 2000) + rng.integers(-20, 21, (24, 28, 3))
    out = grid(denoise.denoise(frame(spark, flat)))
    assert out.shape == flat.shape and out[:, :, 0].astype(float).std() < flat[:, :, 0].std()
    whole = grid(denoise.denoise(frame(spark, flat), tile=1024, halo=60))
    assert (grid(denoise.denoise(frame(spark, flat), tile=12, halo=60)) == whole).all()
    v = rng.integers(0, 100, (6, 7)).astype(float)
    assert (denoise.nlm(v, 0) == v).all() and np.allclose(denoise.nlm(np.full((5, 5), 3.0), 10), 3)


def decode(spark, data):
    jvm = spark._jvm
    return jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))


def test_jpeg_and_tiff_open_elsewhere(spark):
    y, x = np.mgrid[0:21, 0:30]
    image = np.stack([x * 8, y * 12, 255 - x * 8], axis=2).astype(np.int64)
    shown = decode(spark, bytearray(images.jpeg(image, 95)))
    got = np.array([[[shown.getRGB(i, j) >> s & 255 for s in (16, 8, 0)] for i in range(30)] for j in range(21)])
    assert np.abs(got - image).mean() < 3
    with pytest.raises(ValueError):
        images.jpeg(image, 0)
    tiff = decode(spark, bytearray(images.tiff16(image * 257, "make", "model", {"exposure": 1 / 125, "iso": 200, "aperture": 2.8})))
    r = tiff.getRaster()
    assert all(r.getSample(i, j, c) == image[j, i, c] * 257 for i in (0, 7, 29) for j in (0, 20) for c in range(3))


def test_dng_layout():
    image = np.arange(70 * 5 * 3).reshape(70, 5, 3) % 65536
    data = images.dng(image, np.zeros((7, 2, 3)), list(mx.SRGB_TO_XYZ), [2.0, 1.0, 0.5], "m", maps=[np.ones((2, 3), np.float32)] * 3)
    import struct

    def tags(at):
        n = struct.unpack_from("<H", data, at)[0]
        return {t: (k, c, v) for t, k, c, v in (struct.unpack_from("<HHII", data, at + 2 + 12 * i) for i in range(n))}

    main = tags(struct.unpack_from("<I", data, 4)[0])
    sub = tags(main[330][2])
    assert list(main) == sorted(main) and sub[257][2] == 70 and sub[273][1] == 3
    first = struct.unpack_from("<I", data, sub[273][2])[0]
    assert data[first : first + 30] == image[0].astype("<u2").tobytes()
    profile = struct.unpack_from("<I", data, main[50933][2])[0]
    assert data[profile : profile + 4] == b"MMCR" and main[50933][1] == len(images.PROFILES) - 1


def test_directory_order():
    d = Directory().add(300, 3, [1]).add(5, 2, "long text").add(7, 5, [(1, 2)])
    data = d.pack(100)
    assert len(data) == d.size() and data[2:4] == b"\5\0" and b"long text\0" in data


def test_develop_and_write(spark, image, tmp_path):
    cal = Calibration(11, 9, dark=((0, 0, 10, 1),), active=(1, 2, 9, 8))
    out = develop(frame(spark, image), cal, Options(denoise=True, tone="none", stops=0.5))
    got = grid(out, "rgb")
    assert got.shape == (7, 9, 3) and got.max() <= 65535
    files = images.write_images(out, f"file://{tmp_path}/out", "ppm").collect()
    text = (tmp_path / "out" / files[0]["file"]).read_text().split("\n")
    assert text[:3] == ["P3", "9 7", "65535"] and text[3].split() == [str(v) for v in got[0, 0]]
    with pytest.raises(ValueError):
        Options(quality=0)
    with pytest.raises(ValueError):
        images.write_images(out, "file:///x", "gif")
