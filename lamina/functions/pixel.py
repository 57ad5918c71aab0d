"""Per-pixel column functions: clamps, opponent colour, tone, gamma, quantisation. All stay in codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to the two chroma channels, so that they fit unsigned 16 bits.
CHROMA = 32768
WHITE16 = 65535

Triple = tuple[Column, Column, Column]


def idiv(a: Column, n: int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a.cast("long"), F.lit(n).cast("long"))


def clamp(v: Column, low: float = 0, high: float = WHITE16) -> Column:
    return F.greatest(F.lit(low).cast("double"), F.least(F.lit(high).cast("double"), v.cast("double")))


def clamp16(v: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(WHITE16).cast("long"), v.cast("long")))


def opponent_std(b: Column, m: Column, t: Column) -> Triple:
    """Mean luma with two differences."""
    return clamp16(idiv(b + m + t + 1, 3)), clamp16(2 * b - 2 * t + CHROMA), clamp16(b - 2 * m + t + CHROMA)


def opponent_std_inverse(y: Column, u: Column, v: Column) -> Triple:
    u, v = u - CHROMA, v - CHROMA
    return clamp16(idiv(12 * y + 3 * u + 2 * v + 6, 12)), clamp16(idiv(3 * y - v + 1, 3)), clamp16(idiv(12 * y - 3 * u + 2 * v + 6, 12))


def opponent_top(b: Column, m: Column, t: Column) -> Triple:
    """Luma is the top layer."""
    return clamp16(t), clamp16(2 * b - 2 * t + CHROMA), clamp16(b - 2 * m + t + CHROMA)


def opponent_top_inverse(y: Column, u: Column, v: Column) -> Triple:
    u, v = u - CHROMA, v - CHROMA
    return clamp16(idiv(2 * y + u + 1, 2)), clamp16(idiv(4 * y + u - 2 * v + 2, 4)), clamp16(y)


def opponent_top4(b: Column, m: Column, t: Column) -> Triple:
    """Luma is four times the top layer."""
    return clamp16(4 * t), clamp16(2 * b - 2 * t + CHROMA), clamp16(b - 2 * m + t + CHROMA)


def opponent_top4_inverse(y: Column, u: Column, v: Column) -> Triple:
    u, v = u - CHROMA, v - CHROMA
    return clamp16(idiv(y + 2 * u + 2, 4)), clamp16(idiv(y + u - 2 * v + 2, 4)), clamp16(idiv(y + 2, 4))


def apply_matrix(matrix: list, a: Column, b: Column, c: Column) -> Triple:
    """A row-major 3x3 matrix, of numbers or columns, times a column vector."""
    m = [x if isinstance(x, Column) else F.lit(float(x)) for x in matrix]
    return tuple(m[3 * i] * a + m[3 * i + 1] * b + m[3 * i + 2] * c for i in range(3))  # type: ignore[return-value]


def gamma_power(v: Column, gamma: float) -> Column:
    return F.when(v <= 0, F.lit(0.0)).otherwise(F.pow(v, F.lit(1.0 / gamma)))


def gamma_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1.0 / 2.4)) - 0.055)


def srgb_table(size: int, top: int) -> list[float]:
    """The sRGB curve at ``size`` even steps, scaled to ``top``."""
    curve = lambda x: 12.92 * x if x <= 0.0031308 else 1.055 * x ** (1 / 2.4) - 0.055
    return [min(max(curve(i / (size - 1)) * top, 0.0), float(top)) for i in range(size)]


def table_lookup(v: Column, table: list[float], places: int | None = None) -> Column:
    """Linear interpolation in a table over 0..1, clamped at both ends and rounded; first to so many places, if given, as SQL's round() does."""
    n = len(table)
    cells = F.array([F.lit(float(x)) for x in table])
    at = v * float(n - 1)
    i = F.floor(at)
    inner = F.greatest(F.lit(0), F.least(i, F.lit(n - 2))).cast("int")
    low, high = F.get(cells, inner), F.get(cells, inner + 1)
    value = F.when(i < 0, F.lit(float(table[0]))).when(i >= n - 1, F.lit(float(table[-1]))).otherwise(low + (at - i) * (high - low))
    if places is not None:
        value = F.round(value * 10.0**places) / 10.0**places
    return F.round(value).cast("long")


def tone_aces(v: Column) -> Column:
    return clamp((v * (2.51 * v + 0.03)) / (v * (2.43 * v + 0.59) + 0.14), 0, 1)


AGX_INSET = list(map(float, "0.856627153315983 0.0951212405381588 0.0482516061458583 0.137318972929847 0.761241990602591 0.101439036467562 0.11189821299995 0.0767994186031903 0.811302368396859".split()))
AGX_LOG = (-12.47393, 12.5260688117)


def cube_lookup(r: Column, g: Column, b: Column, size: int, cube: list[tuple[float, float, float]]) -> Triple:
    """Trilinear lookup in a cube of ``size`` steps a side, red fastest; cells outside are zero."""
    out = []
    scaled = [c * float(size - 1) for c in (r, g, b)]
    low = [F.floor(s).cast("int") for s in scaled]
    high = [F.least(x + 1, F.lit(size - 1)) for x in low]
    frac = [s - x for s, x in zip(scaled, low, strict=True)]
    for channel in range(3):
        cells = F.array([F.lit(float(c[channel])) for c in cube])

        def cell(i, j, k, cells=cells):
            at = i + j * size + k * size * size
            return F.when((at < 0) | (at >= len(cube)), F.lit(0.0)).otherwise(F.get(cells, at))

        corner = [[[cell((low, high)[i][0], (low, high)[j][1], (low, high)[k][2]) for k in (0, 1)] for j in (0, 1)] for i in (0, 1)]
        along_r = [[corner[0][j][k] * (1 - frac[0]) + corner[1][j][k] * frac[0] for k in (0, 1)] for j in (0, 1)]
        along_g = [along_r[0][k] * (1 - frac[1]) + along_r[1][k] * frac[1] for k in (0, 1)]
        out.append(along_g[0] * (1 - frac[2]) + along_g[1] * frac[2])
    return tuple(out)  # type: ignore[return-value]


def tone_agx(r: Column, g: Column, b: Column, size: int, cube: list[tuple[float, float, float]]) -> Triple:
    """Log-encoded cube tone map; the cube is the caller's."""
    low, high = AGX_LOG
    inset = apply_matrix(AGX_INSET, r, g, b)
    encoded = [F.when(x <= 0, F.lit(0.0)).otherwise(clamp((F.log2(x) - low) / (high - low), 0, 1)) for x in inset]
    return tuple(clamp(F.pow(x, F.lit(2.2)), 0, 1) for x in cube_lookup(*encoded, size, cube))  # type: ignore[return-value]


def tone_map(rgb: Triple, method: str, cube: tuple[int, list] | None = None) -> Triple:
    """``aces``, ``agx`` (needs a cube) or ``none``; any other name means agx, as without a cube aces."""
    name = method.lower()
    if name == "none":
        return rgb
    if name == "aces" or cube is None:
        return tuple(tone_aces(c) for c in rgb)  # type: ignore[return-value]
    return tone_agx(*rgb, *cube)


def exposure(v: Column, stops: float) -> Column:
    return v * float(2.0**stops)


def to_uint8(v: Column) -> Column:
    return F.floor(clamp(v * 255 + 0.5, 0, 255)).cast("long")


def to_uint16(v: Column) -> Column:
    return F.floor(clamp(v * 65535 + 0.5, 0, 65535)).cast("long")


def develop(rgb: Triple, stops: float = 0.0, tone: str = "aces", gamma: float = 2.2, cube: tuple[int, list] | None = None) -> Triple:
    """Exposure, tone, gamma, in this order, on 0..1 values."""
    if stops:
        rgb = tuple(exposure(c, stops) for c in rgb)  # type: ignore[assignment]
    rgb = tone_map(rgb, tone, cube)
    return tuple(gamma_power(c, gamma) for c in rgb) if gamma > 0 else rgb  # type: ignore[return-value]


def to_linear_srgb(rgb: Triple, matrix: list, bias: Column, tops: Triple) -> Triple:
    """Intermediate values to linear sRGB in 0..65535: normalise, one fused matrix, clamp, truncate."""
    unit = [(v - bias) / (top - bias) for v, top in zip(rgb, tops, strict=True)]
    return tuple(F.floor(clamp(v * 65535.0)).cast("long") for v in apply_matrix(matrix, *unit))  # type: ignore[return-value]


def wrap16(v: Column) -> Column:
    """A running value as a signed 16-bit register holds it."""
    return F.pmod(v + 32768, F.lit(65536)) - 32768


def first_of(*found: Column) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), found)
