"""3x3 colour algebra on the driver (row-major lists of nine), and the constants."""

from __future__ import annotations

import numpy as np



def _nine(numbers: str) -> list[float]:
    return list(map(float, numbers.split()))


SRGB_TO_XYZ = _nine("0.4124564 0.3575761 0.1804375 0.2126729 0.7151522 0.0721750 0.0193339 0.1191920 0.9503041")
XYZ_TO_SRGB = _nine("3.2404542 -1.5371385 -0.4985314 -0.9692660 1.8760108 0.0415560 0.0556434 -0.2040259 1.0572252")
ADOBE_TO_XYZ = _nine("0.5767309 0.1855540 0.1881852 0.2973769 0.6273491 0.0752741 0.0270343 0.0706872 0.9911085")
XYZ_TO_ADOBE = _nine("2.0413690 -0.5649464 -0.3446944 -0.9692660 1.8760108 0.0415560 0.0134474 -0.1183897 1.0154096")
PROPHOTO_TO_XYZ = _nine("0.7976749 0.1351917 0.0313534 0.2880402 0.7118741 0.0000857 0.0 0.0 0.8252100")
XYZ_TO_PROPHOTO = _nine("1.3459433 -0.2556075 -0.0511118 -0.5445989 1.5081673 0.0205351 0.0 0.0 1.2118128")
D65_TO_D50 = _nine("1.0478112 0.0228866 -0.0501270 0.0295424 0.9904844 -0.0170491 -0.0092345 0.0150436 0.7521316")
D50_TO_D65 = _nine("0.9555766 -0.0230393 0.0631636 -0.0282895 1.0099416 0.0210077 0.0122982 -0.0204830 1.3299098")
D65_WHITE, D50_WHITE = [0.95047, 1.0, 1.08883], [0.96422, 1.0, 0.82521]
NEUTRAL_XYZ = [0.950456, 1.0, 1.089058]
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
GAMMAS = {"srgb": 2.2, "adobergb": 2.2, "prophoto": 1.8, "none": 1.0}


def multiply(a: list[float], b: list[float]) -> list[float]:
    return [sum(a[3 * i + k] * b[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]


def apply(m: list[float], v: list[float]) -> list[float]:
    return [m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)]


def determinant(m: list[float]) -> float:
    return float(np.linalg.det(np.reshape(m, (3, 3))))


def inverse(m: list[float]) -> list[float]:
    """The inverse; the identity where the determinant is under 1e-10."""
    if abs(determinant(m)) < 1e-10:
        return list(IDENTITY)
    return np.linalg.inv(np.reshape(m, (3, 3))).ravel().tolist()


def transpose(m: list[float]) -> list[float]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def diagonal(v: list[float]) -> list[float]:
    return np.diag(v).ravel().tolist()


def scale(m: list[float], s: float) -> list[float]:
    return [x * s for x in m]


def add(a: list[float], b: list[float]) -> list[float]:
    return [x + y for x, y in zip(a, b, strict=True)]


def component_multiply(a: list[float], b: list[float]) -> list[float]:
    return [x * y for x, y in zip(a, b, strict=True)]


def invert_components(v: list[float]) -> list[float]:
    return [1.0 / x for x in v]


def clamp_components(v: list[float], low: float, high: float) -> list[float]:
    return [min(max(x, low), high) for x in v]


def raw_neutral(raw_to_xyz: list[float]) -> list[float]:
    return apply(inverse(raw_to_xyz), NEUTRAL_XYZ)


def layers_to_xyz(correction: list[float] | None, illuminant: list[float] | None = None, wb_correction: list[float] | None = None) -> list[float] | None:
    """From a colour correction, or by the legacy way from an illuminant and its correction."""
    if correction is not None:
        return multiply(SRGB_TO_XYZ, correction)
    if illuminant is not None and wb_correction is not None:
        raw = multiply(wb_correction, illuminant)
        return multiply(raw, diagonal(raw_neutral(raw)))
    return None


def raw_to_xyz(layers: list[float], gain: list[float]) -> list[float]:
    return multiply(layers, diagonal(gain))


def forward_camera(layers: list[float]) -> list[float]:
    return multiply(D65_TO_D50, layers)


def forward_srgb() -> list[float]:
    return multiply(D65_TO_D50, SRGB_TO_XYZ)


def forward_greyscale(mix: list[float]) -> list[float]:
    return multiply(diagonal(D50_WHITE), multiply([1.0] * 9, diagonal(mix)))


def calibration(gain: list[float]) -> list[float]:
    return diagonal(invert_components(gain))


def space_name(name: str) -> str:
    """Canonical colour space; anything unknown is sRGB."""
    low = name.lower()
    return {"prophotorgb": "prophoto"}.get(low, low) if low in ("none", "srgb", "adobergb", "prophoto", "prophotorgb") else "srgb"


def xyz_to_space(name: str) -> list[float]:
    return {"srgb": XYZ_TO_SRGB, "adobergb": XYZ_TO_ADOBE, "prophoto": multiply(XYZ_TO_PROPHOTO, D65_TO_D50)}.get(space_name(name), IDENTITY)


def rational(value: float, most: int) -> tuple[int, int]:
    """Best fraction by continued fractions with a bounded denominator, at most 50 steps."""
    if value == 0:
        return 0, 1
    sign, z = (-1, -value) if value < 0 else (1, value)
    n0, d0, n1, d1 = 0, 1, 1, 0
    for _ in range(50):
        a = int(z)
        n2, d2 = n1 * a + n0, d1 * a + d0
        if d2 > most:
            break
        n0, d0, n1, d1 = n1, d1, n2, d2
        if z == a:
            break
        z = 1.0 / (z - a)
    return sign * n1, d1
