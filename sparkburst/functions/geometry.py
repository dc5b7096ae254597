"""Spherical geometry and naming as column expressions; degrees in and out, separations in arcseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    r, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    sd, sr = F.sin(F.radians(dec2 - dec1) / 2), F.sin(F.radians(ra2 - ra1) / 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), sd * sd + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * sr * sr)))) * 3600


def offsets(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> tuple[Column, Column]:
    return (ra1 - ra2) * F.cos(F.radians(dec1)), dec1 - dec2


Pair = tuple[float | Column, float | Column]


def wcs(headers: Column, bin_size: float = 80.0) -> dict[str, Column]:
    """The constants of an image of ``bin_size`` sky units a pixel, from a map of header cards."""
    card = lambda name: F.element_at(headers, F.lit(name)).cast("double")
    out = {}
    for axis, name in (("x", "REFX"), ("y", "REFY")):
        out |= {f"crval_{axis}": card(f"{name}CRVL"), f"crpix_{axis}": card(f"{name}CRPX") / bin_size, f"cdelt_{axis}": card(f"{name}CDLT") * bin_size, f"naxis_{axis}": card(f"{name}LMAX") / bin_size}
    return out


def pixel_to_sky(px: Column, py: Column, crpix: Pair, cdelt: Pair, crval: Pair) -> tuple[Column, Column]:
    """De-projection of a tangent plane (0-based pixels); the constants are numbers or columns."""
    xi, eta = F.radians((px + 1 - crpix[0]) * cdelt[0]), F.radians((py + 1 - crpix[1]) * cdelt[1])
    d0 = F.radians(_column(crval[1]))
    down = F.cos(d0) - eta * F.sin(d0)
    ra = F.degrees(F.atan2(xi, down)) + crval[0]
    return F.pmod(ra, F.lit(360.0)), F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + down * down)))


def _column(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def sky_to_pixel(ra: Column, dec: Column, crpix: Pair, cdelt: Pair, crval: Pair) -> tuple[Column, Column]:
    d, d0, dr = F.radians(dec), F.radians(_column(crval[1])), F.radians(ra - crval[0])
    den = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(dr)
    xi = F.cos(d) * F.sin(dr) / den
    eta = (F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(dr)) / den
    return F.degrees(xi) / cdelt[0] + crpix[0] - 1, F.degrees(eta) / cdelt[1] + crpix[1] - 1


def offset_by(ra: Column, dec: Column, angle: float, distance_deg: Column) -> tuple[Column, Column]:
    """The point at a position angle and distance."""
    a, s, d = F.radians(F.lit(angle)), F.radians(distance_deg), F.radians(dec)
    sin_d = F.sin(d) * F.cos(s) + F.cos(d) * F.sin(s) * F.cos(a)
    dra = F.atan2(F.sin(a) * F.sin(s) * F.cos(d), F.cos(s) - F.sin(d) * sin_d)
    return F.pmod(ra + F.degrees(dra), F.lit(360.0)), F.degrees(F.asin(sin_d))


def rotate(x: Column, y: Column, angle: Column, pivot: float = 25719.0) -> tuple[Column, Column]:
    """Rotation about the pivot by minus the angle (degrees)."""
    c, s = F.cos(F.radians(-angle)), F.sin(F.radians(-angle))
    return pivot + (x - pivot) * c - (y - pivot) * s, pivot + (x - pivot) * s + (y - pivot) * c


def to_galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    """Galactic longitude and latitude (J2000 pole 192.85948, 27.12825; node 122.93192: fixed values)."""
    r, d, dp = F.radians(ra - 192.85948), F.radians(dec), F.radians(F.lit(27.12825))
    b = F.asin(F.sin(d) * F.sin(dp) + F.cos(d) * F.cos(dp) * F.cos(r))
    longitude = 122.93192 - F.degrees(F.atan2(F.cos(d) * F.sin(r), F.sin(d) * F.cos(dp) - F.cos(d) * F.sin(dp) * F.cos(r)))
    return F.pmod(longitude, F.lit(360.0)), F.degrees(b)


def iau_name(ra: Column, dec: Column, prefix: str = "J") -> Column:
    """J hhmmss.s±ddmmss, truncated as the convention asks; tenths of a second are counted as whole numbers."""
    tenths = F.floor(F.round(ra / 15 * 36000, 4)).cast("long")
    seconds = F.floor(F.round(F.abs(dec) * 3600, 4)).cast("long")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    hours = F.concat(two(F.floor(tenths / 36000)), two(F.floor(tenths / 600) % 60), two(F.floor(tenths / 10) % 60), F.lit("."), (tenths % 10).cast("string"))
    degrees = F.concat(F.when(dec < 0, "-").otherwise("+"), two(F.floor(seconds / 3600)), two(F.floor(seconds / 60) % 60), two(seconds % 60))
    return F.concat(F.lit(prefix), hours, degrees)
