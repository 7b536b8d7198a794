"""Per-cell algebra: reflectance, spectral indices, validity, water rule, radar decibels, stretches, scaled storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.schema import INDEX_LIMIT, INDEX_SCALE, SCL_REJECT, SCL_WATER, WATER_RELAX, fails_if_null, ratio

# Thresholds of the surface classes.
NDVI_VEG, NDVI_SPARSE, NDMI_WET, BSI_BARE = 0.30, 0.15, 0.10, 0.10


def reflectance(dn: Column, offset: Column | float = 0.0, quantification: float = 10000.0) -> Column:
    """Bottom-of-atmosphere reflectance; a band without an offset has offset 0."""
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    return (dn + F.coalesce(offset, F.lit(0.0))) / F.lit(quantification)


def normalized_difference(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def spectral_indices(green="b03", red="b04", blue="b02", nir="b08", swir1="b11", swir2="b12") -> dict[str, Column]:
    """Seven indices from reflectances, NULL where a denominator is 0."""
    g, r, b, n, s1, s2 = (F.col(x) for x in (green, red, blue, nir, swir1, swir2))
    return {
        "ndvi": normalized_difference(n, r),
        "ndwi": normalized_difference(g, n),
        "mndwi": normalized_difference(g, s1),
        "ndmi": normalized_difference(n, s1),
        "bsi": ratio((s1 + r) - (n + b), (s1 + r) + (n + b)),
        "aweish": b + 2.5 * g - 1.5 * (n + s1) - 0.25 * s2,
        "ndti": normalized_difference(r, g),
    }


def moisture_indices(nir="b08", swir1="b11", swir2="b12") -> dict[str, Column]:
    n, s1, s2 = F.col(nir), F.col(swir1), F.col(swir2)
    return {"msi": ratio(s1, n), "ndmi11": normalized_difference(n, s1), "ndmi12": normalized_difference(n, s2), "swir_ratio": ratio(s1, s2)}


def is_valid(scl: Column, green: Column) -> Column:
    """A scene class that counts as seen, and a positive finite reflectance; never NULL."""
    return F.coalesce(~scl.isin(*SCL_REJECT) & (green > 0) & ~F.isnan(green) & (green != float("inf")), F.lit(False))


def water_rule(ndwi: Column, mndwi: Column, scl: Column, valid: Column, ndwi_least: float = 0.0, mndwi_least: float = 0.0) -> Column:
    """Both indices above their thresholds, or the scene class water with a relaxed one; a rejected class vetoes either."""
    a, b = fails_if_null(ndwi, -9.0), fails_if_null(mndwi, -9.0)
    clear = ~F.coalesce(scl.isin(*SCL_REJECT), F.lit(False))
    water = ((a > ndwi_least) & (b > mndwi_least)) | (F.coalesce(scl == SCL_WATER, F.lit(False)) & (a > ndwi_least - WATER_RELAX))
    return water & clear & valid


def three_valued(water: Column, valid: Column) -> Column:
    """Water, not water, or NULL where not observed."""
    return F.when(valid, water)


def to_decibel(power: Column) -> Column:
    """10 log10 of a positive power; anything else is undefined, not floored."""
    return F.when((power > 0) & ~F.isnan(power), 10 * F.log10(power))


def to_scaled(x: Column, valid: Column | None = None, scale: float = INDEX_SCALE) -> Column:
    """A scaled 16-bit integer, half to even, clipped to its range; NULL where undefined or not valid."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    keep = finite if valid is None else finite & valid
    return F.when(keep, F.greatest(F.least(F.rint(x * scale), F.lit(float(INDEX_LIMIT))), F.lit(float(-INDEX_LIMIT))).cast("int"))


def stretch_to_byte(x: Column, valid: Column, low: float = 0.0, high: float = 0.30, gamma: float = 1.0) -> Column:
    """Reflectance low..high on 0..255 with a gamma; 0 where not valid."""
    if high <= low:
        raise ValueError("high must be above low")
    y = F.greatest(F.least((x - low) / (high - low), F.lit(1.0)), F.lit(0.0))
    y = F.pow(y, F.lit(gamma)) if gamma != 1.0 else y
    return F.when(F.coalesce(valid, F.lit(False)) & y.isNotNull(), F.rint(y * 255).cast("int")).otherwise(F.lit(0))


def depth(surface: Column, ground: Column) -> Column:
    """Water depth where the surface is above the ground, else NULL."""
    return F.when(surface > ground, surface - ground)
