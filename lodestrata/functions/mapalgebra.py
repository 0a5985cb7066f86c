"""Map algebra over band columns; nodata is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Band order of a stacked scene.
STACK_BANDS = ("B02", "B03", "B04", "B08", "B8A", "B11", "B12")
#: Channel means and standard deviations of the six-band chips, in stored units; / 10000 for reflectance.
CHIP_MEANS = (775.2290, 1080.9920, 1228.5855, 2497.2180, 2204.2412, 1610.8815)
CHIP_STDS = (1281.5260, 1270.4814, 1399.4836, 1368.3446, 1291.6764, 1154.5053)


def _float(c: Column, dtype: str) -> Column:
    return c.cast("float") if dtype == "float32" else c


def safe_ratio(n: Column, d: Column, dtype: str = "double") -> Column:
    """n / d; NULL where d is 0 or either is NULL (M1)."""
    return _float(F.try_divide(n.cast("double"), d.cast("double")), dtype)


def normalized_diff(a: Column, b: Column, dtype: str = "double") -> Column:
    """(a - b) / (a + b), as `safe_ratio` (M2)."""
    return safe_ratio(a - b, a + b, dtype)


#: Index -> (kind, first band, second band): scene indices (M3-M8) and thermal-sensor indices.
SCENE_INDICES = {
    "clay_ratio": (safe_ratio, "B11", "B12"),
    "iron_oxide_ratio": (safe_ratio, "B04", "B02"),
    "ferric_iron": (normalized_diff, "B8A", "B04"),
    "ndvi": (normalized_diff, "B08", "B04"),
    "ferrous_iron": (safe_ratio, "B11", "B8A"),
    "clay_swir": (normalized_diff, "B11", "B12"),
}
THERMAL_INDICES = {
    "aloh": (safe_ratio, "B05", "B07"),
    "mgoh": (safe_ratio, "B07", "B08"),
    "silica": (safe_ratio, "B13", "B10"),
    "carbonate": (safe_ratio, "B13", "B14"),
}


def indices(registry: dict, bands: dict[str, Column], dtype: str = "double") -> list[Column]:
    """All indices of a registry whose bands are there, as one projection."""
    return [f(bands[a], bands[b], dtype).alias(name) for name, (f, a, b) in registry.items() if a in bands and b in bands]


def clamped_ratio(n: Column, d: Column) -> Column:
    """n / d with d <= 0 (or NULL) taken as 1e-6, clipped to [-10, 10]; NULL where n is."""
    return F.when(n.isNotNull(), F.least(F.greatest(n / F.when(d > 0, d).otherwise(1e-6), F.lit(-10.0)), F.lit(10.0)))


def reflectance(dn: Column) -> Column:
    return dn / 10000.0  # M16


def standardize(v: Column, mean: float, std: float) -> Column:
    return (v - mean) / std  # M17


def valid_signal(v: Column) -> Column:
    """Finite, within +-100 and not 0."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 100) & (v != 0)


def azimuth(dx: Column, dy: Column) -> Column:
    """Bearing of a line folded to [0, 180)."""
    a = F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))
    return F.when(a >= 180, a - 180).otherwise(a)


def length(dx: Column, dy: Column) -> Column:
    return F.hypot(dx, dy)  # M19


#: Colour map by the first key found in a layer's name.
COLOUR_MAPS = (
    ("ndvi", "RdYlGn"),
    ("clay_ratio", "YlOrBr"),
    ("clay_swir", "YlOrBr"),
    ("iron_oxide", "hot"),
    ("ferric_iron", "hot"),
    ("ferrous_iron", "hot"),
    ("aloh_minerals", "copper"),
    ("mgoh_minerals", "BuGn"),
    ("silica_index", "inferno"),
    ("carbonate_index", "cool"),
)


def guess_colour_map(name: Column, table: tuple = COLOUR_MAPS, default: str = "viridis") -> Column:
    out = F.lit(default)
    for key, value in reversed(table):
        out = F.when(F.lower(name).contains(key), F.lit(value)).otherwise(out)
    return out


def rotate_cell(row: Column, col: Column, n: int, quarter: Column) -> tuple[Column, Column]:
    """Place of a cell of an n x n chip after counter-clockwise quarter turns."""
    r = F.when(quarter == 1, n - 1 - col).when(quarter == 2, n - 1 - row).when(quarter == 3, col).otherwise(row)
    c = F.when(quarter == 1, row).when(quarter == 2, n - 1 - col).when(quarter == 3, n - 1 - row).otherwise(col)
    return r, c


def min_max(v: Column, low: Column, high: Column) -> Column:
    """0 to 1 over [low, high]; 1 where all are equal (A1)."""
    return F.when(high > low, (v - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.when(v.isNotNull(), 1.0))


def stretch(v: Column, low: Column, high: Column, gamma: float = 1.0) -> Column:
    """Percentile stretch of a channel, clipped to [0, 1]; 0 where high <= low; NULL shows white, 1 (A4)."""
    scaled = F.when(high <= low, 0.0).otherwise(F.least(F.greatest((v - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return F.when(v.isNull(), 1.0).otherwise(F.pow(scaled, F.lit(1.0 / gamma)))


#: Band triples of the composites.
PRESETS = {
    "true_color": ("B04", "B03", "B02"),
    "false_color": ("B08", "B04", "B03"),
    "geology_12_8_2": ("B12", "B08", "B02"),
    "geology_8_11_12": ("B08", "B11", "B12"),
    "swir": ("B12", "B8A", "B04"),
    "iron_detection": ("B12", "B04", "B02"),
    "clay_discrimination": ("B12", "B11", "B08"),
}
