"""Scalar functions of the risk model as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def saturation_hpa(kelvin: ColumnOrName) -> Column:
    """Magnus saturation vapour pressure."""
    t = _c(kelvin) - 273.15
    return 6.112 * F.exp(17.67 * t / (t + 243.5))


def vpd_hpa(t_k: ColumnOrName, td_k: ColumnOrName) -> Column:
    """Vapour pressure deficit, never negative."""
    return F.greatest(saturation_hpa(t_k) - saturation_hpa(td_k), F.lit(0.0))


def relative_humidity(t_k: ColumnOrName, td_k: ColumnOrName) -> Column:
    return F.least(F.greatest(100.0 * saturation_hpa(td_k) / saturation_hpa(t_k), F.lit(0.0)), F.lit(100.0))


def wind_speed(u: ColumnOrName, v: ColumnOrName) -> Column:
    return F.sqrt(_c(u) * _c(u) + _c(v) * _c(v))


def wind_direction(u: ColumnOrName, v: ColumnOrName) -> Column:
    return F.atan2(_c(v), _c(u))


def south_exposure(aspect_deg: ColumnOrName) -> Column:
    """1 facing south, 0 facing north; null stays null."""
    return (1 - F.cos(F.radians(_c(aspect_deg)))) / 2


def wui_class(vegetation: ColumnOrName, density: ColumnOrName, veg_min: float, dense_min: float) -> Column:
    """1 interface, 2 intermix, 0 neither."""
    wild = _c(vegetation) >= veg_min
    return F.when(wild & (_c(density) >= dense_min), 1).when(wild & (_c(density) < dense_min), 2).otherwise(0)


def reclassify(code: ColumnOrName, wanted: list[int], nodata: int = 0, nodata_as: int = 255) -> Column:
    """1 for wanted codes, ``nodata_as`` for nodata, else 0."""
    return F.when(_c(code).isin(wanted), 1).when(_c(code) == nodata, nodata_as).otherwise(0)


def winsorise(x: ColumnOrName, low, high) -> Column:
    return F.greatest(F.least(_c(x), F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low)


def cell_id(lat: ColumnOrName, lon: ColumnOrName) -> Column:
    return F.replace(F.format_string("LAT%.1f_LON%.1f", _c(lat), _c(lon)), F.lit("."), F.lit("p"))


def event_id(date: ColumnOrName, ordinal: ColumnOrName, prefix: str = "EFFIS") -> Column:
    """prefix_yyyymmdd_nnn."""
    return F.concat(F.lit(f"{prefix}_"), F.regexp_replace(_c(date).cast("string"), "-", ""), F.lit("_"), F.lpad(_c(ordinal).cast("string"), 3, "0"))


def circle_radius_m(area_km2: ColumnOrName) -> Column:
    return F.sqrt(_c(area_km2) * 1e6 / F.pi())


def grid_snap(x: ColumnOrName, tolerance: float) -> Column:
    """Cell index, halves to even."""
    return F.rint(_c(x) / tolerance).cast("long")


def https_of_s3(url: ColumnOrName, region: str) -> Column:
    """s3://bucket/key as the https address of the bucket in ``region``; other addresses are left alone."""
    return F.regexp_replace(_c(url), r"^s3://([^/]+)/?(.*)$", f"https://$1.s3.{region}.amazonaws.com/$2")


def grade(auc: ColumnOrName, target: float = 0.70, failure: float = 0.60) -> Column:
    return F.when(_c(auc) >= target, "PASS").when(_c(auc) >= failure, "WARN").otherwise("FAIL")


def false_negative(burned: ColumnOrName, risk_class: ColumnOrName) -> Column:
    return _c(burned) & (_c(risk_class) <= 2)


def false_positive(burned: ColumnOrName, risk_class: ColumnOrName) -> Column:
    return ~_c(burned) & (_c(risk_class) >= 4)


def null_of_nan(x: ColumnOrName) -> Column:
    return F.when(~F.isnan(_c(x)), _c(x))


def row_mean(*columns: ColumnOrName) -> Column:
    """Mean of the columns that are not null; null if none is."""
    total = sum((F.coalesce(_c(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    count = sum((_c(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, count)


def circular_std(angle: ColumnOrName) -> Column:
    """Aggregate: sqrt(-2 ln R), R within [1e-10, 1]."""
    r = F.sqrt(F.avg(F.sin(_c(angle))) * F.avg(F.sin(_c(angle))) + F.avg(F.cos(_c(angle))) * F.avg(F.cos(_c(angle))))
    return F.sqrt(-2.0 * F.ln(F.least(F.greatest(r, F.lit(1e-10)), F.lit(1.0))))


#: Building tag by use.
USES = {
    "residential": "house detached semidetached_house terrace apartments residential bungalow dormitory flats villa",
    "commercial": "commercial retail office supermarket hotel shop kiosk",
    "civic": "public civic government hospital school university church chapel mosque monastery cathedral fire_station police library sports_hall stadium",
    "industrial": "industrial warehouse factory storage_tank storage",
    "agricultural": "barn farm farm_auxiliary greenhouse silo stable",
    "utility": "utility transformer_tower water_tower substation",
}
#: Amenities that make an untyped building civic.
CIVIC_AMENITIES = "hospital clinic school university college fire_station police library place_of_worship".split()


def building_use(building: ColumnOrName, amenity: ColumnOrName) -> Column:
    """Use by tag, case-insensitive; generic tags fall back to the amenity."""
    tag = F.lower(_c(building))
    out = F.when(_c(amenity).isin(CIVIC_AMENITIES), "civic").otherwise("unknown")
    for use, tags in USES.items():
        out = F.when(tag.isin(tags.split()), use).otherwise(out)
    return out


def redistributed(weights: dict[str, float], present: list[str]) -> dict[str, float]:
    """Weights of the present groups, scaled to one."""
    total = sum(weights[g] for g in present)
    return {g: weights[g] / total for g in present}


def redistributed_weights(weights: dict[str, float]) -> dict[str, Column]:
    """The same row by row: the weight of each column's group among those whose column has a value; null where the column has none."""
    total = sum(F.when(F.col(g).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for g, w in weights.items())
    return {g: F.when(F.col(g).isNotNull(), F.lit(w) / total) for g, w in weights.items()}
