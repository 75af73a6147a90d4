"""Physics, geography and text as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cell_area_km2(lat: Column, degrees: float) -> Column:
    side = degrees * 111.32
    return side * side * F.cos(F.radians(lat))


def shoelace(xs: Column, ys: Column) -> Column:
    """Area of a ring given as two arrays; the last vertex joins the first."""
    n = F.size(xs)
    nxt = lambda a, i: F.element_at(a, (F.pmod(i + 1, n) + 1).cast("int"))
    terms = F.transform(xs, lambda x, i: x * nxt(ys, i) - nxt(xs, i) * F.element_at(ys, i + 1))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2


def point_in_ring(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Ray casting against a ring of two arrays."""
    n = F.size(xs)

    def crosses(xi: Column, i: Column) -> Column:
        j = (F.pmod(i + 1, n) + 1).cast("int")
        yi, xj, yj = F.element_at(ys, i + 1), F.element_at(xs, j), F.element_at(ys, j)
        return F.when(((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / F.when(yj != yi, yj - yi) + xi), 1).otherwise(0)

    return F.aggregate(F.transform(xs, crosses), F.lit(0), lambda a, k: a + k) % 2 == 1


def ring_centroid(xs: Column, ys: Column) -> tuple[Column, Column]:
    """Mean of a ring's vertices."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return mean(xs), mean(ys)


def line_in_ring(line_xs: Column, line_ys: Column, xs: Column, ys: Column) -> Column:
    """Whether a line has a vertex inside a ring."""
    return F.exists(F.arrays_zip(line_xs.alias("x"), line_ys.alias("y")), lambda p: point_in_ring(p["x"], p["y"], xs, ys))


def first_ring(x: Column, y: Column, rings: Sequence[tuple[object, Sequence[float], Sequence[float]]]) -> Column:
    """Name of the first of a few rings that holds a point; null outside all."""
    out = F.lit(None)
    for name, xs, ys in reversed(rings):
        inside = point_in_ring(x, y, F.array(*map(F.lit, map(float, xs))), F.array(*map(F.lit, map(float, ys))))
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def cyclical(x: Column, period: float) -> tuple[Column, Column]:
    return F.sin(2 * math.pi * x / period), F.cos(2 * math.pi * x / period)


def hours_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) * 24


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution; absolute error below 1.5e-7 (a published polynomial for erf)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def fragility(im: Column, median: Column, beta: Column) -> Column:
    """Probability of a damage state at an intensity; 0 at none."""
    return F.when(im > 0, normal_cdf((F.log(im) - F.log(median)) / beta)).otherwise(0.0)


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[float], outside: float | None = None) -> Column:
    """Piecewise linear through knots; beyond them the end values, or ``outside``."""
    out = F.when(x < xs[0], float(ys[0] if outside is None else outside))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return out.otherwise(float(ys[-1] if outside is None else outside))


def wind_capacity_factor(speed: Column, speeds: Sequence[float], power: Sequence[float]) -> Column:
    """By a turbine's power curve as shares of rated power; 0 outside it."""
    return interpolate(speed, speeds, power, outside=0.0)


def air_density_speed(speed: Column, density: Column, reference: float = 1.225) -> Column:
    return speed * F.pow(density / reference, 1.0 / 3)


def power_law(speed: Column, height: float, target: float, exponent: Column | float) -> Column:
    return speed * F.pow(F.lit(target / height), exponent)


def shear_exponent(v1: Column, v2: Column, h1: float, h2: float) -> Column:
    return F.log(v2 / v1) / math.log(h2 / h1)


def weibull_pdf(speed: Column, shape: float, scale: float) -> Column:
    """Density of wind speeds; 0 without wind."""
    x = speed / scale
    return F.when(speed > 0, shape / scale * F.pow(x, shape - 1) * F.exp(-F.pow(x, F.lit(shape)))).otherwise(0.0)


def weibull_power_density(scale: Column, shape: float, density: float = 1.225) -> Column:
    """Mean power of the wind in W a square metre."""
    return 0.5 * density * math.gamma(1 + 3 / shape) * F.pow(scale, F.lit(3.0))


def wake_deficit(ct: Column, distance: Column, radius: float, k: float = 0.075) -> Column:
    """Jensen's loss of speed behind a rotor."""
    return (1 - F.sqrt(1 - ct)) / F.pow(1 + k * distance / radius, 2)


def solar_capacity_factor(irradiance: Column, performance: float = 0.8) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), irradiance / 1000 * performance))


def cell_temperature(air: Column, irradiance: Column, noct: float = 45.0) -> Column:
    return air + (noct - 20) / 800 * irradiance


def temperature_derate(cell: Column, coefficient: float = -0.004) -> Column:
    return 1 + coefficient * (cell - 25)


def climate_availability(value: Column, kind: str, ghi: float = 0.0, wind: float = 0.0, warming: float = 0.0, coefficient: float = 0.004) -> Column:
    """Availability under shares of change: sun and heat for solar, wind for wind, nothing for others; within 0 and 1."""
    factor = (1 + ghi) * (1 - coefficient * warming) if kind == "solar" else 1 + wind if kind == "wind" else 1.0
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value * factor))


def otec_capacity_factor(difference: Column, nominal: float, design: float) -> Column:
    """Linear in the difference of water temperatures, up to 1.2 times nominal."""
    return nominal * F.least(F.lit(1.2), F.greatest(F.lit(0.0), difference / design)) if design > 0 else F.lit(nominal)


def hydro_shape(t: Column, latitude: float) -> Column:
    """Run of a river over a year, ``t`` from 0 to 1: one peak in late spring, two wet seasons near the equator."""
    if abs(latitude) < 10:
        raw = 0.5 + 0.4 * F.sin(2 * math.pi * (t - 0.30)) + 0.3 * F.sin(4 * math.pi * (t - 0.05))
    else:
        raw = 0.6 + 0.5 * F.cos(2 * math.pi * (t - (0.40 if latitude >= 0 else 0.90)))
    return F.least(F.lit(1.5), F.greatest(F.lit(0.05), raw))


def degree_days(temperature: Column, heat_base: float = 18.0, cool_base: float = 24.0) -> tuple[Column, Column]:
    return F.greatest(heat_base - temperature, F.lit(0.0)), F.greatest(temperature - cool_base, F.lit(0.0))


def carnot(cold_c: Column, hot_c: Column) -> Column:
    return 1 - (cold_c + 273.15) / (hot_c + 273.15)


def logistic(t: Column, ceiling: Column | float, rate: float, midpoint: float) -> Column:
    return F.lit(ceiling) / (1 + F.exp(-rate * (t - midpoint))) if not isinstance(ceiling, Column) else ceiling / (1 + F.exp(-rate * (t - midpoint)))


def bass(t: Column, market: float, innovation: float, imitation: float) -> Column:
    """Cumulative adopters after ``t`` years."""
    e = F.exp(-(innovation + imitation) * t)
    return market * (1 - e) / (1 + imitation / innovation * e)


def cost_blocks(low: Column, high: Column, n: int) -> Column:
    """Midpoint prices of ``n`` blocks of a linear cost curve, to six decimals."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(low + (high - low) * (i + 0.5) / n, 6))


# Text.


def strip_investment(name: Column) -> Column:
    """A unit's name without the mark of an investment and without a number in brackets."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, "^Investment ", ""), r"\s*\(\d+\)$", ""))


def plain_name(name: Column) -> Column:
    """Lower case, no accents, no unit suffix, single blanks."""
    flat = F.translate(F.lower(name), "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"\b(unit|block|u)\s*\d+\b", " "), "[^a-z0-9]+", " "))


def voltage_kv(tag: Column) -> Column:
    """Greatest voltage in kV of a tag such as ``220000;110000``; null where nothing is a number."""
    volts = F.transform(F.split(tag, ";"), lambda v: F.try_to_number(F.trim(v), F.lit("999999999")).cast("double"))
    return F.array_max(F.filter(volts, lambda v: v.isNotNull())) / 1000


def capacity_mw(tag: Column) -> Column:
    """``1.5 GW``, ``300 MW``, ``20 kW`` or a bare number of MW."""
    number = F.regexp_extract(tag, r"([0-9]+(?:\.[0-9]+)?)", 1)
    factor = F.when(F.lower(tag).contains("gw"), 1000.0).when(F.lower(tag).contains("kw"), 0.001).otherwise(1.0)
    return F.when(number != "", number.cast("double") * factor)


def fuel_name(name: Column) -> Column:
    n = F.trim(F.replace(F.lower(name), F.lit("_"), F.lit(" ")))
    return F.when(n.isin("gas", "natural gas", "ng", "lng"), "Natural Gas").when(n.isin("oil", "diesel", "fuel oil", "hfo"), "Oil").when(n.contains("coal"), "Coal").when(n.isin("sun", "solar", "pv"), "Solar").when(n.contains("wind"), "Wind").when(n.isin("hydro", "water"), "Hydro").otherwise(F.initcap(n))


#: Overhead line types by nominal kV: ohm/km, ohm/km, nF/km.
LINE_TYPES = (
    (33.0, 0.250, 0.400, 8.5), (66.0, 0.150, 0.400, 8.8), (110.0, 0.095, 0.380, 9.2), (132.0, 0.090, 0.370, 9.3), (220.0, 0.060, 0.301, 12.5),
    (300.0, 0.040, 0.265, 13.2), (380.0, 0.030, 0.246, 13.8), (500.0, 0.020, 0.270, 13.0), (750.0, 0.013, 0.276, 13.1),
)


def line_parameters(voltage: Column) -> Column:
    """r, x (ohm/km) and b (microsiemens/km at 50 Hz) of the line type of the nearest voltage; 110 kV where there is none."""
    v = F.when(voltage > 0, voltage).otherwise(110.0)
    types = F.array(*(F.struct(F.abs(v - t[0]).alias("d"), F.lit(k).alias("k"), F.lit(t[1]).alias("r"), F.lit(t[2]).alias("x"), F.lit(100 * math.pi * t[3] * 1e-3).alias("b")) for k, t in enumerate(LINE_TYPES)))
    return F.array_min(types)


def technology_class(fuel: Column, hint: Column, capacity: Column, small_gas_mw: float = 100.0) -> Column:
    """Technology of a plant by its fuel, a hint and, for gas, its size."""
    has = lambda *words: F.lower(F.coalesce(hint, F.lit(""))).rlike("|".join(words))
    plain = {"sun": "PV", "coal": "Coal ST", "fuel_oil": "Oil ST", "nuclear": "Nuclear", "biomass": "Biomass ST", "biogas": "Biogas Engine", "waste": "Waste-to-Energy", "geothermal": "Geothermal"}
    out = F.when(fuel == "wind", F.when(has("offshore"), "Offshore Wind").otherwise("Onshore Wind"))
    out = out.when(fuel == "water", F.when(has("pump"), "Pumped Storage").when(has("run", "ror"), "Run-Of-River").otherwise("Reservoir"))
    gas = F.when(has("ocgt", "open", "peak"), "OCGT").when(has("ccgt", "combined"), "CCGT").when((capacity > 0) & (capacity < small_gas_mw), "OCGT").otherwise("CCGT")
    out = out.when(fuel == "naturalgas", gas).when(fuel == "diesel", F.when(has("steam", "boiler"), "Oil ST").otherwise("Combustion Engine"))
    for name, technology in plain.items():
        out = out.when(fuel == name, technology)
    return out.otherwise("Other")


def safe_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit(" - "))


def number_list(text: Column) -> Column:
    """A JSON number or list of numbers as an array."""
    return F.coalesce(F.from_json(text, "array<double>"), F.when(text.try_cast("double").isNotNull(), F.array(text.try_cast("double"))))
