"""Scalar radar arithmetic as Column expressions. Null in, null out; nothing here needs Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius, the 4/3 model, and the beam-height radius of the wind-profile code.
EARTH_RADIUS_M = 6_371_000.0
EFFECTIVE_RADIUS_M = EARTH_RADIUS_M * 4 / 3
BEAM_RADIUS_M = 8.49e6
MERCATOR_LATITUDE = 85.05112878
METRES_PER_DEGREE = 111_320.0
VOLUME_TOP_M = 20_668.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(x: float) -> Column:
    return F.lit(float(x))


# -- velocity ----------------------------------------------------------------------------------


def decode_value(code: Column | str, scale: Column | float, offset: Column | float) -> Column:
    """Value of a raw gate code."""
    return ((col(code) - offset) / scale).cast("float")


def valid_code(moment: Column | str, code: Column | str) -> Column:
    """0 is below threshold for all moments; 1, range folded, is dropped for velocity alone."""
    return (col(code) != 0) & ~((col(moment) == "VEL") & (col(code) == 1))


def fold_velocity(v: Column | str, nyquist: Column | str) -> Column:
    """v folded into [-Vn, Vn)."""
    v, n = col(v), col(nyquist)
    return F.pmod(v + n, 2 * n) - n


def principal(v: Column | str, nyquist: Column | str) -> Column:
    """The same interval by way of floor."""
    v, n = col(v), col(nyquist)
    return v - 2 * n * F.floor((v + n) / (2 * n))


def folds_between(raw: Column | str, reference: Column | str, nyquist: Column | str) -> Column:
    """Whole folds that bring raw nearest to reference; halves away from zero."""
    return F.round((col(reference) - col(raw)) / (2 * col(nyquist))).cast("int")


def velocity_distance(a: Column | str, b: Column | str, nyquist: Column | str) -> Column:
    """Distance on the velocity circle, 0 to Vn."""
    period = 2 * col(nyquist)
    d = F.abs(col(a) - col(b)) % period
    return F.when(d > col(nyquist), period - d).otherwise(d)


def alias_nearest(v: Column | str, reference: Column | str, nyquist: Column | str, most: int = 3) -> Column:
    """The alias of v nearest to reference; null beyond `most` folds."""
    k = folds_between(v, reference, nyquist)
    return F.when(F.abs(k) <= most, col(v) + k * 2 * col(nyquist))


def huber(residual: Column | str, scale: Column | float) -> Column:
    """Quadratic up to the scale, linear beyond; the two meet in value and slope."""
    r = F.abs(col(residual))
    d = F.greatest(scale if isinstance(scale, Column) else number(scale), number(1e-3))
    return F.when(r <= d, r * r / (2 * d)).otherwise(r - d / 2)


def width_confidence(width: Column | str, low: float = 2, high: float = 8, floor: float = 0.15) -> Column:
    """Confidence from spectrum width: 1 up to `low`, falling to `floor` at `high`; 1 where it is unknown."""
    t = F.greatest(number(0), F.least(number(1), (col(width) - low) / (high - low)))
    return F.coalesce(1 - t * (1 - floor), number(1))


# -- angles ------------------------------------------------------------------------------------


def wrap360(x: Column | str) -> Column:
    return F.pmod(col(x), number(360))


def azimuth_distance(a: Column | str, b: Column | str) -> Column:
    d = F.pmod(F.abs(col(a) - col(b)), number(360))
    return F.least(d, 360 - d)


# -- geometry ----------------------------------------------------------------------------------


def beam_height(range_m: Column | str, elevation_deg: Column | str, radius: float = BEAM_RADIUS_M) -> Column:
    """Height above the radar at a slant range; the station's own height is left out."""
    r, e = col(range_m), F.radians(col(elevation_deg))
    return F.sqrt(r * r + radius * radius + 2 * r * radius * F.sin(e)) - radius


def ground_range(range_m: Column | str, elevation_deg: Column | str, radius: float = EFFECTIVE_RADIUS_M) -> Column:
    r, e = col(range_m), F.radians(col(elevation_deg))
    height = beam_height(range_m, elevation_deg, radius)
    return radius * F.asin(F.greatest(number(-1), F.least(number(1), r * F.cos(e) / (radius + height))))


def gate_position(range_m: Column | str, azimuth_deg: Column | str, elevation_deg: Column | str, lat0: Column | str, lon0: Column | str) -> dict[str, Column]:
    """latitude, longitude and height of a gate on the 4/3 earth, by the tangent plane at the radar."""
    arc, a = ground_range(range_m, elevation_deg), F.radians(col(azimuth_deg))
    north, east = arc * F.cos(a), arc * F.sin(a)
    return {
        "latitude": col(lat0) + F.degrees(north / EARTH_RADIUS_M),
        "longitude": col(lon0) + F.degrees(east / (EARTH_RADIUS_M * F.cos(F.radians(col(lat0))))),
        "height_m": beam_height(range_m, elevation_deg, EFFECTIVE_RADIUS_M),
    }


def position_gate(latitude: Column | str, longitude: Column | str, elevation_deg: Column | str, lat0: Column | str, lon0: Column | str) -> dict[str, Column]:
    """range_m, azimuth_deg and height_m where a tilt's beam passes over a place: the inverse of gate_position."""
    north = F.radians(col(latitude) - col(lat0)) * EARTH_RADIUS_M
    east = F.radians(col(longitude) - col(lon0)) * EARTH_RADIUS_M * F.cos(F.radians(col(lat0)))
    arc, e, r0 = F.sqrt(north * north + east * east), F.radians(col(elevation_deg)), EFFECTIVE_RADIUS_M
    # The beam leaves the radar at elevation e; seen from the earth's centre it has turned by arc / R.
    turn = arc / r0
    slant = r0 * F.sin(turn) / F.cos(turn + e)
    return {"range_m": slant, "azimuth_deg": wrap360(F.degrees(F.atan2(east, north))), "height_m": r0 * (F.cos(e) / F.cos(turn + e) - 1)}


def mercator(latitude: Column | str, longitude: Column | str) -> dict[str, Column]:
    """Web-Mercator world coordinates in [0, 1]."""
    lat = F.radians(F.greatest(number(-MERCATOR_LATITUDE), F.least(number(MERCATOR_LATITUDE), col(latitude))))
    return {"x": (col(longitude) + 180) / 360, "y": (1 - F.ln(F.tan(lat / 2 + F.lit(0.7853981633974483))) / F.lit(3.141592653589793)) / 2}


def kernel_width_km(range_km: Column | str, base: float = 0.70, growth: float = 0.065) -> Column:
    return F.hypot(number(base), growth * col(range_km))


# -- text, dates, colours ----------------------------------------------------------------------


def moment_name(name: Column | str) -> Column:
    """A moment's three-character name, padded with blanks."""
    return F.rpad(F.substring(col(name), 1, 3), 3, " ")


def collect_time(days: Column | str, ms: Column | str) -> Column:
    """Timestamp of a day number (1970-01-01 is day 1) and milliseconds of the day."""
    return F.timestamp_seconds((col(days) - 1) * 86_400 + col(ms) / 1000)


def tilt_time_label(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH-mm-ss")


def quantize(value: Column | str, low: float, high: float) -> Column:
    """Voxel value to 1..255, 0 for none; halves upwards."""
    t = F.greatest(number(0), F.least(number(1), (col(value) - low) / (high - low)))
    return F.coalesce((1 + F.floor(t * 254 + 0.5)).cast("int"), F.lit(0))


# -- costs and weights of the older dealiasers ---------------------------------------------------


def _positive(x: Column | str) -> Column:
    return F.greatest(number(0), F.coalesce(col(x), number(0)))


#: Residual scales in m/s: the floor, and the shares of Nyquist velocity, spectrum width and range that they reach at least.
RESIDUAL_SCALES = {"tilt": (1.5, 0.12, 0.5, 0.0), "vertical": (2.0, 0.15, 0.35, 0.0025)}


def residual_scale(kind: str, nyquist: Column | str, width: Column | str, range_m: Column | str | None = None) -> Column:
    """Scale of residuals within a tilt, or between tilts, where it grows with range."""
    floor, of_nyquist, of_width, of_range = RESIDUAL_SCALES[kind]
    reach = [of_range * _positive(range_m)] if range_m is not None else []
    return F.greatest(number(floor), of_nyquist * col(nyquist), of_width * _positive(width), *reach)


#: Shares that a fold's margin, neighbours, size and residual have in the trust in it.
TRUST_SHARES = {"margin": 0.40, "neighbours": 0.25, "size": 0.20, "residual": 0.15}


def fold_trust(cost: Column | str, next_cost: Column | str, beside: Column | str, above_below: Column | str, gates: Column | str) -> Column:
    """Trust in a region's fold, 0 to 1: how far the next best one is, how many neighbours agree (those above and below count twice), size and residual."""
    votes = col(beside) + 2 * col(above_below)
    parts = {
        "margin": F.least(number(1), _positive((col(next_cost) - col(cost)) / F.greatest(col(next_cost), number(1e-3)))), "neighbours": 1 - F.exp(-0.35 * votes),
        "size": 1 - F.exp(-0.15 * F.greatest(F.lit(1), col(gates))), "residual": F.exp(-col(cost) / F.greatest(number(1), 4.0 * F.greatest(F.lit(1), votes))),
    }
    whole = sum((TRUST_SHARES[k] * part for k, part in parts.items()), number(0))
    return F.when(col(cost).isNotNull() & col(next_cost).isNotNull(), F.least(number(1), _positive(whole))).otherwise(number(0))


def candidate_cost(candidate: Column | str, prediction: Column | str, nyquist: Column | str, mad: Column | str, support: Column | str) -> Column:
    """Huber cost of a candidate velocity against a prediction, less where independent gates support it."""
    scale = F.greatest(number(1.5), 0.12 * col(nyquist), 2.5 * col(mad))
    trust = F.when(col(support) >= 2, number(0.45)).when(col(support) == 1, number(0.75)).otherwise(number(1))
    return huber(col(candidate) - col(prediction), scale) * trust


def edge_weight(v_a: Column | str, v_b: Column | str, nyquist: Column | str, width: Column | None = None, dbz_a: Column | None = None, dbz_b: Column | None = None, high_shear: float = 0.75, core: float = 0.2, buffer: float = 0.5) -> Column:
    """Trust in the continuity of two neighbours: less over strong shear and width, a little by reflectivity."""
    share = F.abs(col(v_a) - col(v_b)) / col(nyquist)
    w = F.when(share >= high_shear, number(core)).when(share >= 0.55, number(buffer)).otherwise(number(1))
    if width is not None:
        w = w * F.coalesce(F.greatest(number(0.25), F.least(number(1), 1 / (1 + 0.55 * width / F.greatest(number(1), col(nyquist))))), number(1))
    if dbz_a is not None and dbz_b is not None:
        step = F.abs(dbz_a - dbz_b)
        w = w * F.when(step > 25, number(0.75)).when(step < 8, number(1.05)).otherwise(number(1))
    return F.greatest(number(0.05), F.least(number(1), w))


def clock_label(hhmmss: Column | str) -> Column:
    t = col(hhmmss)
    return F.concat(F.concat_ws(":", F.substring(t, 1, 2), F.substring(t, 3, 2), F.substring(t, 5, 2)), F.lit(" UTC"))


def legend_ticks(low: Column, high: Column, step: Column, most: int = 6) -> Column:
    """Values of a legend: both ends, and between them whole multiples of a step that is widened until about `most` fit."""
    span = high - low
    own = F.when(step > 0, step).otherwise(span / 5)
    wide = own * F.greatest(number(1), F.ceil(span / own / most))
    first, last = F.ceil(low / wide).cast("long"), F.floor(high / wide).cast("long")
    inner = F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * wide)).otherwise(F.array().cast("array<double>"))
    inner = F.filter(inner, lambda x: (x > low) & (x < high))
    return F.when(span > 0, F.concat(F.array(low), inner, F.array(high))).otherwise(F.array(low))


def legend_digits(step: Column) -> Column:
    """Digits after the point that a legend's step asks for, three at most."""
    return F.when((step > 0) & (step < 1), F.least(F.lit(3), F.ceil(-F.log10(step)).cast("int"))).otherwise(F.lit(0))


def compatible_nyquist(a: Column | str, b: Column | str, share: float = 0.03) -> Column:
    """Whether two Nyquist velocities differ by at most a share of the larger."""
    return F.abs(col(a) - col(b)) <= share * F.greatest(col(a), col(b))


def clamped_index(wanted: Column | str, n: Column | str) -> Column:
    """A tilt's number within 0 and n - 1; null if there are no tilts."""
    return F.when(col(n) > 0, F.greatest(F.lit(0), F.least(col(wanted), col(n) - 1)))


def voxel_number(ix: Column | str, iy: Column | str, iz: Column | str, n_lat: int, n_lon: int) -> Column:
    """A voxel's place in the flat array, latitude fastest."""
    return col(ix).cast("long") + col(iy).cast("long") * n_lat + col(iz).cast("long") * n_lat * n_lon


def parse_tilt_time(label: Column | str) -> Column:
    """The time in a tilt's label yyyy-MM-dd HH-mm-ss; null for any other text."""
    whole = col(label).rlike(r"^\d{4}-\d{2}-\d{2} \d{2}-\d{2}-\d{2}$")
    return F.when(whole, F.try_to_timestamp(col(label), F.lit("yyyy-MM-dd HH-mm-ss")))


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a time rounded to milliseconds (halves away from 1970), cut off towards 1970."""
    return (F.round(F.unix_micros(col(ts).cast("timestamp")) / 1000) / 1000).cast("long")


def direction_bits(out: Column, inward: Column, on: Column, back: Column) -> Column:
    """Directions in which something holds as bits 1, 2 (along the ray), 4 and 8 (round the ring)."""
    return sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate((out, inward, on, back))), F.lit(0))


def both_axes(bits: Column) -> Column:
    """Whether a ray direction and a ring direction are among the bits."""
    return (bits.bitwiseAND(3) != 0) & (bits.bitwiseAND(12) != 0)
