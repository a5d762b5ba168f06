"""Column expressions for curve work: weights, kernels, distances, the normal distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
LN_999 = 6.906754778648554


def half_life(steps: Column, rate: Column | float, per_hour: float) -> Column:
    """0.5 to the power of steps over the half-life (`rate` hours of `per_hour` slots)."""
    return F.pow(F.lit(0.5), steps / (F.lit(float(per_hour)) * rate))


def growth(tau: Column, t: Column | int, rate: Column | float, per_hour: float) -> Column:
    """Weight of an observed slot: 1 at the last one (t - 1), halving towards the past."""
    return half_life(F.lit(t) - 1 - tau, rate, per_hour)


def decay(lead: Column, rate: Column | float, per_hour: float) -> Column:
    """Weight of a slot `lead` steps ahead: 1 at the first one."""
    return half_life(lead, rate, per_hour)


def psi(tau: Column, t: Column | int, forget: Column | float, lookup: Column | float, per_hour: float) -> Column:
    """Past and future weights of a whole-day curve at update time t."""
    return F.when(tau < F.lit(t), growth(tau, t, forget, per_hour)).otherwise(decay(tau - F.lit(t), lookup, per_hour))


def growth_rate(tau: Column, t: int, rate: float) -> Column:
    """Older form of growth: an exponential rate per slot."""
    return F.exp(-rate * (F.lit(t) - 1 - tau))


def decay_rate(lead: Column, rate: float) -> Column:
    return F.exp(-rate * lead)


def logistic(x: Column, k: float) -> Column:
    """0.001, 0.5 and 0.999 at x = -30 k, 0 and 30 k minutes."""
    return 1 - 1 / (1 + F.exp(LN_999 * x / (30.0 * k)))


def logistic_plain(x: Column, k: float) -> Column:
    return 1 / (1 + F.exp(-k * x))


def lie_trust(lead: Column, nu: Column | float, trust: Column | float, minutes: float) -> Column:
    """Linear, then inverse exponential trust in the day-ahead forecast: 0 at lead 0, towards `trust`."""
    x = 2.5 * (60.0 * F.lit(nu) - minutes * (lead + 1)) / (60.0 * F.lit(nu) - minutes)
    return F.lit(trust) * (F.when(x > 0, -x).otherwise(1 - F.exp(x)) + 2.5) / 3.5


def rbf(d: Column, scale: Column | float) -> Column:
    return F.exp(-d / scale)


def inverse_kernel(d: Column, scale: Column | float) -> Column:
    return 1 / (d + scale)


def haversine(lon_1: Column, lat_1: Column, lon_2: Column, lat_2: Column) -> Column:
    """Kilometres between two points given in degrees."""
    half = lambda a, b: F.pow(F.sin((F.radians(a) - F.radians(b)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(half(lat_1, lat_2) + F.cos(F.radians(lat_1)) * F.cos(F.radians(lat_2)) * half(lon_1, lon_2)))


def periodic(day_1: Column, day_2: Column | int) -> Column:
    """Squared sine distance of two days of the year."""
    return F.pow(F.sin(0.5 * (360.0 / 365.0) * (day_1 - day_2) * 3.141592653589793 / 180.0), 2)


def wrap_yday(day: Column) -> Column:
    """A day number wrapped into 1..365."""
    return F.when(day < 1, day + 365).when(day > 365, day - 365).otherwise(day)


def unit_sphere(lon: Column, lat: Column) -> dict[str, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return {"x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)}


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def adaptive_nu(mse: Column) -> Column:
    """Minutes after which a forecast is trusted, by its mean square error so far; no less than 875."""
    return F.greatest(F.lit(875.0), 2750 * F.sqrt(F.sqrt(mse)))


def silverman(x: Column) -> Column:
    """Aggregate of a bounded group: 0.9 min(sd, IQR / 1.34) n^(-1/5), population sd, linear percentiles."""
    return silverman_of(F.stddev_pop(x), F.percentile(x, 0.25), F.percentile(x, 0.75), F.count(x))


def silverman_of(sd: Column, lower: Column, upper: Column, n: Column) -> Column:
    """The same from a group's spread, quartiles and size."""
    return 0.9 * F.least(sd, (upper - lower) / 1.34) * F.pow(n, F.lit(-0.2))


def normal_log_density(y: Column, mu: Column, sigma: Column) -> Column:
    return -0.5 * F.pow((y - mu) / sigma, 2) - F.log(sigma) - 0.9189385332046727


#: Coefficients of West's (2005) double-precision cumulative normal.
PHI_UP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
PHI_DOWN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
PHI_EDGE = 7.07106781186547


def normal_cdf(x: Column) -> Column:
    a = F.abs(x)
    poly = lambda cs: _horner(cs, a)
    near = F.exp(-a * a / 2) * poly(PHI_UP) / poly(PHI_DOWN)
    far = F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37, F.lit(0.0)).when(a < PHI_EDGE, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def _horner(cs: tuple[float, ...], x: Column) -> Column:
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * x + c
    return out


def normal_density(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / 2.5066282746310002


def mean_square(x: str, y: str, w: str) -> Column:
    """Weighted mean square of two array columns; null where no weight is left."""
    zero = F.lit(0.0)
    square = F.zip_with(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), w, lambda d, v: d * v)
    total = F.aggregate(w, zero, lambda s, v: s + v)
    return F.when(total > 0, F.aggregate(square, zero, lambda s, v: s + v) / total)
