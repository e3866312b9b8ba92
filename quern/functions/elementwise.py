"""Element-wise numeric functions on columns, by their array-library names.

Domain errors give NaN and divisions by zero give signed infinities, as in floating-point
arithmetic, where SQL functions give NULL or an error. NULL stays NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def _d(x) -> Column:
    x = x if isinstance(x, Column) else F.lit(x)
    return x.cast("double")


def _guard(x: Column, ok: Column, value: Column, bad: Column | float = NAN) -> Column:
    """value where ok, bad where not (and the number is not missing)."""
    return F.when(x.isNull(), F.lit(None).cast("double")).when(ok, value).otherwise(bad if isinstance(bad, Column) else F.lit(bad))


def abs_(x):
    return F.abs(x)


def arccos(x):
    return F.acos(_d(x))


def arccosh(x):
    return _guard(_d(x), _d(x) >= 1, F.acosh(_d(x)))


def arcsin(x):
    return F.asin(_d(x))


def arcsinh(x):
    return F.asinh(_d(x))


def arctan(x):
    return F.atan(_d(x))


def arctan2(y, x):
    return F.atan2(_d(y), _d(x))


def arctanh(x):
    x = _d(x)
    return _guard(x, F.abs(x) < 1, F.atanh(x), F.when(F.abs(x) == 1, F.signum(x) * INF).otherwise(NAN))


def around(x, decimals: int = 0):
    return F.bround(x, decimals)


def cbrt(x):
    return F.cbrt(_d(x))


def ceil(x):
    return F.ceil(_d(x)).cast("double")


def clip(x, low, high):
    return F.least(F.greatest(x, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def copysign(x, y):
    return F.abs(_d(x)) * F.when(signbit(y), -1.0).otherwise(1.0)


def cos(x):
    return F.cos(_d(x))


def cosh(x):
    return F.cosh(_d(x))


def deg2rad(x):
    return F.radians(_d(x))


radians = deg2rad


def rad2deg(x):
    return F.degrees(_d(x))


degrees = rad2deg


def divide(x, y):
    x, y = _d(x), _d(y)
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y != 0, x / F.when(y != 0, y)).when(F.isnan(x) | (x == 0), NAN).otherwise(F.signum(x) * INF)


true_divide = divide


def exp(x):
    return F.exp(_d(x))


def exp2(x):
    return F.pow(F.lit(2.0), _d(x))


def expm1(x):
    return F.expm1(_d(x))


def fix(x):
    x = _d(x)
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


trunc = fix


def float_power(x, y):
    return F.pow(_d(x), _d(y))


power = float_power


def floor(x):
    return F.floor(_d(x)).cast("double")


def floor_divide(x, y):
    return F.floor(divide(x, y)).cast("double")


def mod(x, y):
    """The remainder with the sign of the divisor."""
    x, y = _d(x), _d(y)
    r = x % F.when(y != 0, y)
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, NAN).when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)


remainder = mod


def fmod(x, y):
    """The remainder with the sign of the dividend."""
    x, y = _d(x), _d(y)
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, NAN).otherwise(x % F.when(y != 0, y))


def fmax(x, y):
    """The larger one, missing values ignored."""
    return F.greatest(F.nanvl(_d(x), F.lit(None).cast("double")), F.nanvl(_d(y), F.lit(None).cast("double")))


def fmin(x, y):
    return F.least(F.nanvl(_d(x), F.lit(None).cast("double")), F.nanvl(_d(y), F.lit(None).cast("double")))


def maximum(x, y):
    """The larger one, missing if one is."""
    return F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise(F.greatest(x, y))


def minimum(x, y):
    return F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise(F.when(F.isnan(_d(x)) | F.isnan(_d(y)), NAN).otherwise(F.least(x, y)))


def frexp(x):
    """(mantissa, exponent) with x = mantissa * 2**exponent and 0.5 <= abs(mantissa) < 1."""
    x = _d(x)
    e = F.when(x == 0, 0).otherwise(F.floor(F.log2(F.when(x != 0, F.abs(x)))).cast("int") + 1)
    return F.struct((x / F.pow(F.lit(2.0), e)).alias("mantissa"), e.alias("exponent"))


def ldexp(x, e):
    return _d(x) * F.pow(F.lit(2.0), _d(e))


def modf(x):
    """(fractional, integral) parts."""
    return F.struct((_d(x) - fix(x)).alias("fractional"), fix(x).alias("integral"))


def hypot(x, y):
    return F.hypot(_d(x), _d(y))


#: Chebyshev-free series for the modified Bessel function of order 0: terms (x/2)**(2k) / k!**2.
I0_TERMS = 60


def i0(x):
    q = F.pow(_d(x) / 2, F.lit(2.0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(I0_TERMS)), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda s, k: F.struct((s["term"] * q / (k * k)).alias("term"), (s["sum"] + s["term"] * q / (k * k)).alias("sum")), lambda s: s["sum"])


def isclose(x, y, rtol: float = 1e-5, atol: float = 1e-8):
    return F.abs(_d(x) - _d(y)) <= atol + rtol * F.abs(_d(y))


def isfinite(x):
    return ~(F.isnan(_d(x)) | (F.abs(_d(x)) == INF))


def isinf(x):
    return F.abs(_d(x)) == INF


def isnan(x):
    return F.isnan(_d(x))


def log(x):
    x = _d(x)
    return _guard(x, x > 0, F.log(x), F.when(x == 0, -INF).otherwise(NAN))


def log10(x):
    x = _d(x)
    return _guard(x, x > 0, F.log10(x), F.when(x == 0, -INF).otherwise(NAN))


def log2(x):
    x = _d(x)
    return _guard(x, x > 0, F.log2(x), F.when(x == 0, -INF).otherwise(NAN))


def log1p(x):
    x = _d(x)
    return _guard(x, x > -1, F.log1p(x), F.when(x == -1, -INF).otherwise(NAN))


def logaddexp(x, y):
    x, y = _d(x), _d(y)
    return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))


def logaddexp2(x, y):
    x, y = _d(x), _d(y)
    return F.greatest(x, y) + F.log1p(F.pow(F.lit(2.0), -F.abs(x - y))) / math.log(2)


def logical_and(x, y):
    return (x != 0) & (y != 0)


def logical_or(x, y):
    return (x != 0) | (y != 0)


def logical_xor(x, y):
    return (x != 0) != (y != 0)


def logical_not(x):
    return x == 0


def left_shift(x, n: int):
    return F.shiftleft(x, n)


def right_shift(x, n: int):
    return F.shiftright(x, n)


def bitwise_and(x, y):
    return x.bitwiseAND(y)


def bitwise_or(x, y):
    return x.bitwiseOR(y)


def bitwise_xor(x, y):
    return x.bitwiseXOR(y)


def invert(x):
    return F.bitwise_not(x)


def nan_to_num(x, nan: float = 0.0):
    x = _d(x)
    big = 1.7976931348623157e308
    return F.when(F.isnan(x), nan).when(x == INF, big).when(x == -INF, -big).otherwise(x)


def negative(x):
    return -x


def positive(x):
    return x


def reciprocal(x):
    return divide(F.lit(1.0), x)


def rint(x):
    return F.rint(_d(x))


def sign(x):
    return F.signum(_d(x))


def signbit(x):
    x = _d(x)
    return (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))


def sin(x):
    return F.sin(_d(x))


def sinc(x):
    y = math.pi * _d(x)
    return F.when(y == 0, 1.0).otherwise(F.sin(y) / F.when(y != 0, y))


def sinh(x):
    return F.sinh(_d(x))


def spacing(x):
    """The distance to the next larger number in magnitude."""
    return F.pow(F.lit(2.0), F.floor(F.log2(F.abs(_d(x)))) - 52)


def nextafter_up(x):
    return _d(x) + spacing(x)


def sqrt(x):
    return F.sqrt(_d(x))


def square(x):
    return x * x


def tan(x):
    return F.tan(_d(x))


def tanh(x):
    return F.tanh(_d(x))


# Special functions.

_GAMMA_G = 7
#: Lanczos coefficients for g = 7, n = 9 (fixed values).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def gammaln(x):
    """Logarithm of the gamma function for positive numbers."""
    y = _d(x) - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (y + i)
    t = y + _GAMMA_G + 0.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total)


def gamma(x):
    return F.exp(gammaln(x))


def beta(a, b):
    return F.exp(betaln(a, b))


def betaln(a, b):
    return gammaln(a) + gammaln(b) - gammaln(_d(a) + _d(b))


def digamma(x):
    """Logarithmic derivative of gamma for positive numbers: recurrence up to 10, then the asymptotic series."""
    x = _d(x)
    total = F.lit(0.0)
    for i in range(10):
        total = total - 1 / (x + i)
    y = x + 10
    q = 1 / (y * y)
    return total + F.log(y) - 0.5 / y - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132))))


psi = digamma


def _erf_terms(square):
    """The series' sum by one product and one addition a term, without a struct for each."""
    total = F.lit(0.0)
    for k in range(60, -1, -1):
        total = total * square + (-1) ** k / (math.factorial(k) * (2 * k + 1))
    return total


def erf(x):
    """Error function by its Maclaurin series up to 3 and a continued fraction of erfc beyond."""
    x = _d(x)
    a = F.abs(x)
    series = F.get(F.transform(F.array(a * a), _erf_terms), F.lit(0)) * a * (2 / math.sqrt(math.pi))
    return F.when(F.isnan(x), NAN).otherwise(F.signum(x) * F.when(a < 3, series).otherwise(1 - _erfc_tail(a)))


def _erfc_tail(a: Column) -> Column:
    frac = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), a, lambda s, k: a + k / 2 / s)
    return F.exp(-a * a) / math.sqrt(math.pi) / frac


def erfc(x):
    x = _d(x)
    return F.when(x > 3, _erfc_tail(x)).otherwise(1 - erf(x))


def xlogy(x, y):
    return F.when(_d(x) == 0, 0.0).otherwise(_d(x) * log(y))


def entr(x):
    x = _d(x)
    return F.when(x > 0, -x * F.log(x)).when(x == 0, 0.0).otherwise(-INF)


def rel_entr(x, y):
    x, y = _d(x), _d(y)
    return F.when((x > 0) & (y > 0), x * F.log(x / F.when(y > 0, y))).when((x == 0) & (y >= 0), 0.0).otherwise(INF)


def kl_div(x, y):
    return rel_entr(x, y) - _d(x) + _d(y)


def gammainc(a, x):
    """Regularised lower incomplete gamma function: its series below a + 1, a continued fraction beyond."""
    a, x = _d(a), _d(x)
    first = 1 / a
    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(first.alias("t"), first.alias("s")), lambda s, k: F.struct((s["t"] * x / (a + k)).alias("t"), (s["s"] + s["t"] * x / (a + k)).alias("s")), lambda s: s["s"])
    scale = F.exp(-x + a * F.log(x) - gammaln(a))
    frac = F.aggregate(F.sequence(F.lit(200), F.lit(1), F.lit(-1)), F.lit(0.0), lambda s, k: k * (a - k) / (x + 2 * k + 1 - a + s))
    return F.when(x <= 0, 0.0).when(x < a + 1, series * scale).otherwise(1 - scale / (x + 1 - a + frac))


def gammaincc(a, x):
    return 1 - gammainc(a, x)


def betainc(a, b, x):
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = _d(a), _d(b), _d(x)

    def cf(p: Column, q: Column, y: Column) -> Column:
        def term(m: Column) -> Column:
            h = F.floor(m / 2)
            even = h * (q - h) * y / ((p + 2 * h - 1) * (p + 2 * h))
            odd = -(p + h) * (p + q + h) * y / ((p + 2 * h) * (p + 2 * h + 1))
            return F.when(m % 2 == 0, even).otherwise(odd)

        inner = F.aggregate(F.sequence(F.lit(200), F.lit(1), F.lit(-1)), F.lit(0.0), lambda s, m: term(m) / (1 + s))
        return F.exp(p * F.log(y) + q * F.log(1 - y) - betaln(p, q)) / p / (1 + inner)

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), cf(a, b, x)).otherwise(1 - cf(b, a, 1 - x))


def _agm(b: Column) -> Column:
    """Arithmetic-geometric mean of 1 and b, and the sum of 2**(n-1) * c_n**2."""
    start = F.struct(F.lit(1.0).alias("a"), b.alias("b"), ((1 - b * b) / 2).alias("s"), F.lit(1.0).alias("w"))

    def step(s: Column, _: Column) -> Column:
        c = (s["a"] - s["b"]) / 2
        return F.struct(((s["a"] + s["b"]) / 2).alias("a"), F.sqrt(s["a"] * s["b"]).alias("b"), (s["s"] + s["w"] * c * c).alias("s"), (s["w"] * 2).alias("w"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step)


def ellipk(m):
    """Complete elliptic integral of the first kind, of the parameter m below 1."""
    return math.pi / 2 / _agm(F.sqrt(1 - _d(m)))["a"]


def ellipe(m):
    """Complete elliptic integral of the second kind."""
    r = _agm(F.sqrt(1 - _d(m)))
    return math.pi / 2 / r["a"] * (1 - r["s"])


def jv(n: int, x):
    """Bessel function of the first kind and integer order, by its integral."""
    x, steps = _d(x), 200
    total = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda s, k: s + F.cos(n * (k + 0.5) * (math.pi / steps) - x * F.sin((k + 0.5) * (math.pi / steps))))
    return total / steps


def iv(n: int, x):
    """Modified Bessel function of the first kind and integer order, by its integral."""
    x, steps = _d(x), 200
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda s, k: s + F.exp(x * F.cos((k + 0.5) * (math.pi / steps))) * F.cos(n * (k + 0.5) * (math.pi / steps))) / steps


def erfinv(y):
    """Inverse error function by Newton's steps from a logarithmic start."""
    y = _d(y)
    a, log1 = 0.147, F.log(1 - _d(y) * _d(y))
    g = 2 / (math.pi * a) + log1 / 2
    x = F.signum(y) * F.sqrt(F.sqrt(g * g - log1 / a) - g)
    for _ in range(3):
        x = x - (erf(x) - y) / (2 / math.sqrt(math.pi) * F.exp(-x * x))
    return F.when(F.abs(y) < 1, x).when(F.abs(y) == 1, F.signum(y) * INF).otherwise(NAN)


def chi2_sf(x, df):
    """Upper tail of the chi-squared distribution."""
    return gammaincc(_d(df) / 2, _d(x) / 2)


def t_sf(t, df):
    """Upper tail of Student's t distribution."""
    t, df = _d(t), _d(df)
    half = betainc(df / 2, F.lit(0.5), df / (df + t * t)) / 2
    return F.when(t >= 0, half).otherwise(1 - half)
