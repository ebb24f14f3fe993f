"""Scalar rules as Column builders. Nothing here starts a Python worker."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

INF = float("inf")
NAN = float("nan")
MICROS_PER_DAY = 86_400_000_000.0
MICROS_PER_YEAR = 365.25 * MICROS_PER_DAY


def d(x) -> Column:
    """A double literal (a bare 0.7 in SQL text would be a decimal)."""
    return F.lit(float(x))


def micros(ts) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, exact and free of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def clip(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, d(lo) if not isinstance(lo, Column) else lo),
                   d(hi) if not isinstance(hi, Column) else hi)


def finite(x: Column) -> Column:
    """Non-finite doubles become null: the rule for every sink."""
    return F.when(F.isnan(x) | (F.abs(x) == d(INF)), None).otherwise(x)


# --- score maps ---------------------------------------------------------------
def sat(x: Column, x50: Column) -> Column:
    """x / (x + x50) on [0, inf): 0.5 at x50, 0 for NaN and negatives, 1 at +inf."""
    pos = F.greatest(x, d(0))
    return (
        F.when(x.isNull() | F.isnan(x), d(0))
        .when(x == d(INF), d(1))
        .when(x50 > 0, F.try_divide(pos, pos + x50))
        .otherwise(d(0))
    )


def lin(x: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else d(lo)
    hi = hi if isinstance(hi, Column) else d(hi)
    return F.when(lo == hi, d(0)).otherwise(clip(F.try_divide(x - lo, hi - lo), 0, 1))


# Display knots of the public grade scale.
DISPLAY_KNOTS = ((0.0, 40.0), (35.0, 60.0), (55.0, 80.0), (70.0, 90.0), (99.0, 100.0))
DISPLAY_KNOTS_FAIL = ((0.0, 0.0), (55.0, 59.0), (99.0, 59.0))


def lerp(x: Column, knots=DISPLAY_KNOTS) -> Column:
    """Piecewise-linear map, constant outside the knots."""
    out = F.when(x <= d(knots[0][0]), d(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= d(x1), d(y0) + d(y1 - y0) * (x - d(x0)) / d(x1 - x0))
    return out.otherwise(d(knots[-1][1]))


def display_score(x: Column, passed: Column | None = None) -> Column:
    """Grade-scale value in [0, 99.9], one decimal; a failed verdict stays at or under 59."""
    shown = lerp(x)
    if passed is not None:
        shown = F.when(passed, shown).otherwise(F.least(lerp(x, DISPLAY_KNOTS_FAIL), d(59)))
    return F.bround(clip(shown, 0, 99.9), 1)


def overfit_index(credibility: Column) -> Column:
    return clip(d(100) - credibility, 0, 100)


# --- normal distribution ------------------------------------------------------
def _horner(x: Column, coefs) -> Column:
    return reduce(lambda acc, c: acc * x + d(c), coefs[1:], d(coefs[0]))


# Hart's rational approximation as printed by West (2005).
_HART_N = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376)
_HART_D = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function, within 1e-15 of the erf form."""
    z = F.abs(x)
    e = F.exp(-z * z / d(2))
    tail = d(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = d(k) / (z + tail)
    c = (
        F.when(z > d(37), d(0))
        .when(z < d(7.07106781186547), e * _horner(z, _HART_N) / _horner(z, _HART_D))
        .otherwise(e / (z + tail) / d(2.506628274631))
    )
    return F.when(x.isNull() | F.isnan(x), x).when(x > 0, d(1) - c).otherwise(c)


# Acklam's rational approximation of the inverse normal.
_ACK_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
          1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_ACK_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
          6.680131188771972e+01, -1.328068155288572e+01, 1.0)
_ACK_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
          -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_ACK_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
          3.754408661907416e+00, 1.0)
_ACK_LOW = 0.02425


def norm_ppf(p: Column) -> Column:
    """Inverse of the standard normal; NaN outside the open unit interval."""
    inner = p - d(0.5)
    s = inner * inner
    low = F.sqrt(d(-2) * F.log(p))
    high = F.sqrt(d(-2) * F.log(d(1) - p))
    return (
        F.when((p <= 0) | (p >= 1), d(NAN))
        .when(p < d(_ACK_LOW), _horner(low, _ACK_C) / _horner(low, _ACK_D))
        .when(p > d(1 - _ACK_LOW), -_horner(high, _ACK_C) / _horner(high, _ACK_D))
        .otherwise(_horner(s, _ACK_A) * inner / _horner(s, _ACK_B))
    )


EULER_GAMMA = 0.5772156649015329
TRIALS_CAP = 1_000_000
CONFIDENCE_Z = 1.6448536269514722  # Fixed value: normal quantile of 0.95


def expected_max_z(n_trials: Column) -> Column:
    """Expected best standardized Sharpe of n zero-skill trials (0 for a single trial)."""
    n = n_trials.cast("double")
    best = (
        d(1 - EULER_GAMMA) * norm_ppf(d(1) - d(1) / n)
        + d(EULER_GAMMA) * norm_ppf(d(1) - d(1) / (n * d(2.718281828459045)))
    )
    return F.when(n <= 1, d(0)).otherwise(best)


def trial_budget(margin: Column) -> Column:
    """Largest number of trials whose expected best z stays at or below ``margin``.

    ``margin`` is sr * sqrt(n - 1) / denom - z(0.95). The expected best z grows with the number of
    trials, so the answer is found bit by bit, 19 steps; passing 524288 gives the cap.
    """
    bits = F.sequence(F.lit(18), F.lit(0), F.lit(-1))

    def step(lo, b):
        trial = lo + F.pow(d(2), b).cast("long")
        return F.when(expected_max_z(trial) <= margin, trial).otherwise(lo)

    found = F.aggregate(bits, F.lit(0).cast("long"), step)
    return (
        F.when(margin.isNull(), None)
        .when(margin < 0, F.lit(0).cast("long"))
        .when(expected_max_z(F.lit(524288)) <= margin, F.lit(TRIALS_CAP).cast("long"))
        .otherwise(found)
    )


# --- hashed uniforms ----------------------------------------------------------
_M32 = 4294967296


def stream_key(key: Column, seed: int, salt: int) -> Column:
    """One md5 per strategy gives the 32-bit start of its own random stream."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(salt)), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def with_hash(df: DataFrame, out: str, state: str | Column, part: Column) -> DataFrame:
    """Add ``out``: the hash state advanced by one integer coordinate.

    Every xor-shift round reads its input twice, so each round is a projection of its own; one nested
    expression would grow eightfold per coordinate.
    """
    state = F.col(state) if isinstance(state, str) else state
    m32, mult = F.lit(_M32), F.lit(73244475)
    df = df.withColumn(out, (state + (part.cast("long") % F.lit(2147483648)) * F.lit(2654435761)) % m32)
    for _ in range(2):
        df = df.withColumn(out, (F.col(out).bitwiseXOR(F.shiftright(out, 16)) * mult) % m32)
    return df.withColumn(out, F.col(out).bitwiseXOR(F.shiftright(out, 16)))


def as_uniform(state: str) -> Column:
    """Uniform in [0, 1) of a 32-bit hash state."""
    return F.col(state).cast("double") / d(_M32)


# --- aggregates -------------------------------------------------------------------
def pearson(x: str, y: str) -> Column:
    """Correlation aggregate that is null for flat or short groups (``corr`` divides by zero there in ANSI mode)."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b))


# --- time ---------------------------------------------------------------------
def naive_time(text: Column) -> Column:
    """Wall-clock time of an ISO text: the zone suffix is dropped, not converted."""
    bare = F.regexp_replace(F.trim(text), r"\s*(Z|[+-]\d{2}:?\d{2})$", "")
    return bare.try_cast("timestamp_ntz")


def first_when(*pairs) -> Column:
    """CASE ladder over (condition, value) pairs; the last pair may have None as condition."""
    out = None
    for cond, val in pairs:
        val = val if isinstance(val, Column) else F.lit(val)
        if cond is None:
            return out.otherwise(val)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out
