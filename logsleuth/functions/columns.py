"""Column expressions shared by the operators. All of them stay inside codegen."""

from pyspark.sql import Column, functions as F

from logsleuth.schema import FAILED, SUCCESS

# Night ends at this hour in every rule that has no parameter of its own.
NIGHT_END = 5


def micros(ts) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, whatever the session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    day = F.unix_date(ts.cast("date")).cast("long") * 86400
    fraction = (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")
    return (day + seconds) * 1000000 + fraction


def wall_clock(microseconds: Column) -> Column:
    """Inverse of :func:`micros`."""
    seconds = (microseconds.cast("decimal(20,0)") / 1000000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def as_instant(ts) -> Column:
    """Wall-clock time read as UTC, for operators that only take instants."""
    return F.timestamp_micros(micros(ts))


def failed_count() -> Column:
    return F.count_if(F.col("event") == FAILED)


def success_count() -> Column:
    return F.count_if(F.col("event") == SUCCESS)


def is_night_login(night_end: int = NIGHT_END) -> Column:
    return (F.col("event") == SUCCESS) & (F.hour("parsed_time") < night_end)


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back (array-library rounding)."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def digest_mod(hex_digest: Column, hex_length: int, modulus: int) -> Column:
    """Value of a long hex digest modulo a small number, folded 32 bits at a time."""
    carry = (1 << 32) % modulus
    rest = F.lit(0).cast("long")
    for start in range(1, hex_length + 1, 8):
        chunk = F.conv(F.substring(hex_digest, start, 8), 16, 10).cast("long")
        rest = (rest * carry + chunk) % modulus
    return rest


def normal_cdf(x: Column, mean: Column, sigma: Column) -> Column:
    """Standard normal distribution function, error below 1.5e-7.

    erf by formula 7.1.26 of Abramowitz and Stegun.
    """
    z = (x - mean) / (sigma * F.lit(2.0**0.5))
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.3275911 * a)
    # Coefficients of the published approximation.
    poly = t * (
        0.254829592
        + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))
    )
    erf = F.signum(z) * (1.0 - poly * F.exp(-a * a))
    return 0.5 * (1.0 + erf)
