"""Exact decimal formatting and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed6(x: Column) -> Column:
    """Six decimals, correctly rounded from the binary value, ties to even.

    This is what C and Python print for ``%.6f``. The product x * 10^6 is taken with its
    rounding error (Dekker's product), which decides the cases next to a tie.
    """
    scale = 1_000_000.0
    a = F.abs(x)
    high = a * 134217729.0 - (a * 134217729.0 - a)
    low = a - high
    p = a * scale
    # 10^6 needs fewer bits than half a double, so it is its own high part.
    error = (high * scale - p) + low * scale
    k = F.floor(p).cast("long")
    part = p - F.floor(p).cast("double")
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (k % 2 == 1))))
    n = k + up.cast("long")
    return F.concat(
        F.when(x < 0, "-").otherwise(""),
        F.floor(n / 1_000_000).cast("long").cast("string"),
        F.lit("."),
        F.lpad((n % 1_000_000).cast("string"), 6, "0"),
    )


def nearest(x: Column, digits: int = 6) -> Column:
    """Rounded as C and SQL engines round doubles: the binary product x * 10^digits goes to
    the nearest whole number, ties away from zero.

    ``F.round`` takes the shortest decimal text of x instead, which differs where the product
    lies next to a tie: 0.0640625 is 64062.49999999999 millionths. Products beyond 2^52 are
    whole; they are divided again, which may move the last bit. Where the product is infinite
    or not a number, x stays.
    """
    scale = float(10**digits)
    p = F.abs(x * scale)
    whole = F.floor(p)
    near = F.signum(x) * (whole + (p - whole >= 0.5).cast("long")) / scale
    return F.when(p < float(1 << 52), near).when(p < float("inf"), x * scale / scale).otherwise(x)
