"""Reusable column expressions.

Arrays of per-answer values (one row per model x item) keep softmax and
the item curve row-local: no shuffle, no Python, inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x) -> Column:
    """Round to 6 places: the precision every compared float output uses."""
    return F.round(_c(x), 6)


def r12(x) -> Column:
    """Round to 12 places before ranking, so summation order cannot flip ties."""
    return F.round(_c(x), 12)


def sum_array(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def broadcast_scalar(arr, scalar) -> Column:
    """``scalar`` repeated to the length of ``arr``.

    A row-level value used inside a lambda would be re-evaluated for every
    element (Catalyst inlines it); as a higher-order-function *argument* it is
    evaluated once per row.  Pair it with ``zip_with``."""
    return F.array_repeat(scalar, F.size(arr))


def exp_shifted(x) -> Column:
    """exp(x - max(x)) elementwise: the numerator of a stable softmax."""
    arr = _c(x)
    return F.zip_with(arr, broadcast_scalar(arr, F.array_max(arr)), lambda v, m: F.exp(v - m))


def normalise(x) -> Column:
    """x / sum(x) elementwise, the sum computed once per row."""
    arr = _c(x)
    return F.zip_with(arr, broadcast_scalar(arr, sum_array(arr)), lambda v, s: v / s)


def softmax_array(x) -> Column:
    """Stable softmax over an ARRAY<DOUBLE>; -inf entries become 0.

    Linear in the width.  For the cheapest plan materialise ``exp_shifted``
    as its own column first (see ``with_softmax``)."""
    return normalise(exp_shifted(x))


def with_softmax(df, col: str, out: str):
    """DataFrame step: ``out`` = softmax(``col``) with the exponentials computed
    exactly once per element (an intermediate column that Catalyst keeps,
    because the next projection references it more than once)."""
    tmp = f"__ex_{out}"
    return df.withColumn(tmp, exp_shifted(col)).withColumn(out, normalise(tmp)).drop(tmp)


def argmax_array(x) -> Column:
    """0-based index of the largest element; the lowest index wins ties."""
    arr = _c(x)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def md5_key(*parts) -> Column:
    """Repeatable pseudo-random order key (same text in Spark and DuckDB)."""
    return F.md5(F.concat_ws(":", *[_c(p).cast("string") for p in parts]))


def hex_uniform(*parts) -> Column:
    """U[0,1) from the first 8 hex digits of an md5 key."""
    h = F.substring(md5_key(*parts), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(4294967296.0)


def clip(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def item_curve(theta, a, b) -> Column:
    """P(correct) = sigmoid(sum_d clip(a_d * theta_d - b_d, -30, 30)).

    ``theta``, ``a`` and ``b`` are ARRAY<DOUBLE> of the same length D;
    clipping is per dimension, then the sum goes through the sigmoid.
    """
    terms = F.zip_with(
        F.zip_with(_c(a), _c(theta), lambda ai, ti: ai * ti),
        _c(b),
        lambda at, bi: F.least(F.greatest(at - bi, F.lit(-30.0)), F.lit(30.0)),
    )
    return sigmoid(sum_array(terms))


def avg_rank(partition_cols, value) -> Column:
    """Average (fractional) rank, 1-based, ties share the mean of their ranks."""
    v = _c(value)
    w = Window.partitionBy(*partition_cols).orderBy(v)
    ties = Window.partitionBy(*partition_cols, v)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def ntz_epoch_micros(x) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ wall-clock value read
    as UTC - plain calendar arithmetic, independent of the session time zone."""
    ts = _c(x)
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    secs = F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = (F.date_part(F.lit("SECOND"), ts) * F.lit(1000000)).cast("long")
    return days * F.lit(86400000000) + secs.cast("long") * F.lit(1000000) + micros


def ntz_to_instant(x) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP (instant) taking the wall clock as UTC, so
    event-time windows do not move with the session time zone."""
    return F.timestamp_micros(ntz_epoch_micros(x))
