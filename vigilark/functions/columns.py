"""Column expressions shared by the operators. Everything here stays on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def blank_to_null(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def zero_to_null(c: Column) -> Column:
    """Zero counts as missing (ports)."""
    return F.nullif(c, F.lit(0))


def first_present(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def is_filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def banded(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first step whose floor the value reaches; steps come highest first."""
    floor, label = steps[0]
    out = F.when(value >= floor, label)
    for floor, label in steps[1:]:
        out = out.when(value >= floor, label)
    return out.otherwise(otherwise)


def level_to_band(level: Column) -> Column:
    from vigilark.dims import DEFAULT_LEVEL_BAND, LEVEL_BANDS

    # NaN sorts above every number, so it is turned into null first
    known = F.when(~F.isnan(level.cast("double")), level)
    return banded(known, LEVEL_BANDS, DEFAULT_LEVEL_BAND)


def risk_band(score: Column) -> Column:
    """Half-open score intervals; null, NaN and out-of-range scores are 'unknown'."""
    from vigilark.dims import RISK_BANDS, UNKNOWN_RISK_BAND

    out = F.when(F.isnan(score.cast("double")), UNKNOWN_RISK_BAND)
    for low, high, label in RISK_BANDS:
        out = out.when((score >= low) & (score < high), label)
    return out.otherwise(UNKNOWN_RISK_BAND)


def inbound(flow_dest_ip: Column, monitored_ip: str | None) -> Column:
    if not monitored_ip:
        return F.lit(False)
    return F.coalesce(flow_dest_ip == monitored_ip, F.lit(False))


def outbound(flow_src_ip: Column, monitored_ip: str | None) -> Column:
    if not monitored_ip:
        return F.lit(False)
    return F.coalesce(flow_src_ip == monitored_ip, F.lit(False))


def in_cidr(ip: Column, cidr: str) -> Column:
    """Membership of a dotted address in an IPv4 network.

    Whole octets of the prefix compare as text; only a prefix ending inside an
    octet looks at that octet's number.
    """
    import ipaddress

    net = ipaddress.IPv4Network(cidr)
    first, last = str(net.network_address).split("."), str(net.broadcast_address).split(".")
    whole, rest = divmod(net.prefixlen, 8)
    if whole == 4:
        hit = ip == str(net.network_address)
    else:
        hit = ip.startswith("".join(f"{o}." for o in first[:whole])) if whole else ip.contains(".")
    if rest:
        octet = F.substring_index(F.substring_index(ip, ".", whole + 1), ".", -1).try_cast("int")
        hit = hit & octet.between(int(first[whole]), int(last[whole]))
    return F.coalesce(hit, F.lit(False))


def percent_text(ratio: Column) -> Column:
    """Whole percent, ties to even."""
    return F.concat(F.bround(ratio * F.lit(100.0), 0).cast("long").cast("string"), F.lit("%"))


def window_start(ts: Column, ts_type: str, minutes: float) -> Column:
    """Start of the tumbling window holding ts.

    Windows restart at each hour. Widths dividing the hour use the built-in
    window expression; others floor the minute within the hour (wider than an
    hour means the hour); below one minute the start is the whole second.
    """
    if minutes >= 1:
        width = int(minutes)
        if 60 % width == 0:
            return F.window(ts, f"{width} minutes").start
        minute = (F.floor(F.minute(ts) / F.lit(width)) * width).cast("int")
        start = F.date_trunc("hour", ts) + F.make_dt_interval(mins=minute)
        return start.cast(ts_type)
    return F.date_trunc("second", ts).cast(ts_type)


def micros(ts: Column) -> Column:
    """Timestamp (with or without zone) as whole microseconds since 1970 UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column, ts_type: str) -> Column:
    return F.timestamp_micros(us).cast(ts_type)


def whole_steps(value: Column, step: int | Column) -> Column:
    """How many whole steps fit below a whole number, exactly (floor of the quotient)."""
    step = F.lit(step) if isinstance(step, int) else step
    return ((value - F.pmod(value, step)) / step).cast("long")


def ratio(num: Column, den: Column) -> Column:
    """Division giving null on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def count_where(cond: Column) -> Column:
    """Number of rows where cond holds, 0 over no rows."""
    return F.count(F.when(cond, 1))
