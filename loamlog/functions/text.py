"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_first_second(ts: Column) -> Column:
    return F.unix_timestamp(F.date_trunc("day", ts))


def day_last_second(ts: Column) -> Column:
    return F.unix_timestamp(F.date_trunc("day", ts) + F.expr("interval 1 day")) - 1


def from_yyyymmdd(text: Column) -> Column:
    """The date of eight digits, null for what is none."""
    return F.when(F.length(text) == 8, F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd"))))


def is_leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def days_of_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def days_ago(day: Column, n: int) -> Column:
    return F.date_sub(day, n)


def ts_repr(ts: Column) -> Column:
    return F.date_format(ts, "yyyy.MM.dd HH:mm:ss")


def size_repr(size: Column) -> Column:
    """A size with its unit, up to two decimals: ``1.5kb``."""
    out = F.concat(size.cast("string"), F.lit("b"))
    for power, unit in ((1, "kb"), (2, "mb"), (3, "gb"), (4, "tb")):
        number = F.rtrim(F.format_string("%.2f", size / float(1 << 10 * power)), F.lit("0"))
        out = F.when(size >= 1 << 10 * power, F.concat(F.rtrim(number, F.lit(".")), F.lit(unit))).otherwise(out)
    return out


def dotnotation_repr(value: Column) -> Column:
    return F.format_number(value, 0)


def duration_repr(us: Column) -> Column:
    """Microseconds as ``999us``, ``0.002s`` (up to three decimals), ``2m5s`` or ``1h30m``; a second part of zero is left out."""
    seconds = F.floor(us / 1_000_000)
    decimals = F.rtrim(F.rtrim(F.format_string("%.3f", us / 1_000_000.0), F.lit("0")), F.lit("."))
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)

    def parts(large: Column, unit: str, small: Column, then: str) -> Column:
        return F.concat(large.cast("string"), F.lit(unit), F.when(small > 0, F.concat(small.cast("string"), F.lit(then))).otherwise(""))

    out = F.when(us < 1000, F.concat(us.cast("string"), F.lit("us"))).when(us < 60_000_000, F.concat(decimals, F.lit("s")))
    return out.when(us < 3_600_000_000, parts(minutes, "m", seconds % 60, "s")).otherwise(parts(hours, "h", minutes % 60, "m"))


def divided(text: Column, separator: str) -> tuple[Column, Column]:
    """What stands before and after the first separator; all and nothing without one."""
    at = F.locate(separator, text)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substring(text, at + len(separator), F.length(text))).otherwise(F.lit(""))


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def strip_suffix(text: Column, suffix: str) -> Column:
    return F.when(F.endswith(text, F.lit(suffix)), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def all_digits(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^[0-9]+\z"))


def parse_integer(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"^-?[0-9]+\z")), text.try_cast("bigint"))


def parse_double(text: Column) -> Column:
    """A number with an optional sign, fraction and exponent; null for anything else."""
    return F.when(F.rlike(text, F.lit(r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\z")), text.try_cast("double"))


def fnv1_64(data: Column) -> Column:
    """The 64-bit FNV-1 hash of bytes, as a signed number: a fold over the bytes, each multiplied in and then xored."""
    # Offset basis 14695981039346656037 and prime 1099511628211 = 2**40 + 435, of which products wrap at 64 bits.
    low32 = F.lit((1 << 32) - 1)

    def step(h: Column, byte: Column) -> Column:
        # h * prime without overflow: halves of h times 435, and h shifted by 40
        low, high = h.bitwiseAND(low32) * 435, F.shiftrightunsigned(h, 32) * 435
        high = (high + F.shiftrightunsigned(low, 32)).bitwiseAND(low32)
        shifted = F.shiftleft(h, 40)
        product = F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(low32))
        carry_low = product.bitwiseAND(low32) + shifted.bitwiseAND(low32)
        carry_high = F.shiftrightunsigned(product, 32) + F.shiftrightunsigned(shifted, 32) + F.shiftrightunsigned(carry_low, 32)
        return F.shiftleft(carry_high.bitwiseAND(low32), 32).bitwiseOR(carry_low.bitwiseAND(low32)).bitwiseXOR(byte)

    hexed = F.hex(data)
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.substring(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(F.when(F.octet_length(data) > 0, octets).otherwise(F.array().cast("array<bigint>")), F.lit(14695981039346656037 - (1 << 64)), step)


def hours_ago(hour: Column, n: int) -> Column:
    """The hour of the day ``n`` hours before."""
    return F.pmod(hour - n, F.lit(24)).cast("int")


def hours_later(hour: Column, n: int) -> Column:
    return hours_ago(hour, -n)


def to_base(value: Column, base: int) -> Column:
    """Digits of a non-negative number in a base from 2 to 36, in lower case."""
    return F.lower(F.conv(value.cast("string"), 10, base))


def from_base(text: Column, base: int) -> Column:
    return F.conv(text, base, 10).cast("bigint")


def is_valid_topic_name(name: Column) -> Column:
    """1 to 64 of ``[A-Za-z0-9_-]``, without ``-`` or ``_`` at either end."""
    return F.coalesce(F.length(name).between(1, 64) & F.rlike(name, F.lit(r"^[A-Za-z0-9]([A-Za-z0-9_-]*[A-Za-z0-9])?\z")), F.lit(False))


def normalized_max_wait(ms: Column) -> Column:
    """0 stays; else at most an hour, rounded up to 64 ms, and 320 at least."""
    return F.when(ms == 0, 0).otherwise(F.greatest(F.lit(320), F.ceil(F.least(ms, F.lit(3_600_000)) / 64) * 64)).cast("long")


def normalize_wakeup_time(ms: Column) -> Column:
    return (F.ceil(ms / 128) * 128).cast("long")


def seconds_delta(end: Column, start: Column) -> Column:
    """Difference of two times in seconds, 0 where it would be negative."""
    return F.greatest(end - start, F.lit(0)).cast("long")


def reconnect_backoff(attempt: Column) -> Column:
    return (F.pow(F.lit(2), attempt) * (128 + 16)).cast("long")
