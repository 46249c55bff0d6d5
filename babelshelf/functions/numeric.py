"""Safe number parsing, percentages, the memory model and PCI bit fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT = r"^\s*[+-]?[0-9]+\s*$"
FLOAT = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?|nan)\s*$"
PERCENT = r"^([0-9]{1,3})(?:\.([0-9]+))?%$"


def parse_int(text: Column) -> Column:
    """DECIMAL(38,0), as the values may pass 64 bits; null where not an integer."""
    return F.when(text.rlike(INT), F.trim(text).try_cast("decimal(38,0)"))


def parse_float(text: Column) -> Column:
    """Double; a pattern guards the cast, which alone would take ``1d``."""
    return F.when(text.rlike(FLOAT), F.regexp_replace(F.trim(text), r"(?i)^([+-]?)inf(inity)?$", "$1Infinity").try_cast("double"))


def first_index(values: Column, value: Column) -> Column:
    """The place of the first equal value, from 0; null if there is none."""
    return (F.nullif(F.array_position(values, value), F.lit(0)) - 1).cast("int")


def is_percentage(value: Column) -> Column:
    return value.between(0.0, 1.0)


def parse_percent(text: Column, legacy: bool = False) -> Column:
    """``95%`` or ``12.5%`` as a share of 1. ``legacy`` takes all fraction digits as hundredths."""
    whole = F.nullif(F.regexp_extract(text, PERCENT, 1), F.lit("")).cast("double")
    digits = F.regexp_extract(text, PERCENT, 2)
    number = F.coalesce(F.nullif(digits, F.lit("")).cast("double"), F.lit(0.0))
    scale = F.lit(100.0) if legacy else F.pow(F.lit(10.0), F.length(digits))
    return (whole + number / scale) / 100


def format_percent(value: Column) -> Column:
    """Two digits, rounded by the exact value of the double and half to even; ``format_string`` rounds its shortest decimal text half up."""
    return F.concat(F.call_function("format_number", value * 100, F.lit("0.00")), F.lit("%"))


def linear_seconds(memory: Column, c: Column, m: Column) -> Column:
    """Seconds x with c + m x = memory; null if negative."""
    x = F.try_divide(memory - c, m)
    return F.when(x >= 0, x)


def quadratic_seconds(memory: Column, c: Column, b: Column, a: Column) -> Column:
    """The larger x with c + b x + a x^2 = memory; null if negative or not real."""
    disc = b * b - 4 * a * (c - memory)
    root = F.when(disc >= 0, F.sqrt(F.greatest(disc, F.lit(0.0))))
    x = F.greatest(F.try_divide(-b + root, 2 * a), F.try_divide(-b - root, 2 * a))
    return F.when(x >= 0, x)


def usable_memory(total: Column, available: Column, fullness: float = 0.95, keep_free: float = 0.10) -> Column:
    """Bytes of the target fullness that are left after what is in use; null if negative."""
    ours = F.bround(total * fullness, 0) - (total - available)
    return F.when(ours >= 0, F.bround(ours * (1 - keep_free), 0))


def shrunk(amount: Column, retries: Column, by: float = 0.075) -> Column:
    return amount * F.pow(F.lit(1 - by), retries)


def grown_reserve(keep_free: Column, retries: Column, by: float = 0.075) -> Column:
    """The reserve after so many retries, 1 at most."""
    return F.least(keep_free * F.pow(F.lit(1 + by), retries), F.lit(1.0))


def pci_fields(bdf: Column) -> list[Column]:
    """function (3 bits), device (5), bus (8) and domain (48) of a packed PCI address."""
    low = lambda shift, bits: F.shiftright(bdf, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return [low(0, 3).alias("function"), low(3, 5).alias("device"), low(8, 8).alias("bus"), low(16, 48).alias("domain")]


def format_pci(domain: Column, bus: Column, device: Column, function: Column) -> Column:
    """``dddd:bb:dd.f`` in lower-case hex."""
    return F.format_string("%04x:%02x:%02x.%x", domain, bus, device, function)


def parse_pci(text: Column) -> list[Column]:
    """Fields of ``domain:bus:device[.function]``, a missing function is 0; nulls where it has another shape."""
    shape = r"^([0-9a-fA-F]+):([0-9a-fA-F]+):([0-9a-fA-F]+)(?:\.([0-9a-fA-F]+))?$"
    part = lambda k: F.conv(F.nullif(F.regexp_extract(text, shape, k), F.lit("")), 16, 10).cast("long")
    function = F.when(part(1).isNotNull(), F.coalesce(part(4), F.lit(0)))
    return [part(1).alias("domain"), part(2).alias("bus"), part(3).alias("device"), function.alias("function")]
