"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")


def _shortest(x: Column) -> Column:
    """A number of two decimals without trailing zeros but with one decimal at least: 1.0, 2.5, 3.14."""
    return F.regexp_replace(F.format_string("%.2f", x), "0$", "")


def convert_size(size: Column, largest: str = UNITS[-1]) -> Column:
    """Bytes as text in units of powers of 1000 up to the ``largest``, two decimals: 1.5 KB; 0B for nothing."""
    power = F.lit(0)
    for i in range(1, UNITS.index(largest) + 1):
        power = F.when(size >= float(1000**i), F.lit(i)).otherwise(power)
    value = F.floor(size.cast("double") / F.pow(F.lit(1000.0), power) * 100 + 0.5) / 100
    return F.when(size == 0, F.lit("0B")).otherwise(F.concat(_shortest(value), F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in UNITS]), power + 1)))


def snake_case(text: Column) -> Column:
    """CamelCase as snake_case."""
    spaced = F.regexp_replace(text, "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(spaced, "([a-z0-9])([A-Z])", "$1_$2"))


def model_name(text: Column) -> Column:
    """Every capital but a leading one begins a part."""
    return F.lower(F.regexp_replace(text, "(?<!^)(?=[A-Z])", "_"))


def parse_elapsed(text: Column) -> Column:
    """Seconds of ``1m2.345s``; the digits after the point are thousandths, however many there are."""
    pattern = r"(\d+)m(\d+)\.(\d+)s"
    part = lambda i: F.regexp_extract(text, pattern, i).cast("double")
    return F.when(text.rlike(pattern), part(1) * 60 + part(2) + part(3) / 1000)


def pattern_of(name: Column) -> Column:
    """accessSeqRead as Seq."""
    return F.regexp_extract(name, "access(.*?)(?:Read|Write)", 1)


def model_pattern(pattern: Column) -> Column:
    """The performance model's name of an access pattern."""
    low = F.lower(pattern)
    return F.when(low == "str", F.lit("stride")).otherwise(low)


def share(active: Column) -> Column:
    """Compute-share factor of n concurrent users: sqrt(1 + n) / sqrt(2)."""
    return F.sqrt(1 + active) / F.sqrt(F.lit(2.0))


def blend(seq: Column, rand: Column, ratio: Column, cores: Column = None, unit: float = 1e6) -> Column:
    """Bandwidth of a mix of sequential and random access."""
    return (seq * ratio + rand * (1 - ratio)) * (F.lit(1) if cores is None else cores) * F.lit(unit)


def pattern_from_ratio(ratio: Column) -> Column:
    return F.when(ratio > 0.5, F.lit("seq")).otherwise(F.lit("rand"))


def chosen_bandwidth(predicted: Column, seq: Column, rand: Column, ratio: Column, constant: Column, text: Column) -> Column:
    """The first that is known: a model's, a mix of sequential and random access, a number, a number as text."""
    return F.coalesce(predicted.cast("double"), blend(seq, rand, ratio, unit=1.0), constant.cast("double"), text.try_cast("double"))


def override(own: Column, both: Column, tier: Column) -> Column:
    """A phase's bandwidth: its side's own where given, then the one for both sides, else the tier's; 0 isn't given."""
    return F.coalesce(F.nullif(own, F.lit(0)), F.nullif(both, F.lit(0)), tier)


def routed(volume: Column, read: Column, write: Column, operation: Column, default: float = 1e9) -> dict[str, Column]:
    """Read and write volumes: a single volume goes to the operation's side, which without any has a default."""
    side = lambda name, own: F.when(operation == name, F.coalesce(F.nullif(volume, F.lit(0)), own, F.lit(default)))
    return {
        "read_volume": side("read", read).when(operation == "write", 0.0).otherwise(read),
        "write_volume": side("write", write).when(operation == "read", 0.0).otherwise(write),
    }


def has_extension(path: Column, extension: str) -> Column:
    """Case counts."""
    return path.endswith(extension)


def operations(volume: Column, io_size: Column) -> Column:
    """Whole operations of a size in a volume, 0 without a size."""
    return F.coalesce(F.floor(F.try_divide(volume.cast("double"), io_size.cast("double"))), F.lit(0)).cast("long")


def lead_of(pattern: Column) -> Column:
    return F.when(pattern == "stride", 3).otherwise(1)


def scatter_of(pattern: Column) -> Column:
    return F.when(pattern == "rand", F.lit(1_000_000_000)).otherwise(F.lit(0)).cast("long")


def capped(volume: Column, other: Column, cap: float = 1e9) -> Column:
    """The volume, scaled with ``other`` where both together exceed the cap."""
    total = volume + other
    return F.when(total > cap, F.lit(cap) * volume / total).otherwise(volume.cast("double"))


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def upper_at(text: Column, positions: list[int]) -> Column:
    """The characters at these positions, from 0, in upper case."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(i.isin(*positions), F.upper(c)).otherwise(c)), "")
