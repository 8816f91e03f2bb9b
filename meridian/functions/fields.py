"""Column functions: units, rounding, gaps, times, chunk numbers, scores, cycles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import canon


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def non_finite(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == float("inf"))


def convert(value: Column, units: Column, scale: Column, offset: Column) -> Column:
    """SI to the asked units, in double."""
    value = value.cast("double")
    return F.when(units == "human", value * scale + offset).otherwise(value)


def unit_label(units: Column, unit_si: Column, unit_human: Column) -> Column:
    return F.when(units == "human", unit_human).otherwise(unit_si)


def round_to(value: Column, digits: Column) -> Column:
    """Half-even to 0, 1, 2 or 3 digits by row."""
    return F.when(digits == 0, F.bround(value, 0)).when(digits == 1, F.bround(value, 1)).when(digits == 2, F.bround(value, 2)).otherwise(F.bround(value, 3))


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u.cast("double"), v.cast("double"))


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def coordinate(value: Column) -> Column:
    return F.bround(value, 6)


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, rounded down."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time)
    return F.floor(micros / F.lit(1_000_000)).cast("long")


def from_epoch(seconds: Column) -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def chunk_number(seconds: Column, epoch: int, step: int, span: int) -> Column:
    """Chunk of span steps that holds a moment; before the epoch it is negative."""
    return F.floor((seconds - epoch) / (step * span)).cast("long")


def chunk_begins(number: Column, epoch: int, step: int, span: int) -> Column:
    return (number * (step * span) + epoch).cast("long")


def eviction_score(cost_ms: Column, size: Column, age_s: Column, half_life_s: float = 86400.0) -> Column:
    """What a byte was worth to fetch, halved with each half-life since its last use."""
    return cost_ms / (size + 1) * F.pow(F.lit(0.5), F.greatest(age_s, F.lit(0.0)) / half_life_s)


def source_version(age_days: Column) -> Column:
    return F.when(age_days >= 90, "era5-final").otherwise("era5t")


def run_id(time: Column) -> Column:
    """Name of a run; null off the six-hour grid."""
    on_grid = (F.hour(time) % 6 == 0) & (F.minute(time) == 0) & (F.second(time) == 0)
    return F.when(on_grid, F.date_format(time, "yyyy-MM-dd'T'HH'Z'"))


def cycle_phase(since_init_s: Column) -> Column:
    """Phase of a cycle by the seconds since its start; a boundary belongs to the next phase."""
    return F.when(since_init_s < 25200, "wait").when(since_init_s < 30600, "poll").when(since_init_s < 34200, "fallback").otherwise("missed")


def suggested_stride(ny: Column, nx: Column, limit: int = canon.MAX_POINTS) -> Column:
    """Smallest stride that leaves at most limit nodes of an ny x nx window."""
    fits = lambda s: F.ceil(ny / s) * F.ceil(nx / s) <= limit
    return F.element_at(F.filter(F.sequence(F.lit(1), F.greatest(ny, nx, F.lit(1))), fits), 1)
