"""Relative-time labels and heatmap levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(n: Column, unit: str) -> Column:
    return F.when(n == 1, F.lit(f"1 {unit} ago")).otherwise(
        F.concat(n.cast("string"), F.lit(f" {unit}s ago")))


def relative_time(ts_ms: Column | str, as_of_ms: Column | int) -> Column:
    """"N day(s)/hour(s)/minute(s) ago" or "A few moments ago".

    ``as_of_ms`` is an explicit argument (not the wall clock) so results are
    reproducible; timestamps in the future count as zero.
    """
    ts = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    now = F.lit(as_of_ms) if isinstance(as_of_ms, int) else as_of_ms
    delta = F.greatest(now - ts, F.lit(0))
    mins = F.floor(delta / 60000)
    hours = F.floor(delta / 3600000)
    days = F.floor(delta / 86400000)
    return (F.when(days > 0, _unit(days, "day"))
            .when(hours > 0, _unit(hours, "hour"))
            .when(mins > 0, _unit(mins, "minute"))
            .otherwise(F.lit("A few moments ago")))


# Heatmap level thresholds (level i starts at HEAT_THRESHOLDS[i]).
HEAT_THRESHOLDS = [0, 1, 3, 6, 11, 21]


def heat_level(count: Column | str) -> Column:
    """Activity level 0-5 of a daily count."""
    c = F.col(count) if isinstance(count, str) else count
    expr = F.lit(0)
    for level, lo in enumerate(HEAT_THRESHOLDS):
        if level:
            expr = F.when(c >= lo, F.lit(level)).otherwise(expr)
    return expr
