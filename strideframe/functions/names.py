"""Channel and feature names: they carry the metadata, so they are parsed, not looked up."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column names, name patterns and default selections of the sensor data model.
TRIAL, TIME = "TRIAL", "TIME"
ACTIVITY, SPEED, INCLINE = "ACTIVITY", "SPEED", "INCLINE"
LABELS = ("ACTIVITY", "SPEED", "INCLINE")
KEYS = ("TRIAL", "TIME", "ACTIVITY", "SPEED", "INCLINE")
IMU_PATTERN = r"^(.*?)_(.*?)_(.*?)\.(.*?)$"
FOOT_SENSOR_PATTERN = r"^(.*?)_(left foot sensor|right foot sensor)\..*$"
MEASURES = ("global angle", "highg", "accel", "gyro", "mag")
LOCATIONS = ("foot_", "foot sensor", "shank", "thigh", "pelvis")
DIMENSIONS = ("x", "y", "z")
COMPONENTS = ("statistic", "measure", "location", "dimension")


def q(name: str) -> str:
    """Quote a column name: channel names hold dots and spaces."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def channel_columns(columns: Iterable[str], exclude: Iterable[str] = KEYS) -> list[str]:
    """Signal or feature columns: everything that is not a key or target."""
    dropped = set(exclude)
    return [c for c in columns if c not in dropped]


def feature_name(stat: str, channel: str) -> str:
    return f"{stat}_{channel}"


def selection_lists(
    measures: Sequence[str], locations: Sequence[str], dimensions: Sequence[str]
) -> tuple[list[str], list[str], list[str]]:
    """Lower-cased selection lists; a foot sensor has neither measure nor dimension in its label.

    The caller's lists are left as they are.
    """
    measures, dimensions = list(measures), list(dimensions)
    if "foot sensor" in locations:
        measures.append("sensor")
        dimensions += ["lfs", "rfs"]
    return (
        [m.lower() for m in measures],
        [loc.lower() for loc in locations],
        [f".{d.lower()}" for d in dimensions],
    )


def _any_of(parts: Iterable[str]) -> str:
    """Pattern for any of some literal parts."""
    return "|".join(re.escape(part) for part in parts)


def is_selected(
    label: Column,
    measures: Sequence[str] = MEASURES,
    locations: Sequence[str] = LOCATIONS,
    dimensions: Sequence[str] = DIMENSIONS,
) -> Column:
    """Whether a channel label names a wanted location, measure and dimension (long form)."""
    lowered = F.lower(label)
    measure, location, dimension = selection_lists(measures, locations, dimensions)
    return lowered.rlike(_any_of(location)) & lowered.rlike(_any_of(measure)) & lowered.rlike(_any_of(dimension))


def select_channels(
    columns: Iterable[str],
    measures: Sequence[str] = MEASURES,
    locations: Sequence[str] = LOCATIONS,
    dimensions: Sequence[str] = DIMENSIONS,
) -> list[str]:
    """The same choice over the columns of a wide table: no job, just a shorter select list."""
    wanted = selection_lists(measures, locations, dimensions)
    return [c for c in columns if all(any(part in c.lower() for part in parts) for parts in wanted)]


def fill_location(label: Column, location: Column, measures: Sequence[str] = MEASURES) -> Column:
    """``accel.x`` -> ``accel_<location>.x`` where a location is given; measures compare as given."""
    located = F.concat(F.lit("$1_"), F.nullif(location, F.lit("")), F.lit("."))
    return F.regexp_replace(label, rf"^({_any_of(measures)})\.", F.coalesce(located, F.lit("$0")))


def tidy_label(label: Column) -> Column:
    """Move a leading side behind the shank, then merge double underscores."""
    swapped = F.replace(label, F.lit("_l_shank"), F.lit("_shank_l"))
    return F.replace(swapped, F.lit("__"), F.lit("_"))


def component_columns(name: Column) -> dict[str, Column]:
    """Statistic, measure, location and dimension of a feature name.

    Names of neither form give NULLs; a foot sensor has no measure and no dimension.
    """
    imu = name.rlike(IMU_PATTERN)
    foot = name.rlike(FOOT_SENSOR_PATTERN)

    def part(imu_group: int, foot_group: int | None) -> Column:
        value = F.when(imu, F.regexp_extract(name, IMU_PATTERN, imu_group))
        if foot_group is not None:
            value = value.when(foot, F.regexp_extract(name, FOOT_SENSOR_PATTERN, foot_group))
        return value

    return {
        "statistic": part(1, 1),
        "measure": part(2, None),
        "location": part(3, 2),
        "dimension": part(4, None),
    }


def schema_components(columns: Iterable[str]) -> dict[str, list[str]]:
    """Distinct name components of a table's columns, for the run record (schema only, no rows)."""
    found: dict[str, set[str]] = {component: set() for component in COMPONENTS}
    for name in columns:
        imu = re.match(IMU_PATTERN, name)
        foot = re.match(FOOT_SENSOR_PATTERN, name)
        if imu:
            values = dict(zip(COMPONENTS, imu.groups(), strict=True))
        elif foot:
            values = {"statistic": foot.group(1), "location": foot.group(2)}
        else:
            values = {}
        for component, value in values.items():
            found[component].add(value)
    return {component: sorted(values) for component, values in found.items()}
