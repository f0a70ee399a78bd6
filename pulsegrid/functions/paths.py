"""Columns hidden in file paths: `[prefix/]asset/yyyy/mm[/dd[/hh]]/sensor[suffix].parquet`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Folders that hold no assets, and what file names end with, by the kind of tree.
NO_ASSETS = ("aggregated", "daily", "cache")
HOUR_OF_FILE = r"(_\d{8}_\d{2})?"
GRAIN_SUFFIXES = ("_minute", "_hour", "_day")


@dataclass(frozen=True)
class TreeLayout:
    """A tree of files below `prefix`: how many of year, month, day and hour are folders, and the suffix of file names."""

    prefix: str
    levels: int
    suffix: str

    @property
    def period(self) -> str:
        """The time one folder holds."""
        return {2: "month", 3: "day", 4: "hour"}[self.levels]

    @property
    def pattern(self) -> str:
        """Matches whole paths; groups are the asset and the folders of time."""
        above = f"/{self.prefix}" if self.prefix else "".join(f"(?<!/{name})" for name in NO_ASSETS)
        folders = r"/(\d{4})" + r"/(\d{2})" * (self.levels - 1)
        others = "" if self.suffix else "".join(f"(?<!{suffix})" for suffix in GRAIN_SUFFIXES)
        return rf"{above}/([^/]+){folders}/[^/]+{self.suffix}{others}\.parquet$"


# Readings by hour; minutes by hour or by day; hours by day or by month; days by month.
LAYOUTS = {
    "raw": TreeLayout("", 4, ""),
    "minute": TreeLayout("aggregated", 4, "_minute"),
    "minute_by_day": TreeLayout("aggregated", 3, ""),
    "hour": TreeLayout("aggregated", 3, "_hour"),
    "hour_by_month": TreeLayout("daily", 2, ""),
    "day": TreeLayout("daily", 2, "_day"),
}
RAW = LAYOUTS["raw"]


def sensor_of(path: Column, layout: TreeLayout = RAW) -> Column:
    """Sensor from the file name, without the suffix of the layout or an optional `_yyyymmdd_hh`."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, rf"{layout.suffix or HOUR_OF_FILE}\.parquet$", "")


def asset_of(path: Column, layout: TreeLayout = RAW) -> Column:
    """Asset directory of the layout; NULL elsewhere."""
    return F.nullif(F.regexp_extract(path, layout.pattern, 1), F.lit(""))


def folder_time(path: Column, layout: TreeLayout = RAW) -> Column:
    """Start of the time the file's folder holds; NULL outside the layout."""
    year, month, *rest = [F.regexp_extract(path, layout.pattern, group) for group in range(2, 2 + layout.levels)]
    day = rest[0] if rest else F.lit("01")
    hour = rest[1] if len(rest) > 1 else F.lit("00")
    text = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), hour, F.lit(":00:00"))
    return F.when(path.rlike(layout.pattern), F.try_to_timestamp(text).cast("timestamp_ntz"))


def hour_of(path: Column) -> Column:
    """Start of the hour the file holds; NULL outside the hourly layout."""
    return folder_time(path, RAW)
