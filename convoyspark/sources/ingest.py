"""Which data sets a load refreshes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from convoyspark.sinks import snapshots as sink
from convoyspark.sources import files, snapshots

# Data set -> file-name pattern (CSV) or file name (GeoJSON).
CSV_SETS = {"camps": "assign_camp", "residences": "assign_residences", "simulation": "simulation_data_view_v2"}
EXIT_FILES = {"exit_routes": "MIN_MINASM.geojson", "exit_points": "ExitPoints.geojson"}
PREFERRED_SIMULATION = "simulation_data_view_updated.csv"

# What a load may be asked for.
REQUESTS = {
    "all": ("camps", "residences", "simulation", "exit-paths"),
    "both": ("camps", "residences"),
    "camps": ("camps",),
    "residences": ("residences",),
    "simulation": ("simulation",),
    "data": ("simulation",),
    "exit-paths": ("exit-paths",),
}

_READERS = {"camps": files.read_camps, "residences": files.read_residences, "simulation": files.read_plans}


def requested_sets(request: str) -> tuple[str, ...]:
    """Data sets of a request; any other text is a file name and chooses by what it contains."""
    named = REQUESTS.get(request.lower())
    if named is not None:
        return named
    words = {"camps": ("camp",), "residences": ("residence",), "simulation": ("simulation", "data")}
    return tuple(name for name, marks in words.items() if any(m in request.lower() for m in marks))


def ingest(spark: SparkSession, folder: str, target: str, request: str = "all") -> dict[str, DataFrame]:
    """Read what was asked for, newest file first, publish each set, and return the tables.

    Exit routes and points must both be there; asked for by name, their absence
    is an error, otherwise they are skipped.  Nothing found at all is an error.
    """
    done: dict[str, DataFrame] = {}
    for name in requested_sets(request):
        if name == "exit-paths":
            strict = request.lower() == "exit-paths"
            paths = {k: os.path.join(folder, v) for k, v in EXIT_FILES.items()}
            tables = {k: files.read_features(spark, p, strict=strict) for k, p in paths.items()}
            if not any(df.isEmpty() for df in tables.values()):
                done |= {k: sink.publish(df, os.path.join(target, k), source=paths[k]) for k, df in tables.items()}
            continue
        by_name = None if request.lower() in REQUESTS else os.path.join(folder, request)
        preferred = PREFERRED_SIMULATION if name == "simulation" else None
        path = by_name or snapshots.latest_file(spark, folder, CSV_SETS[name], preferred)
        if path is not None:
            done[name] = sink.publish(_READERS[name](spark, path), os.path.join(target, name), source=path)
    if not done:
        raise FileNotFoundError(f"no data files for {request!r} in {folder}")
    return done
