"""Incident tables: canonical columns, source rows, per-domain fallback, idempotent refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions.text import strip
from faultline.session import materialise, read_latest, write_version
from faultline.sources.dropfiles import read_csv


def normalise_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical columns from any accepted spelling; an absent one is null. `keep` passes through."""
    chosen = [F.col(name) for name in keep]
    for canonical in schema.CANONICAL:
        found = [
            F.col(f"`{name}`") for name in df.columns if schema.COLUMN_ALIASES.get(name) == canonical
        ]
        value = F.coalesce(*found) if found else F.lit(None)
        chosen.append(value.cast("string").alias(canonical))
    return df.select(*chosen)


def load_incidents(
    spark: SparkSession, path: str, fmt: str = "parquet", multiline: bool = True
) -> DataFrame:
    """Read an incident table; raises FileNotFoundError when there is none.

    A CSV whose narratives may hold line breaks takes a pass over its lines to find its records;
    `multiline=False` saves it where no field holds one. Big files are split either way.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, quote='"', escape='"')
    try:
        return normalise_columns(read_csv(spark, path) if fmt == "csv" and multiline else reader.load(path))
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no incident table at {path}") from exc
        raise


def source_rows(
    rows: DataFrame,
    order_by: str,
    narrative: str = "Report 1_Narrative",
    label: str = "Events_Anomaly",
    cap: int | None = None,
) -> DataFrame:
    """Landed source rows with both fields filled; all of them, or the first `cap` in source order."""
    both = rows.select(
        F.col(order_by),
        strip(F.col(f"`{narrative}`")).alias("narrative"),
        strip(F.col(f"`{label}`")).alias("label"),
    ).filter("narrative <> '' and label <> ''")
    return both if cap is None else both.orderBy(order_by).limit(cap)


def with_fallback(fresh: DataFrame | None, cached: DataFrame | None) -> DataFrame:
    """Fresh rows, and the cached rows of every domain that has no fresh row.

    The delivered domains are written out: few and of known size, they go to the cached rows, which would
    otherwise meet in one task per domain.
    """
    if fresh is None and cached is None:
        raise RuntimeError("no source delivered rows and there is no cached table")
    if fresh is None:
        return cached
    if cached is None:
        return fresh
    fresh = materialise(fresh, "fresh-rows")
    delivered = materialise(fresh.select(F.col("domain").alias("_delivered")).distinct(), "delivered-domains")
    missing = cached.join(delivered, F.col("domain").eqNullSafe(F.col("_delivered")), "left_anti")
    return fresh.unionByName(missing)


def refresh(
    spark: SparkSession,
    path: str,
    build: Callable[[DataFrame | None], DataFrame],
    force: bool = False,
) -> DataFrame:
    """The stored table, built first when absent or forced.

    `build` gets the cached table for its fallback. The result becomes a new version, so it may
    be computed from the version it replaces.
    """
    cached = read_latest(spark, path)
    if cached is not None and not force:
        return cached
    write_version(build(cached), path, partition_by="domain")
    return read_latest(spark, path)
