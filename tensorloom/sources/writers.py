"""Sinks: images and maps by frame and encode, error curves, iteration callbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def write_image(cube: DataFrame, path: str, by: tuple[str, ...] = ("frame", "enc"), mode: str = "error") -> None:
    """One folder for each frame and encode, where those columns exist."""
    cube.write.mode(mode).partitionBy(*[c for c in by if c in cube.columns]).parquet(path)


def write_curve(errors: list[float], spark, path: str, mode: str = "error") -> None:
    spark.createDataFrame(list(enumerate(errors)), "iteration int, error double").coalesce(1).write.mode(mode).parquet(path)


def each_iteration(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Several callbacks of a solver as one."""

    def call(x: DataFrame, k: int) -> None:
        for sink in sinks:
            sink(x, k)

    return call
