"""Scans of acquisitions, maps and image series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element types that a tensor file may hold.
NUMBERS = (T.FloatType, T.DoubleType)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def import_tensor(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A tensor in long form: index columns of integers, re and im of floats or doubles; other types are refused."""
    df = spark.read.format(fmt).options(**options).load(path)
    for f in df.schema.fields:
        if f.name in ("re", "im") and not isinstance(f.dataType, NUMBERS):
            raise TypeError(f"{f.name} is {f.dataType.simpleString()}, not float or double")
    return df.withColumns({c: F.col(c).cast("double") for c in ("re", "im") if c in df.columns})


def load_raw(spark: SparkSession, path: str, coords: bool = True, kdata: bool = True, weights: bool = True, gating: tuple[str, ...] = (), fmt: str = "parquet") -> DataFrame:
    """Samples (enc, coil, spoke, s, kx, ky, kz, w, re, im, gating...); what is not asked for is not read."""
    names = ["enc", "coil", "spoke", "s"] + ["kx", "ky", "kz"] * coords + ["re", "im"] * kdata + ["w"] * weights + list(gating)
    return spark.read.format(fmt).load(path).select(*names)


def load_maps(spark: SparkSession, path: str, zoom: dict[str, tuple[int, int]] | None = None, fmt: str = "parquet") -> DataFrame:
    """Coil maps (coil, axes..., re, im); an axis named in `zoom` goes from its old to its new number of places, on lines between neighbours."""
    from tensorloom.operators.reshape import zoom_linear

    maps = import_tensor(spark, path, fmt)
    for axis, (old, new) in (zoom or {}).items():
        keys = [c for c in maps.columns if c not in ("re", "im", axis)]
        parts = [zoom_linear(maps, axis, old, new, v, *keys) for v in ("re", "im")]
        maps = parts[0].join(parts[1], [*keys, axis])
    return maps


def load_keyed(spark: SparkSession, path: str, pattern: str = r"_f(\d+)_e(\d+)") -> DataFrame:
    """Files named by frame and encode; both become columns."""
    name = F.input_file_name()
    return spark.read.option("recursiveFileLookup", "true").parquet(path).withColumns({"frame": F.regexp_extract(name, pattern, 1).cast("int"), "enc": F.regexp_extract(name, pattern, 2).cast("int")})


def frame_counts(keyed: DataFrame) -> DataFrame:
    return keyed.agg(F.count_distinct("frame").alias("frames"), F.count_distinct("enc").alias("encodes"))


def mean_image(cube: DataFrame, over: tuple[str, ...] = ("frame",)) -> DataFrame:
    keys = [c for c in cube.columns if c not in (*over, "re", "im")]
    return cube.groupBy(*keys).agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
