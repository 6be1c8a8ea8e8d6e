"""Acquisitions in array files by frame and encode, as a Spark data source.

A folder (searched to its depth) holds one NumPy file for each quantity, frame and encode: `coords_f3_e1.npy` (axes x samples),
`kdata_f3_e1.npy` (coils x samples, complex or real) and `weights_f3_e1.npy` (samples). Partitions are planned from names
and sizes alone, so that no file is opened on the driver: each is one frame and encode, or a range of its samples where
its files are large. Filters on frame and enc choose files, filters on coil choose the rows of `kdata` that are read, and
files of a quantity that is not asked for are never opened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

FORMAT = "frame_arrays"
QUANTITIES = ("coords", "kdata", "weights")
PATTERN = r"(?P<quantity>coords|kdata|weights)_f(?P<frame>\d+)_e(?P<enc>\d+)\.npy$"
#: Bytes of its files that a partition reads, and samples of a batch.
PART_BYTES, BATCH = 64 << 20, 1 << 16

_COLUMNS = {
    "coords": [("kx", T.DoubleType()), ("ky", T.DoubleType()), ("kz", T.DoubleType())],
    "kdata": [("coil", T.IntegerType()), ("re", T.DoubleType()), ("im", T.DoubleType())],
    "weights": [("w", T.DoubleType())],
}


def _schema(asked: list[str]) -> T.StructType:
    names = [("frame", T.IntegerType()), ("enc", T.IntegerType()), ("s", T.LongType())]
    return T.StructType([T.StructField(n, t) for n, t in names + [c for q in QUANTITIES if q in asked for c in _COLUMNS[q]]])


def _holds(test: ds.Filter, value: int | None) -> bool:
    """Whether `value` passes; a comparison with null passes nothing."""
    if isinstance(test, ds.IsNotNull):
        return value is not None
    if isinstance(test, ds.In):
        return value is not None and value in test.value
    if value is None or test.value is None:
        return False
    if isinstance(test, ds.EqualTo):
        return value == test.value
    if isinstance(test, ds.GreaterThan):
        return value > test.value
    if isinstance(test, ds.GreaterThanOrEqual):
        return value >= test.value
    if isinstance(test, ds.LessThan):
        return value < test.value
    return value <= test.value


_KNOWN = (ds.EqualTo, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.IsNotNull)


@dataclass
class Part(ds.InputPartition):
    """The share `index` of `parts` of the samples of one frame and encode, and its files by quantity."""

    frame: int
    enc: int
    index: int
    parts: int
    files: dict[str, str] = field(default_factory=dict)


class _Array:
    """An open file of one array, of which ranges of samples (the last axis) are read; at most two axes."""

    def __init__(self, source: fs.FileSystem, path: str, axes: int) -> None:
        self.path, self.file = path, source.open_input_file(path)
        version = np.lib.format.read_magic(self.file)
        header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, self.fortran, self.kind = header(self.file)
        if len(self.shape) != axes or self.kind.kind not in "fc":
            raise TypeError(f"{path} holds {self.kind} of shape {self.shape}, not floats or complex numbers on {axes} axes")
        self.start, self.samples = self.file.tell(), self.shape[-1]
        self.rows = self.shape[0] if axes == 2 else 1

    def read(self, row: int, begin: int, end: int) -> np.ndarray:
        size = self.kind.itemsize
        if self.fortran and self.rows > 1:
            self.file.seek(self.start + begin * self.rows * size)
            return np.frombuffer(self.file.read((end - begin) * self.rows * size), self.kind).reshape(-1, self.rows)[:, row]
        self.file.seek(self.start + (row * self.samples + begin) * size)
        return np.frombuffer(self.file.read((end - begin) * size), self.kind)


class _Reader(ds.DataSourceReader):
    def __init__(self, path: str, asked: list[str], pattern: str, part_bytes: int) -> None:
        self.path, self.asked, self.pattern, self.part_bytes = path, asked, pattern, part_bytes
        self.tests: list[tuple[str, ds.Filter]] = []

    def pushFilters(self, filters):
        for test in filters:
            attribute = getattr(test, "attribute", ())  # a negated filter has none, and stays with Spark
            name = attribute[0] if len(attribute) == 1 else ""
            if isinstance(test, _KNOWN) and name in ("frame", "enc", *["coil"] * ("kdata" in self.asked)):
                self.tests.append((name, test))
            else:
                yield test

    def _pass(self, name: str, value: int | None) -> bool:
        return all(_holds(test, value) for n, test in self.tests if n == name)

    def partitions(self) -> list[Part]:
        source, root = _opened(self.path)
        found: dict[tuple[int, int], dict[str, str]] = {}
        sizes: dict[tuple[int, int], int] = {}
        for info in source.get_file_info(fs.FileSelector(root, recursive=True)):
            name = re.search(self.pattern, info.base_name) if info.type == fs.FileType.File else None
            if name is None or name["quantity"] not in self.asked:
                continue
            key = int(name["frame"]), int(name["enc"])
            if not (self._pass("frame", key[0]) and self._pass("enc", key[1])):
                continue
            files = found.setdefault(key, {})
            if name["quantity"] in files:
                raise ValueError(f"two files of {name['quantity']} for frame {key[0]}, encode {key[1]}: {files[name['quantity']]}, {info.path}")
            files[name["quantity"]] = info.path
            sizes[key] = sizes.get(key, 0) + info.size
        plan = []
        for key, files in sorted(found.items()):
            parts = max(1, -(-sizes[key] // self.part_bytes))
            plan += [Part(*key, i, parts, files) for i in range(parts)]
        return plan

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        source, _ = _opened(self.path)
        arrays = {q: _Array(source, p, 1 if q == "weights" else 2) for q, p in part.files.items()}
        lengths = {a.path: a.samples for a in arrays.values()}
        if len(set(lengths.values())) > 1:
            raise ValueError(f"files of one frame and encode differ in their number of samples: {lengths}")
        total = next(iter(lengths.values()))
        first, last = total * part.index // part.parts, total * (part.index + 1) // part.parts
        schema = pa.schema([(f.name, {"integer": pa.int32(), "long": pa.int64()}.get(f.dataType.typeName(), pa.float64())) for f in _schema(self.asked)])
        k = arrays.get("kdata")
        coils = [c for c in (range(k.rows) if k else [None]) if self._pass("coil", c)]
        for begin in range(first, last, BATCH):
            end = min(begin + BATCH, last)
            n = end - begin
            shared = {"frame": np.full(n, part.frame), "enc": np.full(n, part.enc), "s": np.arange(begin, end)}
            if "coords" in arrays:
                shared |= {c: arrays["coords"].read(i, begin, end) for i, c in enumerate(("kx", "ky", "kz")) if i < arrays["coords"].rows}
            if "weights" in arrays:
                shared["w"] = arrays["weights"].read(0, begin, end)
            for c in coils:
                values = dict(shared)
                if k:
                    z = k.read(c, begin, end)
                    values |= {"coil": np.full(n, c), "re": z.real, "im": z.imag}
                columns = [pa.array(np.ascontiguousarray(values[f.name]).astype(f.type.to_pandas_dtype())) if f.name in values else pa.nulls(n, f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


class FrameArrays(ds.DataSource):
    """Options: `quantities` (of coords, kdata, weights, comma-joined; all), `pattern` (of file names, with the groups quantity, frame and enc), `part_bytes`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _asked(self) -> list[str]:
        asked = [q.strip() for q in self.options.get("quantities", ",".join(QUANTITIES)).split(",")]
        if not asked or not {*asked} <= {*QUANTITIES}:
            raise ValueError(f"quantities are {', '.join(QUANTITIES)}, not {asked}")
        return asked

    def schema(self) -> T.StructType:
        return _schema(self._asked())

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], self._asked(), self.options.get("pattern", PATTERN), int(self.options.get("part_bytes", PART_BYTES)))


def load_arrays(spark: SparkSession, path: str, coords: bool = True, kdata: bool = True, weights: bool = True, **options) -> DataFrame:
    """Samples (frame, enc, s, kx, ky, kz, coil, re, im, w) of the array files under `path`; what is not asked for is not opened.

    A row is a sample of a coil, or a sample where `kdata` is not asked for. Where a quantity has no file for a frame and
    encode, its columns are null; so are axes that `coords` does not have. Files of one frame and encode must agree in their number of samples, and
    no quantity may have two files: errors. Files without samples give no rows. Sets spark.sql.python.filterPushdown.enabled for the session.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameArrays)
    asked = [q for q, wanted in zip(QUANTITIES, (coords, kdata, weights), strict=True) if wanted]
    return spark.read.format(FORMAT).options(quantities=",".join(asked), **options).load(path)
