"""The vector file: n little-endian float scales, then n rows of dim int8 codes. A Python data source reads it."""

from __future__ import annotations

import hashlib
import json
import shutil
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafmill.operators.vectors import quantization_error, quantize, scale

#: Rows one task reads.
ROWS = 100_000


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.n, self.dim = options["path"], int(options["rows"]), int(options["dim"])
        if Path(self.path).stat().st_size != self.n * 4 + self.n * self.dim:
            raise ValueError(f"{self.path} isn't {self.n} vectors of {self.dim} codes")

    def partitions(self) -> list[InputPartition]:
        return [_Range(a, min(a + ROWS, self.n)) for a in range(0, self.n, ROWS)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        a, b = partition.first, partition.last
        scales = np.fromfile(self.path, "<f4", b - a, offset=4 * a)
        codes = np.fromfile(self.path, np.int8, (b - a) * self.dim, offset=4 * self.n + a * self.dim).reshape(-1, self.dim)
        for i, (s, q) in enumerate(zip(scales, codes), a):
            v = q.astype(np.float32) * (s / np.float32(127))
            n = float(np.linalg.norm(v))
            yield i, float(s), (v / (n or 1.0)).tolist()


class VectorFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    def schema(self) -> str:
        return "row bigint, scale float, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_vectors(spark: SparkSession, path: str, rows: int, dim: int) -> DataFrame:
    """(row, scale, embedding) of a vector file, normalised again; a file of the wrong length is an error."""
    spark.dataSource.register(VectorFile)
    return spark.read.format("vectorfile").option("path", path).option("rows", rows).option("dim", dim).load()


def write_vectors(vectors: DataFrame, folder: str, model: str, key: str = "vec_id", v: str = "embedding") -> dict:
    """Write vectors.bin in order of the key and note model and dimension in the bundle's manifest. The codes are made by
    the executors and streamed to the file, which is what one reader loads."""
    path, head = Path(folder) / "vectors.bin", Path(folder) / "manifest.json"
    rows = vectors.select(key, scale(F.col(v)).alias("s"), quantize(F.col(v)).alias("q")).orderBy(key)
    count, dim, part = 0, 0, path.with_suffix(".codes")
    with path.open("wb") as scales, part.open("wb") as codes:
        for r in rows.toLocalIterator():
            scales.write(np.float32(r["s"]).tobytes())
            codes.write(np.array(r["q"], np.int8).tobytes())
            count, dim = count + 1, len(r["q"])
    with path.open("ab") as whole, part.open("rb") as codes:
        shutil.copyfileobj(codes, whole)
    part.unlink()
    error = quantization_error(vectors, v).head()
    if head.exists():
        m = json.loads(head.read_text())
        m |= {"embed_model": model, "dim": dim}
        with path.open("rb") as f:
            m["files"]["vectors.bin"] = hashlib.file_digest(f, "sha256").hexdigest()
        head.write_text(json.dumps(m, indent=2, sort_keys=True) + "\n")
    return {"count": count, "dim": dim, "bytes": count * (4 + dim), "mean_error": error["mean_error"], "worst_cosine": error["worst_cosine"]}
