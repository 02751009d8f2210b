"""DCD trajectories: a header, then records of equal size, so a frame's place follows from its number.

The header is read once for each file; frame ranges are dealt out as rows and
each task reads its ranges only, through pyarrow's file systems.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, frame long, atom long, x double, y double, z double, lx double, ly double, lz double"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def layout(f) -> tuple[int, int, int, bool, int]:
    """(atoms, frames, offset of the first frame, unit cells, bytes of a frame)."""
    n = struct.unpack("<i", f.read(4))[0]
    head = f.read(n + 4)
    if n != 84 or head[:4] != b"CORD":
        raise ValueError("not a little-endian DCD file")
    numbers = struct.unpack("<20i", head[4:84])
    title = struct.unpack("<i", f.read(4))[0]
    f.read(title + 4)
    _, atoms, _ = struct.unpack("<3i", f.read(12))
    cell, at = numbers[10] == 1, f.tell()
    size = (56 if cell else 0) + 3 * (8 + 4 * atoms)
    return atoms, (f.size() - at) // size, at, cell, size


def read_dcd(spark: SparkSession, paths: list[str], frames_per_task: int = 256, length_scale: float = 1.0) -> DataFrame:
    def plan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for path in part.column(0).to_pylist():
                store, inside = _store(path)
                with store.open_input_file(inside) as f:
                    _, n, *_ = layout(f)
                out += [{"path": path, "first": k, "last": min(k + frames_per_task, n)} for k in range(0, n, frames_per_task)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                store, inside = _store(r["path"])
                with store.open_input_file(inside) as f:
                    atoms, _, at, cell, size = layout(f)
                    f.seek(at + r["first"] * size)
                    for frame in range(r["first"], r["last"]):
                        data = f.read(size)
                        box = np.frombuffer(data, "<f8", 6, 4)[[0, 2, 5]] * length_scale if cell else [None] * 3
                        k, xyz = 56 if cell else 0, []
                        for _ in range(3):
                            xyz.append(np.frombuffer(data, "<f4", atoms, k + 4).astype(float) * length_scale)
                            k += 8 + 4 * atoms
                        same = lambda v, t: pa.array([v] * atoms, t)
                        yield pa.RecordBatch.from_arrays([same(r["path"], pa.string()), same(frame, pa.int64()), pa.array(np.arange(atoms)), *map(pa.array, xyz), *[same(b, pa.float64()) for b in box]], names=["path", "frame", "atom", "x", "y", "z", "lx", "ly", "lz"])

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.mapInArrow(plan, "path string, first long, last long").repartition(tasks).mapInArrow(read, SCHEMA)


def dcd_bytes(coordinates: np.ndarray, boxes: np.ndarray | None = None) -> bytes:
    """A DCD file of frames x atoms x 3 coordinates and frames x 3 box lengths."""
    n, atoms, _ = coordinates.shape
    record = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    numbers = [0] * 20
    numbers[0], numbers[1], numbers[2], numbers[10], numbers[19] = n, 0, 1, int(boxes is not None), 24
    out = [record(b"CORD" + struct.pack("<20i", *numbers)), record(struct.pack("<i", 1) + b" " * 80), record(struct.pack("<i", atoms))]
    for i in range(n):
        if boxes is not None:
            a, b, c = map(float, boxes[i])
            out.append(record(struct.pack("<6d", a, 90.0, b, 90.0, 90.0, c)))
        out += [record(coordinates[i, :, k].astype("<f4").tobytes()) for k in range(3)]
    return b"".join(out)
