"""XTC and TRR trajectories: big-endian frames of their own sizes, read by ranges.

One task walks through a file's frame headers; the places that it finds are
dealt out, and each task reads and decodes its frames only. Files hold
nanometres, tables angstrom.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftline.sources.dcd import _store

XTC_MAGIC, XTC_LARGE, TRR_MAGIC = 1995, 2023, 1993
#: Atoms up to which an XTC frame is not packed, and the first usable packing size.
PLAIN, FIRST = 9, 9
#: Sizes of packed differences, by index.
SIZES = [
    0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096, 5060, 6501, 8192,
    10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524287, 660561, 832255, 1048576, 1321122, 1664510,
    2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216,
]

FRAME = "path string, frame long, step long, time_ps double, atom long, x double, y double, z double, vx double, vy double, vz double, lx double, ly double, lz double, cell array<double>"
_KINDS = [pa.string(), *[pa.int64()] * 2, pa.float64(), pa.int64(), *[pa.float64()] * 9, pa.list_(pa.float64())]


class Bits:
    """Numbers of any width from the most significant bit of the first byte on."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        first, last = self.at // 8, -(-(self.at + n) // 8)
        self.at += n
        return int.from_bytes(self.data[first:last]) >> (8 * last - self.at) & ((1 << n) - 1)

    def three(self, width: int, sizes: tuple[int, int, int]) -> tuple[int, int, int]:
        """Three numbers below ``sizes``, packed into one whose bytes ascend in weight."""
        rest = width % 8
        packed = self.take(width)
        whole = int.from_bytes((packed >> rest).to_bytes(width // 8), "little")
        value = whole | (packed & ((1 << rest) - 1)) << (width - rest)
        value, c = divmod(value, sizes[2])
        a, b = divmod(value, sizes[1])
        return a, b, c


def unpacked(data: bytes, n: int, low: tuple[int, ...], high: tuple[int, ...], index: int) -> np.ndarray:
    """The integer coordinates (n x 3) of a packed XTC frame."""
    bits, out = Bits(data), np.zeros((n, 3), np.int64)
    spans = tuple(b - a + 1 for a, b in zip(low, high, strict=True))
    apart = max(spans) > 0xFFFFFF
    width = (spans[0] * spans[1] * spans[2]).bit_length()
    at = run = 0
    while at < n:
        full = tuple(bits.take(s.bit_length()) for s in spans) if apart else bits.three(width, spans)
        full = tuple(f + a for f, a in zip(full, low, strict=True))
        change = 0
        if bits.take(1):
            code = bits.take(5)
            change = code % 3 - 1
            run = code - code % 3
        size = SIZES[index]
        near, prev = [], full
        for _ in range(run // 3):
            prev = tuple(p + d - size // 2 for p, d in zip(prev, bits.three(index, (size, size, size)), strict=True))
            near.append(prev)
        # the first near atom stands before the full one
        rows = [*near[:1], full, *near[1:]]
        out[at : at + len(rows)] = rows
        at += len(rows)
        index += change
    return out


def _xtc_size(f, at: int) -> int:
    f.seek(at)
    head = f.read(96)
    magic, n = struct.unpack(">2i", head[:8])
    if magic not in (XTC_MAGIC, XTC_LARGE):
        raise ValueError(f"no XTC frame at {at}")
    if n <= PLAIN:
        return 56 + 12 * n
    size, begin = (struct.unpack(">i", head[88:92])[0], 92) if magic == XTC_MAGIC else (struct.unpack(">q", head[88:96])[0], 96)
    return begin + size + -size % 4


def _xtc_frame(data: bytes) -> dict:
    magic, n, step, time = struct.unpack(">3if", data[:16])
    cell = np.frombuffer(data, ">f4", 9, 16).astype(float)
    if n <= PLAIN:
        xyz = np.frombuffer(data, ">f4", 3 * n, 56).reshape(n, 3).astype(float)
    else:
        precision, *numbers = struct.unpack(">f7i", data[56:88])
        begin = 92 if magic == XTC_MAGIC else 96
        # coordinates are single precision, as other readers give them
        xyz = (unpacked(data[begin:], n, tuple(numbers[:3]), tuple(numbers[3:6]), numbers[6]).astype(np.float32) * np.float32(1.0 / precision)).astype(float)
    return {"step": step, "time": time, "cell": cell, "x": xyz, "v": None}


def _trr_head(f, at: int) -> tuple[list[int], str, int]:
    """(numbers of the header, type of reals, where the data begin)."""
    f.seek(at)
    head = f.read(76)
    if struct.unpack(">i", head[:4])[0] != TRR_MAGIC:
        raise ValueError(f"no TRR frame at {at}")
    name = struct.unpack(">i", head[8:12])[0]
    begin = 12 + name + -name % 4
    numbers = list(struct.unpack(">13i", head[begin : begin + 52]))
    real = numbers[2] // 9 if numbers[2] else max(numbers[7:10]) // max(3 * numbers[10], 1)
    return numbers, f">f{real}", begin + 52 + 2 * real


def _trr_size(f, at: int) -> int:
    numbers, _, begin = _trr_head(f, at)
    return begin + sum(numbers[:10])


def _trr_frame(data: bytes) -> dict:
    import io

    numbers, real, begin = _trr_head(io.BytesIO(data), 0)
    size = int(real[2:])
    time = float(np.frombuffer(data, real, 1, begin - 2 * size)[0])
    sizes, n = numbers[:10], numbers[10]
    at = begin + sum(sizes[:2])
    cell = np.frombuffer(data, real, 9, at).astype(float) if sizes[2] else np.zeros(9)
    at += sum(sizes[2:7])
    take = lambda k, at: np.frombuffer(data, real, 3 * n, at).reshape(n, 3).astype(float) if sizes[k] else None
    return {"step": numbers[11], "time": time, "cell": cell, "x": take(7, at), "v": take(8, at + sizes[7])}


def _read(spark: SparkSession, paths: list[str], size_of: Callable, parse: Callable, frames_per_task: int) -> DataFrame:
    def plan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path in part.column(0).to_pylist():
                store, inside = _store(path)
                places, at = [], 0
                with store.open_input_file(inside) as f:
                    end = f.size()
                    while at < end:
                        places.append(at)
                        at += size_of(f, at)
                if at != end:
                    raise ValueError(f"{path} ends within a frame")
                places.append(at)
                firsts = range(0, len(places) - 1, frames_per_task)
                rows = [places[k : k + frames_per_task + 1] for k in firsts]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(firsts, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["path", "first", "places"])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, first, places in zip(*[c.to_pylist() for c in part.columns], strict=True):
                store, inside = _store(path)
                with store.open_input_file(inside) as f:
                    for k, (a, b) in enumerate(zip(places, places[1:], strict=False)):
                        f.seek(a)
                        held = parse(f.read(b - a))
                        if held["x"] is None:
                            continue
                        n = len(held["x"])
                        cell = held["cell"].reshape(3, 3) * 10.0
                        skewed = np.abs(cell - np.diag(np.diag(cell))).max() > 1e-6
                        box = np.diag(cell).tolist() if cell.any() else [None] * 3
                        same = lambda v, t: pa.array([v] * n, t)  # noqa: B023, E731
                        x = held["x"].T * 10.0
                        v = held["v"].T * 10.0 if held["v"] is not None else [[None] * n] * 3
                        columns = [path, first + k, held["step"], held["time"], np.arange(n), *x, *v, *box, cell.reshape(-1).tolist() if skewed else None]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) if i == 4 or 5 <= i < 11 else same(c, t) for i, (c, t) in enumerate(zip(columns, _KINDS, strict=True))], names=[c.split()[0] for c in FRAME.split(", ")])

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = files.repartition(max(1, min(len(paths), tasks))).mapInArrow(plan, "path string, first long, places array<bigint>")
    return places.repartition(tasks).mapInArrow(read, FRAME)


def read_xtc(spark: SparkSession, paths: list[str], frames_per_task: int = 64) -> DataFrame:
    """FRAME's columns; velocities are null, cell (nine numbers) only where the box is skewed."""
    return _read(spark, paths, _xtc_size, _xtc_frame, frames_per_task)


def read_trr(spark: SparkSession, paths: list[str], frames_per_task: int = 64) -> DataFrame:
    """FRAME's columns, single or double precision; frames without coordinates are left out."""
    return _read(spark, paths, _trr_size, _trr_frame, frames_per_task)


def trr_bytes(coordinates: np.ndarray, cells: np.ndarray, times: list[float], velocities: np.ndarray | None = None, real: str = ">f4") -> bytes:
    """A TRR file of frames x atoms x 3 coordinates in angstrom and frames x 9 cells."""
    out, size = [], int(real[2:])
    for k, x in enumerate(coordinates):
        n = len(x)
        numbers = [0, 0, 9 * size, 0, 0, 0, 0, 3 * n * size, 0 if velocities is None else 3 * n * size, 0, n, k, 0]
        out.append(struct.pack(">3i", TRR_MAGIC, 13, 12) + b"GMX_trn_file" + struct.pack(">13i", *numbers) + np.array([times[k], 0.0], real).tobytes())
        out += [(np.asarray(part) / 10.0).astype(real).tobytes() for part in (cells[k], x, *([] if velocities is None else [velocities[k]]))]
    return b"".join(out)


class _Packer:
    def __init__(self):
        self.value = self.n = 0

    def put(self, x: int, n: int) -> None:
        self.value, self.n = self.value << n | x, self.n + n

    def three(self, xs: tuple[int, ...], width: int, sizes: tuple[int, ...]) -> None:
        value = (xs[0] * sizes[1] + xs[1]) * sizes[2] + xs[2]
        rest = width % 8
        whole = int.from_bytes((value & ((1 << (width - rest)) - 1)).to_bytes(width // 8, "little"))
        self.put(whole << rest | value >> (width - rest), width)

    def bytes(self) -> bytes:
        pad = -self.n % 8
        return (self.value << pad).to_bytes((self.n + pad) // 8)


def xtc_bytes(coordinates: np.ndarray, cells: np.ndarray, times: list[float], precision: float = 1000.0, index: int = 30) -> bytes:
    """An XTC file; two neighbours in the list that are close are packed together, with differences of size ``index``."""
    out = []
    for k, x in enumerate(coordinates):
        n = len(x)
        head = struct.pack(">3if", XTC_MAGIC, n, k, times[k]) + (np.asarray(cells[k]) / 10.0).astype(">f4").tobytes() + struct.pack(">i", n)
        if n <= PLAIN:
            out.append(head + (x / 10.0).astype(">f4").tobytes())
            continue
        whole = np.rint(x / 10.0 * precision).astype(np.int64)
        low, high = whole.min(axis=0).tolist(), whole.max(axis=0).tolist()
        spans = tuple(b - a + 1 for a, b in zip(low, high, strict=True))
        width, bits, at = (spans[0] * spans[1] * spans[2]).bit_length(), _Packer(), 0
        size = SIZES[index]
        rows = whole.tolist()
        while at < n:
            pair = at + 1 < n and all(0 <= a - b + size // 2 < size for a, b in zip(rows[at], rows[at + 1], strict=True))
            full = rows[at + 1] if pair else rows[at]
            shifted = tuple(f - a for f, a in zip(full, low, strict=True))
            if max(spans) > 0xFFFFFF:
                for s, v in zip(spans, shifted, strict=True):
                    bits.put(v, s.bit_length())
            else:
                bits.three(shifted, width, spans)
            bits.put(1, 1)
            bits.put(4 if pair else 1, 5)
            if pair:
                bits.three(tuple(a - b + size // 2 for a, b in zip(rows[at], full, strict=True)), index, (size, size, size))
            at += 2 if pair else 1
        data = bits.bytes()
        out.append(head + struct.pack(">f7i", precision, *low, *high, index) + struct.pack(">i", len(data)) + data + b"\0" * (-len(data) % 4))
    return b"".join(out)
