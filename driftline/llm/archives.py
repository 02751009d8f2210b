"""WARC records in ZIP packages: a writer, and a reader that needs no extraction.

Each task writes one package: a stored member of gzipped WARC records, each a
gzip member of its own, and a stored index of their ids, offsets and lengths.
The reader finds the end record (and the ZIP64 one, where a size or count does
not fit), walks the central directory, takes from it where each stored member
begins, and reads each record by its range. Packages are reached through
pyarrow's file systems, by the URI of the shared folder; a package that a task
wrote and then lost is never named to the reader.

A record whose payload an earlier id has already is a revisit: it holds the
response's HTTP header, with the length, but no payload, and names the record
it refers to.

Defined cases: a null payload counts as empty; rows with one id and one payload
are all responses or all revisits alike, as the smallest id decides; a null id
is written as a response that no revisit refers to unless no row with that
payload has an id; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import bitmap, marked, materialize, scratch_dir, small_batches

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of neighbouring records that one read brings.
READ_BYTES = 4 << 20
#: Of all copies, the share (one in so many) from which a payload counts as frequent: at most so many payloads do.
HOT = 1000
#: Values of the ZIP format (fixed): signatures, and what stands for "see ZIP64".
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
IN_ZIP64 = 0xFFFFFFFF


def open_store(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class PackageWriter:
    """A ZIP file of stored members, written in one pass; ZIP64 throughout if ``zip64``."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        # sizes follow the data, in a descriptor of 64-bit fields
        self.members.append([name.encode(), self.at, 0, 0])
        n = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 8 | 2048, 0, 0, 33, 0, IN_ZIP64, IN_ZIP64, len(n), len(extra)) + n + extra)

    def put(self, data: bytes) -> int:
        """Adds to the open member; returns where in it the data begins."""
        m = self.members[-1]
        began, m[2], m[3] = m[3], zlib.crc32(data, m[2]), m[3] + len(data)
        self.write(data)
        return began

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self.write(struct.pack("<IIQQ", 0x08074B50, crc, size, size))

    def close(self) -> None:
        first = self.at
        for name, at, crc, size in self.members:
            large = self.zip64 or max(at, size) >= IN_ZIP64
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if large else b""
            s, o = (IN_ZIP64, IN_ZIP64) if large else (size, at)
            self.write(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 8 | 2048, 0, 0, 33, crc, s, s, len(name), len(extra), 0, 0, 0, 0, o) + name + extra)
        n, length, at = len(self.members), self.at - first, self.at
        large = self.zip64 or n >= 0xFFFF or max(first, length) >= IN_ZIP64
        if large:
            self.write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, first) + struct.pack("<IIQI", LOCATOR, 0, at, 1))
        few, short, where = (0xFFFF, IN_ZIP64, IN_ZIP64) if large else (n, length, first)
        self.write(struct.pack("<IHHHHIIH", END, 0, 0, few, few, short, where, 0))


class PackageReader:
    """Members of a ZIP file and ranges of the stored ones."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = self._directory()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError(f"the package ends within a range of {n} bytes at {at}")
        return bytes(data)

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """Name -> (method, stored size, offset of the local header)."""
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        k = tail.rfind(struct.pack("<I", END))
        if k < 0:
            raise ValueError("no end of a central directory")
        n, length, first = struct.unpack("<HII", tail[k + 10 : k + 20])
        if IN_ZIP64 in (length, first) or n == 0xFFFF:
            sig, _, at64, _ = struct.unpack("<IIQI", self.read(tail_at + k - 20, 20))
            if sig != LOCATOR:
                raise ValueError("no ZIP64 locator")
            sig, *_, n, length, first = struct.unpack("<IQHHIIQQQQ", self.read(at64, 56))
            if sig != END64:
                raise ValueError("no ZIP64 end record")
        data, at, out = self.read(first, length), 0, {}
        for _ in range(n):
            sig, method, packed, full, n_name, n_extra, n_comment, where = struct.unpack("<I6xH8xIIHHH8xI", data[at : at + 46])
            if sig != CENTRAL:
                raise ValueError("a broken central directory")
            name = data[at + 46 : at + 46 + n_name].decode()
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, m = struct.unpack("<HH", extra[:4])
                if kind == 1:
                    values = [v for (v,) in struct.iter_unpack("<Q", extra[4 : 4 + m - m % 8])]
                    full = values.pop(0) if full == IN_ZIP64 else full
                    packed = values.pop(0) if packed == IN_ZIP64 else packed
                    where = values.pop(0) if where == IN_ZIP64 else where
                extra = extra[4 + m :]
            out[name] = (method, packed, where)
            at += 46 + n_name + n_extra + n_comment
        return out

    def stored(self, name: str) -> tuple[int, int]:
        """(offset, size) of a stored member's bytes."""
        method, size, where = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        sig, n_name, n_extra = struct.unpack("<I22xHH", self.read(where, 30))
        if sig != LOCAL:
            raise ValueError(f"{name} has no local header")
        return where + 30 + n_name + n_extra, size

    def records(self) -> list[tuple[int, int]]:
        """(offset in the package, length) of the records of all stored archive members.

        Lines of index members that name a file, an offset and a length in JSON
        (CDXJ, gzipped or not) or end in the last two, for the only archive, are
        taken; an archive that no index names is run through.
        """
        found: dict[str, list[tuple[int, int]]] = {n: [] for n in self.members if n.startswith("archive/") and n.endswith(".warc.gz")}
        for name in sorted(n for n in self.members if n.startswith("indexes/") and n.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz"))):
            data = self.read(*self.stored(name))
            for line in (gzip.decompress(data) if name.endswith(".gz") else data).decode().splitlines():
                brace = line.find("{")
                if brace >= 0:
                    fields = json.loads(line[brace:])
                    archive, at, n = "archive/" + str(fields["filename"]).rpartition("/")[2], int(fields["offset"]), int(fields["length"])
                elif line.strip() and not line.startswith("!") and len(found) == 1:
                    archive, (at, n) = next(iter(found)), map(int, line.split(" ")[-2:])
                else:
                    continue
                if archive in found:
                    found[archive].append((at, n))
        out = []
        for archive in sorted(found):
            first, size = self.stored(archive)
            places = sorted(set(found[archive])) or gzip_members(lambda at, n, first=first: self.read(first + at, n), size)
            out += [(first + at, n) for at, n in places]
        return out


def gzip_members(data: Callable[[int, int], bytes], size: int, block: int = 1 << 20) -> list[tuple[int, int]]:
    """(offset, length) of each gzip member in ``size`` bytes, by running through them."""
    out, at, begin, reader = [], 0, 0, zlib.decompressobj(31)
    while at < size:
        held = data(at, min(block, size - at))
        at += len(held)
        while held:
            reader.decompress(held)
            if not reader.eof:
                break
            end = at - len(reader.unused_data)
            out.append((begin, end - begin))
            begin, held, reader = end, reader.unused_data, zlib.decompressobj(31)
    if begin != size:
        raise ValueError("an archive member ends within a record")
    return out


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes | None, digest: bytes, n_bytes: int, refers_to: int | None) -> bytes:
    """One gzip member; a revisit is given no payload, only its SHA-1 and length. Line ends in a URL become %0D and %0A."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(data: bytes) -> dict:
    """The fields of a gzipped record, payload included."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    if h["WARC-Type"] != "revisit" and (h["WARC-Payload-Digest"] != f"sha1:{digest32(payload)}" or int(fields["Content-Length"]) != len(payload)):
        raise ValueError(f"the payload of {h['WARC-Record-ID']} isn't what its header says")
    return {
        "page_id": number(h["WARC-Record-ID"]),
        "url": h["WARC-Target-URI"],
        "record_type": h["WARC-Type"],
        "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(fields["Content-Length"]),
        "refers_to": number(h.get("WARC-Refers-To")),
        "payload": payload,
    }


def write_packages(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, zip64: bool = False) -> DataFrame:
    """Writes the packages and returns their paths, sizes and record numbers.

    Equal payloads are found by their SHA-256 and length; a payload shorter than
    ``least`` bytes is written whole every time.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload")).withColumn("same", F.sha2("payload", 256))
    firsts = rows.where(F.length("payload") >= least).groupBy(F.col("same").alias("of")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts, "firsts")
    total = firsts.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    # HOT digests at most have so many copies: known to every task, their rows need no shuffle
    frequent = F.col("n") * HOT >= F.lit(total)
    known = firsts.where(frequent).select(F.col("of").alias("hot"), F.col("first").alias("hot_first"))
    rows = rows.join(F.broadcast(known), F.col("same") == F.col("hot"), "left")
    # nor do payloads without a copy
    rows = marked(rows, bitmap(firsts.where(~frequent), "of"), "same", name="copy").withColumn("copy", F.col("copy") & F.col("hot").isNull() & (F.length("payload") >= least))
    rest = rows.where("copy").join(firsts.where(~frequent).select("of", "first"), F.col("same") == F.col("of"), "left")
    refers = lambda first: F.when(first.isNotNull() & F.col("page_id").isNotNull() & (first != F.col("page_id")) & (F.length("payload") >= least), first)
    names = ["page_id", "url", "payload", "digest", "n_bytes", "refers_to"]

    def ready(rows: DataFrame, first: str) -> DataFrame:
        """The columns of a record; a revisit's payload goes."""
        rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "n_bytes": F.length("payload").cast("long"), "refers_to": refers(F.col(first))})
        return rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))).select(*names)

    packed = small_batches(ready(rows.where("not copy"), "hot_first").unionByName(ready(rest, "first")))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, index, n = f"{folder}/{uuid.uuid4().hex}.wacz", None, [], 0
        for part in parts:
            for page_id, url, payload, digest, n_bytes, refers_to in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if out is None:
                    store, path = open_store(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    stream = store.open_output_stream(path)
                    out = PackageWriter(stream, zip64)
                    out.begin(DATA)
                record = warc_record(page_id, url, None if refers_to is not None else payload, digest, n_bytes, refers_to)
                index.append(f"{'' if page_id is None else page_id} {out.put(record)} {len(record)}\n")
                n += 1
        if out is not None:
            out.end()
            out.begin(INDEX)
            out.put("".join(index).encode())
            out.end()
            out.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.at], pa.int64()), pa.array([n], pa.int64())], names=["path", "size", "n_records"])

    return materialize(packed.mapInArrow(run, "path string, size long, n_records long"), "packages")


def read_packages(packages: DataFrame, *, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records of packages given as (path, size), payload included.

    First each package's directory and index become ranges of neighbouring
    records, then the ranges are dealt out and read.
    """

    def plan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, size in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                store, inside = open_store(path)
                with store.open_input_file(inside) as f:
                    package = PackageReader(f, size)
                    places = package.records()
                ranges: list[list[int]] = []
                held, end = read_bytes, None
                for offset, length in places:
                    if held + length > read_bytes or offset != end:
                        ranges.append([])
                        held = 0
                    ranges[-1] += [offset, length]
                    held, end = held + length, offset + length
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(ranges), pa.string()), pa.array(ranges, pa.list_(pa.int64()))], names=["path", "ranges"])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, ranges in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                store, inside = open_store(path)
                first, last = ranges[0], ranges[-2] + ranges[-1]
                with store.open_input_file(inside) as f:
                    f.seek(first)
                    data = f.read(last - first)
                found = [parse_record(data[a - first : a - first + n]) for a, n in zip(ranges[::2], ranges[1::2], strict=True)]
                yield pa.RecordBatch.from_pylist(found, RECORD)

    spark = packages.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = packages.select("path", "size").repartition(tasks).mapInArrow(plan, "path string, ranges array<bigint>")
    return ranges.repartition(tasks).mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def package_folder(pages: DataFrame) -> str:
    return f"{scratch_dir(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
