"""OpenStreetMap PBF files as DataFrames, by a data source that reads a file in splits.

A file is a run of blobs, each behind a header that says its kind and size. A split is a range of bytes; its task looks for the first header that
begins in it, makes sure that another header or the file's end follows the blob, and goes on from blob to blob until one begins in the
next split. So nobody reads a file to split it. Numbers in a blob are varints, packed, zigzag and delta coded; whole arrays of
them are decoded at once.

Files are opened through Arrow's file systems, so a path may be local or a URI that these know.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
#: Fixed values of the format: the largest header and blob that a file may hold, and how a header of data begins.
MOST_HEADER, MOST_BLOB, MARK = 64 << 10, 32 << 20, b"\x0a\x07OSMData"

_TAGS = pa.map_(pa.string(), pa.string())
_MEMBER = pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
#: Tables by what they hold, for Spark and for Arrow.
KINDS = {
    "nodes": ("id long, lon double, lat double, tags map<string,string>", pa.schema([("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("tags", _TAGS)])),
    "ways": ("id long, nodes array<long>, tags map<string,string>", pa.schema([("id", pa.int64()), ("nodes", pa.list_(pa.int64())), ("tags", _TAGS)])),
    "relations": ("id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>", pa.schema([("id", pa.int64()), ("members", pa.list_(_MEMBER)), ("tags", _TAGS)])),
}


def varints(raw: bytes) -> np.ndarray:
    """All varints of a packed field, as 64-bit numbers without sign."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(b < 128)
    first = np.r_[0, last[:-1] + 1]
    shift = (7 * (np.arange(last[-1] + 1) - np.repeat(first, last - first + 1))).astype(np.uint64)
    return np.add.reduceat((b[: last[-1] + 1] & 127).astype(np.uint64) << shift, first)


def zigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def deltas(raw: bytes) -> np.ndarray:
    """A packed field of signed differences, added up."""
    return np.cumsum(zigzag(varints(raw)))


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: whole numbers and byte strings; fixed-width ones as bytes."""
    i, n = 0, len(raw)

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = raw[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < n:
        key = number()
        wire = key & 7
        if wire == 0:
            yield key >> 3, number()
            continue
        size = number() if wire == 2 else {1: 8, 5: 4}.get(wire, -1)
        if size < 0 or i + size > n:
            raise ValueError(f"not a message: wire type {wire}, {size} bytes")
        yield key >> 3, raw[i : i + size]
        i += size


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def header(raw: bytes) -> tuple[str, int] | None:
    """(type, size of the blob) that a header says; None if it is none."""
    try:
        found = dict(fields(raw))
        kind, size = found[1].decode(), found[3]
    except (KeyError, ValueError, AttributeError, IndexError, UnicodeDecodeError):
        return None
    return (kind, size) if isinstance(size, int) and size <= MOST_BLOB + MOST_HEADER else None


def unpacked(blob: bytes) -> bytes:
    own = dict(fields(blob))
    if 1 in own:
        return own[1]
    if 3 in own:
        return zlib.decompress(own[3])
    raise ValueError(f"a blob is packed in a way that is not read here (field {min(k for k in own if k != 2)})")


class Block:
    """A block of data: its strings, and its groups of elements as Arrow tables."""

    def __init__(self, raw: bytes):
        self.strings: list[str] = []
        self.groups: list[bytes] = []
        self.grain, self.lat0, self.lon0 = 100, 0, 0
        for k, v in fields(raw):
            if k == 1:
                self.strings = [s.decode("utf-8", "replace") for j, s in fields(v) if j == 1]
            elif k == 2:
                self.groups.append(v)
            elif k == 17:
                self.grain = v
            elif k == 19:
                self.lat0 = _signed(v)
            elif k == 20:
                self.lon0 = _signed(v)

    def tags(self, own: dict[int, bytes]) -> list[tuple[str, str]]:
        s = self.strings
        found = {s[a]: s[b] for a, b in zip(varints(own.get(2, b"")).tolist(), varints(own.get(3, b"")).tolist(), strict=True)}
        return list(found.items())

    def degrees(self, x: np.ndarray, base: int) -> np.ndarray:
        return 1e-9 * (base + self.grain * x)

    def nodes(self, group: bytes) -> Iterator[pa.RecordBatch]:
        single = [dict(fields(v)) for k, v in fields(group) if k == 1]
        if single:
            number = lambda k: zigzag(np.array([n[k] for n in single], np.uint64))
            yield self._nodes(number(1), number(8), number(9), [self.tags(n) for n in single])
        for k, v in fields(group):
            if k == 2:
                own = dict(fields(v))
                ids = deltas(own.get(1, b""))
                yield self._nodes(ids, deltas(own.get(8, b"")), deltas(own.get(9, b"")), self._dense_tags(varints(own.get(10, b"")), len(ids)))

    def _nodes(self, ids: np.ndarray, lat: np.ndarray, lon: np.ndarray, tags: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(self.degrees(lon, self.lon0)), pa.array(self.degrees(lat, self.lat0)), pa.array(tags, _TAGS)], schema=KINDS["nodes"][1])

    def _dense_tags(self, flat: np.ndarray, n: int) -> list[list[tuple[str, str]]]:
        """Pairs of string numbers node after node, a 0 behind each node's; nothing at all if no node has any."""
        if not len(flat):
            return [[]] * n
        out, own, s, it = [], {}, self.strings, iter(flat.tolist())
        for a in it:
            if a == 0:
                out.append(list(own.items()))
                own = {}
            else:
                own[s[a]] = s[next(it)]
        return out

    def ways(self, group: bytes) -> Iterator[pa.RecordBatch]:
        own = [dict(fields(v)) for k, v in fields(group) if k == 3]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([_signed(w[1]) for w in own], pa.int64()), pa.array([deltas(w.get(8, b"")) for w in own], pa.list_(pa.int64())), pa.array([self.tags(w) for w in own], _TAGS)], schema=KINDS["ways"][1])

    def relations(self, group: bytes) -> Iterator[pa.RecordBatch]:
        own = [dict(fields(v)) for k, v in fields(group) if k == 4]
        kinds = ("node", "way", "relation")
        members = [[{"type": kinds[t], "ref": r, "role": self.strings[s]} for t, r, s in zip(varints(x.get(10, b"")).tolist(), deltas(x.get(9, b"")).tolist(), varints(x.get(8, b"")).tolist(), strict=True)] for x in own]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([_signed(x[1]) for x in own], pa.int64()), pa.array(members, pa.list_(_MEMBER)), pa.array([self.tags(x) for x in own], _TAGS)], schema=KINDS["relations"][1])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, split_bytes: int):
        self.path, self.kind, self.split_bytes = path, kind, split_bytes

    def partitions(self) -> list[Split]:
        store, at = _opened(self.path)
        info = store.get_file_info(at)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive=True)) if f.is_file and f.path.endswith(".pbf")]
        if not files:
            raise FileNotFoundError(f"no PBF file at {self.path}")
        own = lambda f: f.path if isinstance(store, fs.LocalFileSystem) else f"{self.path.split('://')[0]}://{f.path}"
        return [Split(own(f) if not info.is_file else self.path, i, min(f.size, i + self.split_bytes)) for f in sorted(files, key=lambda f: f.path) for i in range(0, f.size, self.split_bytes)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        store, at = _opened(split.path)
        with store.open_input_file(at) as f:
            for kind, blob in blobs(f, split.start, split.end):
                if kind == "OSMData":
                    block = Block(unpacked(blob))
                    for group in block.groups:
                        yield from getattr(block, self.kind)(group)


def _header_at(f, at: int, size: int) -> tuple[str, int, int] | None:
    """(type, place of the blob, its size) if a header begins at ``at``."""
    if at + 4 > size:
        return None
    n = int.from_bytes(f.read_at(4, at), "big")
    if not 0 < n <= MOST_HEADER or at + 4 + n > size:
        return None
    said = header(f.read_at(n, at + 4))
    return (said[0], at + 4 + n, said[1]) if said and at + 4 + n + said[1] <= size else None


def first_header(f, start: int, end: int, step: int = 1 << 20) -> int | None:
    """Where the first header that begins in [start, end) begins: at 0 that of the file, else that of a blob of data behind which there is another or nothing."""
    size = f.size()
    if start == 0:
        return 0
    at = start
    while at < end:
        part = f.read_at(min(step + len(MARK) + 4, size - at), at)
        i = part.find(MARK, 4)
        while i >= 0 and at + i - 4 < end:
            found = _header_at(f, at + i - 4, size)
            if found and ((after := found[1] + found[2]) == size or _header_at(f, after, size)):
                return at + i - 4
            i = part.find(MARK, i + 1)
        at += step
    return None


def blobs(f, start: int, end: int) -> Iterator[tuple[str, bytes]]:
    """(type, blob) of the blobs whose headers begin in [start, end)."""
    size, at = f.size(), first_header(f, start, end)
    while at is not None and at < end:
        found = _header_at(f, at, size)
        if not found:
            raise ValueError(f"no blob header at byte {at}")
        kind, place, n = found
        yield kind, f.read_at(n, place)
        at = place + n


class PbfSource(DataSource):
    """Options: path, kind (nodes, ways or relations), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def _kind(self) -> str:
        kind = self.options.get("kind", "nodes")
        if kind not in KINDS:
            raise ValueError(f"no kind {kind!r}; there are {', '.join(KINDS)}")
        return kind

    def schema(self) -> str:
        return KINDS[self._kind()][0]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._kind(), int(self.options.get("split_bytes", SPLIT_BYTES)))


def tables(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of a PBF file or of a folder of such files, as ``osm`` wants them. An element that several files have comes once from each."""
    spark.dataSource.register(PbfSource)
    return tuple(spark.read.format("osm_pbf").option("kind", k).option("split_bytes", split_bytes).load(path) for k in KINDS)
